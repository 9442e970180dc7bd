"""Hourly means, a regular hourly grid, and linear interpolation in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hourly_mean(
    df: DataFrame, measures: Sequence[str], site: str = "site_id", timestamp: str = "timestamp"
) -> DataFrame:
    """Mean per site and hour; partial sums are formed before the shuffle, so hot hours are no problem."""
    hour = F.date_trunc("hour", timestamp).cast("timestamp_ntz").alias(timestamp)
    return df.groupBy(site, hour).agg(*[F.avg(name).alias(name) for name in measures])


GAP_BLOCK_HOURS = 4096


def _filled(rows: DataFrame, site: str, timestamp: str, longest_gap: int | None) -> DataFrame:
    """Each hour row, and the hours up to the next row of its site; ``_offset`` counts hours from the row.

    Hours of a gap are made in blocks, so a gap of any length is never one array. A gap of more than
    ``longest_gap`` hours stays open.
    """
    following = F.lead(timestamp).over(Window.partitionBy(site).orderBy(timestamp))
    micros = F.unix_micros(following.cast("timestamp")) - F.unix_micros(F.col(timestamp).cast("timestamp"))
    hours = F.coalesce(F.floor(micros / 3_600_000_000), F.lit(1))
    if longest_gap is not None:
        hours = F.when(hours > longest_gap, 1).otherwise(hours)
    spans = rows.withColumn("_hours", hours)
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_hours") - 1, F.lit(GAP_BLOCK_HOURS).cast("long")))
    blocks = spans.withColumn("_first", first)
    last = F.least(F.col("_first") + GAP_BLOCK_HOURS, F.col("_hours")) - 1
    return blocks.withColumn("_offset", F.explode(F.sequence("_first", last))).drop("_first", "_hours")


def hourly_grid(df: DataFrame, site: str = "site_id", timestamp: str = "timestamp", longest_gap: int | None = None) -> DataFrame:
    """Every hour from a site's first to its last one, from rows on the hour."""
    hours = _filled(df.select(site, timestamp).distinct(), site, timestamp, longest_gap)
    return hours.select(site, F.timestamp_add("HOUR", "_offset", timestamp).alias(timestamp))


def interpolate_hourly(
    df: DataFrame,
    measures: Sequence[str],
    site: str = "site_id",
    timestamp: str = "timestamp",
    longest_gap: int | None = None,
) -> DataFrame:
    """Gap-free hourly table: means, then linear in time between known hours, ends held constant.

    Windows run over the hours that have readings; after the hourly mean a site has one row per hour, so they are
    bounded by the calendar. The hours between two rows are made from these two alone, in blocks: a wrong time
    stamp (the year 1900 or 9999) costs as many rows as it has hours, but no array or window over them. All hours
    are filled, whatever the gap; with ``longest_gap`` the rows on both sides of a longer gap stay and no hour
    between them is made. Rows without a time are left out.
    """
    means = hourly_mean(df, measures, site, timestamp).where(F.col(timestamp).isNotNull())
    ordered, reverse = (Window.partitionBy(site).orderBy(way(timestamp)) for way in (F.asc, F.desc))
    seconds = F.unix_seconds(F.col(timestamp).cast("timestamp")).cast("double")
    before, after = {}, {}
    for name in measures:
        known = F.when(F.col(name).isNotNull(), F.struct(seconds.alias("at"), F.col(name).alias("value")))
        before[f"_b_{name}"] = F.last(known, ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
        after[f"_a_{name}"] = F.last(known, ignorenulls=True).over(reverse.rowsBetween(Window.unboundedPreceding, -1))
    hours = _filled(means.withColumns({**before, **after}), site, timestamp, longest_gap)
    hours = hours.withColumn(timestamp, F.timestamp_add("HOUR", "_offset", timestamp))

    def value(name: str) -> Column:
        before, after = F.col(f"_b_{name}"), F.col(f"_a_{name}")
        share = (seconds - before["at"]) / F.nullif(after["at"] - before["at"], F.lit(0.0))
        between = before["value"] + (after["value"] - before["value"]) * share
        own = F.when(F.col("_offset") == 0, F.col(name))
        return F.coalesce(own, between, before["value"], after["value"])

    return hours.select(site, timestamp, *[value(name).alias(name) for name in measures])
