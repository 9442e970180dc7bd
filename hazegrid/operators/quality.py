"""Dataset summary and validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazegrid import schema as S
from hazegrid.operators.series import BLOCK, ROW, frames, index_rows

ORDER_BLOCK_ROWS = 1_000_000


def site_counts(train: DataFrame, unseen: DataFrame, site: str = S.SITE) -> DataFrame:
    """Train rows per site with its unseen rows, 0 where it has none. Both sides are counted first."""
    left = train.groupBy(site).agg(F.count(F.lit(1)).alias("train_rows"))
    right = unseen.groupBy(site).agg(F.count(F.lit(1)).alias("unseen_rows"))
    return left.join(right, site, "left").fillna({"unseen_rows": 0})


def site_summary(
    df: DataFrame, site: str = S.SITE, timestamp: str = S.TIMESTAMP, split: str = S.SPLIT
) -> DataFrame:
    """One line per site that has train rows; one pass over both splits."""
    in_train = F.col(split) == S.TRAIN
    return (
        df.groupBy(site)
        .agg(
            F.min(F.when(in_train, F.col("latitude"))).alias("latitude"),
            F.min(F.when(in_train, F.col("longitude"))).alias("longitude"),
            F.count_if(in_train).alias("train_rows"),
            F.count_if(F.col(split) == S.UNSEEN).alias("unseen_rows"),
            F.min(F.when(in_train, F.col(timestamp))).alias("train_start"),
            F.max(F.when(in_train, F.col(timestamp))).alias("train_end"),
        )
        .where(F.col("train_rows") > 0)
    )


def dataset_totals(
    df: DataFrame,
    features: Sequence[str] = (*S.FORECAST_COLUMNS, *S.SATELLITE_COLUMNS),
    targets: Sequence[str] = tuple(S.TARGET_COLUMNS),
    site: str = S.SITE,
    split: str = S.SPLIT,
) -> DataFrame:
    """Sites and rows of the whole data set, with its column lists."""
    per_site = df.groupBy(site).agg(
        F.count_if(F.col(split) == S.TRAIN).alias("train"), F.count_if(F.col(split) == S.UNSEEN).alias("unseen")
    )
    return per_site.agg(
        F.count_if(F.col("train") > 0).alias("total_sites"),
        F.coalesce(F.sum("train"), F.lit(0)).alias("total_train_rows"),
        F.coalesce(F.sum("unseen"), F.lit(0)).alias("total_unseen_rows"),
    ).select(
        "*",
        F.array(*[F.lit(name) for name in features]).alias("features"),
        F.array(*[F.lit(name) for name in targets]).alias("targets"),
    )


def order_check(
    df: DataFrame,
    sequence: str,
    site: str = S.SITE,
    timestamp: str = S.TIMESTAMP,
    block_rows: int = ORDER_BLOCK_ROWS,
) -> DataFrame:
    """Per site: does time ever step back, or is it unknown, in the order of a unique ``sequence``?

    Rows are numbered by a range sort, so numbers are dense whatever the sequence looks like, and cut into
    blocks of ``block_rows`` that start with the last row of the block before.
    """
    numbered = index_rows(df.select(site, timestamp, sequence), [site], [sequence])
    blocks = frames(numbered, block_rows, 1)
    inside = Window.partitionBy(site, BLOCK).orderBy(ROW)
    back = F.col(timestamp).isNull() | F.coalesce(F.col(timestamp) < F.lag(timestamp).over(inside), F.lit(False))
    return blocks.withColumn("_back", back).groupBy(site).agg(F.bool_or("_back").alias("out_of_order"))


def validation_report(
    df: DataFrame,
    required: Sequence[str],
    site: str = S.SITE,
    timestamp: str = S.TIMESTAMP,
    sequence: str | None = None,
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """One row: ``passed`` and the list of ``issues``. Rows are counted per key before anything is judged.

    A key is a site and a time; of irregular tables, where one site may report twice in a moment, also ``tie_break``.
    """
    missing = sorted(set(required) - set(df.columns))
    keys = df.groupBy(site, timestamp, *tie_break).agg(F.count(F.lit(1)).alias("_n"))
    found = keys.agg(
        F.coalesce(F.bool_or(F.col(timestamp).isNull()), F.lit(False)).alias("null_timestamps"),
        F.coalesce(F.bool_or(F.col("_n") > 1), F.lit(False)).alias("duplicates"),
    )
    issues = [
        F.lit(f"Missing columns: {missing}") if missing else F.lit(None).cast("string"),
        F.when(F.col("null_timestamps"), "Timestamp contains null values."),
        F.when(F.col("duplicates"), f"Duplicate {'/'.join((S.SITE, S.TIMESTAMP, *tie_break))} combinations found."),
    ]
    if sequence is not None:
        unsorted = order_check(df, sequence, site, timestamp).agg(
            F.count_if("out_of_order").alias("n")
        )
        disorder = unsorted.select("n").scalar()
        found = found.withColumn("unsorted_sites", disorder)
        issues.append(
            F.when(F.col("unsorted_sites") > 0, F.concat("unsorted_sites", F.lit(" site(s) not sorted chronologically.")))
        )
    listed = found.withColumn("issues", F.array_compact(F.array(*issues)))
    return listed.withColumn("passed", F.size("issues") == 0)


def cross_split_duplicates(
    df: DataFrame, site: str = S.SITE, timestamp: str = S.TIMESTAMP, split: str = S.SPLIT
) -> DataFrame:
    """Keys present in both splits."""
    both = df.groupBy(site, timestamp).agg(
        F.bool_or(F.col(split) == S.TRAIN).alias("in_train"), F.bool_or(F.col(split) == S.UNSEEN).alias("in_unseen")
    )
    return both.where(F.col("in_train") & F.col("in_unseen")).select(site, timestamp)
