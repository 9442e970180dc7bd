"""Ordered per-site series without a whole site in one task.

Two cases are kept apart:

* A *unique hourly* table has at most one row per site and hour (8,784 per year), so a window over one site
  is bounded by the calendar. Those operators partition a window by site directly.
* An *irregular* table may hold any share of its rows under one site. ``index_rows`` numbers them with one
  range sort, which splits on ``(site, time, tie-break)`` and so never needs a site in one task, and
  ``frames`` cuts each site into row blocks of a fixed size, with the preceding rows a bounded frame needs
  copied in. Windows then partition by ``(site, block)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazegrid.session import materialize

ROW = "_row"
ROWS = "_rows"
BLOCK = "_block"
OWN = "_own"

DEFAULT_BLOCK_ROWS = 50_000

# monotonically_increasing_id keeps the partition number above bit 33.
_PARTITION_SHIFT = 33


def index_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``_row`` (0-based position in its series by ``order``) and ``_rows`` (series length).

    ``order`` must be unique within a series. The sorted table is written once: positions come from the
    task layout and must not be computed again after a loss. Only one line per (series, sort partition)
    is joined back.
    """
    keys, order = list(keys), list(order)
    position, part = "_pos", "_part"
    ordered = materialize(
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn(position, F.monotonically_increasing_id()),
        "ordered",
    ).withColumn(part, F.shiftright(position, _PARTITION_SHIFT))
    by_series = Window.partitionBy(*keys)
    runs = ordered.groupBy(*keys, part).agg(
        F.min(position).alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    runs = materialize(
        runs.select(
            *[F.col(key).alias(f"_k_{key}") for key in keys],
            F.col(part).alias("_k_part"),
            (
                F.coalesce(
                    F.sum("_n").over(by_series.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)),
                    F.lit(0),
                )
                - F.col("_first")
            ).alias("_shift"),
            F.sum("_n").over(by_series).alias(ROWS),
        ),
        "runs",
    )
    match = F.col(part) == F.col("_k_part")
    for key in keys:
        match &= F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    return (
        ordered.join(runs, match)
        .withColumn(ROW, F.col(position) + F.col("_shift"))
        .drop(position, part, "_shift", "_k_part", *[f"_k_{key}" for key in keys])
    )


def frames(indexed: DataFrame, block_rows: int, halo: int) -> DataFrame:
    """Cut each series into blocks of ``block_rows`` rows; ``halo`` rows of a block also join the next one.

    Adds ``_block`` and ``_own`` (false for the copied rows, to be dropped after the window).
    """
    if not 0 <= halo < block_rows:
        raise ValueError(f"halo {halo} must be below block_rows {block_rows}")
    own = F.floor(F.col(ROW) / block_rows)
    if halo == 0:
        return indexed.withColumn(BLOCK, own).withColumn(OWN, F.lit(True))
    near_end = F.col(ROW) % block_rows >= block_rows - halo
    has_next = (own + 1) * block_rows < F.col(ROWS)
    targets = F.when(near_end & has_next, F.array(own, own + 1)).otherwise(F.array(own))
    return indexed.withColumn(BLOCK, F.explode(targets)).withColumn(OWN, F.col(BLOCK) == own)


def block_carries(
    indexed: DataFrame, keys: Sequence[str], columns: Sequence[str], block_rows: int, halo: int
) -> DataFrame:
    """Per (series, block): last known value before the block's copied rows, first known value after it.

    Each block is summed up in two parts, head and the tail that is copied ahead, because a copied row
    must look for its own past beyond the copy. The result has one line per block.
    """
    keys = list(keys)
    block = F.floor(F.col(ROW) / block_rows)
    in_tail = (F.col(ROW) % block_rows >= block_rows - halo).cast("int") if halo else F.lit(0)
    known = []
    for column in columns:
        at = F.when(F.col(column).isNotNull(), F.col(ROW))
        known += [F.max_by(column, at).alias(f"_last_{column}"), F.min_by(column, at).alias(f"_first_{column}")]
    parts = indexed.groupBy(*keys, (block * 2 + in_tail).alias("_part")).agg(*known)
    ordered = Window.partitionBy(*keys).orderBy("_part")
    through = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A frame growing from the far end; a shrinking frame would be computed anew for every row.
    onward = Window.partitionBy(*keys).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heads = parts.select(
        *keys,
        "_part",
        *[F.last(f"_last_{c}", ignorenulls=True).over(through).alias(f"_before_{c}") for c in columns],
        *[F.last(f"_first_{c}", ignorenulls=True).over(onward).alias(f"_after_{c}") for c in columns],
    ).where(F.col("_part") % 2 == 0)
    return heads.select(
        *keys,
        F.floor(F.col("_part") / 2).alias(BLOCK),
        *[F.lag(f"_before_{c}").over(ordered).alias(f"_before_{c}") for c in columns],
        *[F.lead(f"_after_{c}").over(ordered).alias(f"_after_{c}") for c in columns],
    )


def top_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    spread_on: Sequence[str],
    spread: int = 16,
    rank: str | None = None,
) -> DataFrame:
    """First ``n`` rows per key by ``order``, in two rounds so that a hot key is shared out.

    Round one keeps ``n`` rows per (key, hash of ``spread_on``), and Spark already limits each group before
    the shuffle; round two sees at most ``spread * n`` rows per key.
    """
    salt = F.pmod(F.xxhash64(*spread_on), F.lit(spread))
    place = rank or "_place"
    first = Window.partitionBy(*keys, salt).orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    kept = df.withColumn(place, F.row_number().over(first)).where(F.col(place) <= n)
    kept = kept.withColumn(place, F.row_number().over(final)).where(F.col(place) <= n)
    return kept if rank else kept.drop(place)


def latest_rows(
    df: DataFrame, n: int, site: str = "site_id", order: Sequence[str] = ("timestamp",), **options
) -> DataFrame:
    """The last ``n`` rows of every site (all sites in one job)."""
    return top_rows(df, [site], [F.desc(name) for name in order], n, list(order), **options)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row of every key; ``order`` ends with a unique tie-break. Unknown order values count as oldest.

    One shuffle of one row per key and task: rows are combined before it, so a hot key is no problem.
    """
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_newest"))
    return newest.select("_newest.*")


def nest_points(
    df: DataFrame, fields: Sequence[str], site: str = "site_id", order: str = "timestamp", into: str = "points"
) -> DataFrame:
    """Rows to one sorted ``points[]`` array per site, for inputs already bounded per site."""
    point = F.struct(order, *[field for field in fields if field != order])
    return df.groupBy(site).agg(F.sort_array(F.collect_list(point)).alias(into))


def nest_pages(
    df: DataFrame, keys: Sequence[str], sequence: str, fields: Sequence[str], page_rows: int = 500, into: str = "points"
) -> DataFrame:
    """Like ``nest_points`` for series of any length: one array per (key, page).

    ``sequence`` is unique within a key, so a page holds at most ``page_rows`` elements.
    """
    page = F.floor(F.col(sequence) / page_rows).alias("page")
    point = F.struct(sequence, *[field for field in fields if field != sequence])
    return df.groupBy(*keys, page).agg(F.sort_array(F.collect_list(point)).alias(into))
