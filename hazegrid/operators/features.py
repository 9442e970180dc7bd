"""Feature table: calendar, sparse flags and fills, lags, rolling statistics, completeness filter.

All per-site windows of one table share a partitioning and an order, so they cost one shuffle and one sort.
Columns are added in a few wide selects, never one by one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazegrid import schema as S
from hazegrid.functions.calendar import calendar_columns
from hazegrid.operators import series


@dataclass(frozen=True)
class FeatureSpec:
    """What to derive, and how the rows are keyed."""

    site: str = S.SITE
    timestamp: str = S.TIMESTAMP
    tie_break: Sequence[str] = (S.SPLIT,)
    lag_columns: Sequence[str] = (*S.FORECAST_COLUMNS, *S.EXTERNAL_COLUMNS)
    sparse_columns: Sequence[str] = (*S.SATELLITE_COLUMNS, *S.EXTERNAL_COLUMNS)
    targets: Sequence[str] = tuple(S.TARGET_COLUMNS)
    lookback: int = S.MAX_LOOKBACK
    windows: Sequence[int] = tuple(S.ROLLING_WINDOWS)
    causal: bool = False
    require_external_match: bool = True
    # None: one window per site, for unique hourly tables. A number: row blocks of that size.
    block_rows: int | None = series.DEFAULT_BLOCK_ROWS
    split: str = S.SPLIT
    excluded: Sequence[str] = field(default=tuple(S.NON_FEATURE_COLUMNS))

    @property
    def order(self) -> list[str]:
        return [self.timestamp, *self.tie_break]


def lag_steps(lookback: int) -> list[int]:
    return sorted({*S.LAG_STEPS, min(lookback, S.MAX_LOOKBACK)})


def missing_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``<column>_missing`` 0/1 for those of ``columns`` the table has; to be taken before any fill."""
    present = [name for name in columns if name in df.columns]
    return df.select("*", *[F.col(name).isNull().cast("int").alias(f"{name}_missing") for name in present])


def lag_expressions(columns: Sequence[str], steps: Sequence[int], ordered) -> list[Column]:
    return [
        F.lag(name, step).over(ordered).alias(f"{name}_lag_{step}") for name in columns for step in steps
    ]


def rolling_mean_expressions(columns: Sequence[str], windows: Sequence[int], ordered) -> list[Column]:
    """Mean of the previous ``w`` rows, the current one left out."""
    return [
        F.avg(name).over(ordered.rowsBetween(-w, -1)).alias(f"{name}_roll_mean_{w}")
        for name in columns
        for w in windows
    ]


def rolling_std_expressions(columns: Sequence[str], windows: Sequence[int], ordered) -> list[Column]:
    """Sample deviation of the previous ``w`` rows; 0 where it is undefined."""
    return [
        F.coalesce(F.stddev_samp(name).over(ordered.rowsBetween(-w, -1)), F.lit(0.0)).alias(f"{name}_roll_std_{w}")
        for name in columns
        for w in windows
    ]


def _fill(name: str, ordered, reverse, causal: bool, carried: bool) -> Column:
    """Both directions run as growing frames: a frame that shrinks is computed anew for every row."""
    back = F.last(name, ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.last(name, ignorenulls=True).over(reverse.rowsBetween(Window.unboundedPreceding, 0))
    options = [back] + ([F.col(f"_before_{name}")] if carried else [])
    if not causal:
        options += [ahead] + ([F.col(f"_after_{name}")] if carried else [])
    return F.coalesce(*options, F.lit(0.0))


def windowed(df: DataFrame, spec: FeatureSpec, halo: int, fill: Sequence[str] = ()):
    """Prepare a table for per-site windows; returns the rows, the window both ways, and if rows are in blocks."""
    if spec.block_rows is None:
        whole = Window.partitionBy(spec.site)
        return df, whole.orderBy(*spec.order), whole.orderBy(*[F.desc(name) for name in spec.order]), False
    if series.ROW not in df.columns:
        df = series.index_rows(df, [spec.site], spec.order)
    rows = series.frames(df, spec.block_rows, halo)
    if fill:
        carries = series.block_carries(df, [spec.site], fill, spec.block_rows, halo)
        rows = rows.join(carries, [spec.site, series.BLOCK], "left")
    blocks = Window.partitionBy(spec.site, series.BLOCK)
    return rows, blocks.orderBy(series.ROW), blocks.orderBy(F.desc(series.ROW)), True


def _settle(df: DataFrame, blocked: bool) -> DataFrame:
    if not blocked:
        return df
    helpers = [c for c in df.columns if c.startswith(("_before_", "_after_"))]
    return df.where(series.OWN).drop(series.OWN, series.BLOCK, series.ROW, series.ROWS, *helpers)


def add_window_features(
    df: DataFrame,
    spec: FeatureSpec,
    lags: bool = True,
    means: bool = True,
    deviations: bool = True,
) -> DataFrame:
    """Sparse fill first, then lags and rolling statistics of the (filled) lag columns."""
    sparse = [name for name in spec.sparse_columns if name in df.columns]
    lagged = [name for name in spec.lag_columns if name in df.columns]
    steps = lag_steps(spec.lookback) if lags else []
    widths = list(spec.windows) if means or deviations else []
    halo = max([0, *steps, *widths]) if lagged else 0
    rows, ordered, reverse, blocked = windowed(df, spec, halo, sparse)
    if sparse:
        rows = rows.withColumns({name: _fill(name, ordered, reverse, spec.causal, blocked) for name in sparse})
    added: list[Column] = []
    if lags:
        added += lag_expressions(lagged, steps, ordered)
    if means:
        added += rolling_mean_expressions(lagged, spec.windows, ordered)
    if deviations:
        added += rolling_std_expressions(lagged, spec.windows, ordered)
    return _settle(rows.select("*", *added) if added else rows, blocked)


def fill_sparse(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Forward fill, backward fill, then 0, per site."""
    return add_window_features(df, spec, lags=False, means=False, deviations=False)


def keep_complete(df: DataFrame, targets: Sequence[str] = (), split: str = S.SPLIT) -> DataFrame:
    """Rows with every non-target column known, and every target known unless the row is unseen."""
    targets = [name for name in targets if name in df.columns]
    keep = F.lit(True)
    for name in df.columns:
        if name not in targets:
            keep &= F.col(name).isNotNull()
    if targets:
        known = F.lit(True)
        for name in targets:
            known &= F.col(name).isNotNull()
        unseen = F.col(split) == S.UNSEEN if split in df.columns else F.lit(False)
        keep &= known | unseen
    return df.where(keep)


def feature_columns(
    df: DataFrame, targets: Sequence[str] = (), excluded: Sequence[str] = tuple(S.NON_FEATURE_COLUMNS)
) -> list[str]:
    """Numeric columns that are neither excluded nor a target, in table order."""
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in excluded and f.name not in targets
    ]


def build_features(df: DataFrame, spec: FeatureSpec = FeatureSpec()) -> DataFrame:
    """The whole feature table. Lags run over train and unseen rows together; split afterwards."""
    timed = missing_flags(df.withColumns(calendar_columns(spec.timestamp)), spec.sparse_columns)
    wide = add_window_features(timed, spec)
    if not spec.require_external_match and "data_source" in wide.columns:
        return keep_complete(wide.fillna({"data_source": "none"}), spec.targets, spec.split)
    return keep_complete(wide, spec.targets, spec.split)


def split_rows(df: DataFrame, name: str, split: str = S.SPLIT) -> DataFrame:
    return df.where(F.col(split) == name)


def chronological_split(
    df: DataFrame,
    validation_fraction: float,
    test_fraction: float,
    site: str = S.SITE,
    order: Sequence[str] = (S.TIMESTAMP, S.SPLIT),
    label: str = "part",
    keep_rows: bool = False,
) -> DataFrame:
    """Label rows train / validation / test by position in their site, without a window over a site.

    With ``keep_rows`` every row also keeps its position and count within its own part, so that windows over a
    whole part need no second sort.
    """
    indexed = df if series.ROW in df.columns else series.index_rows(df, [site], order)
    test_start = F.floor(F.col(series.ROWS) * F.lit(1 - test_fraction))
    valid_start = F.floor(F.col(series.ROWS) * F.lit(1 - test_fraction - validation_fraction))
    part = (
        F.when(F.col(series.ROW) < valid_start, "train")
        .when(F.col(series.ROW) < test_start, "validation")
        .otherwise("test")
    )
    labelled = indexed.withColumn(label, part)
    if not keep_rows:
        return labelled.drop(series.ROW, series.ROWS)
    start = F.when(part == "train", F.lit(0)).when(part == "validation", valid_start).otherwise(test_start)
    end = F.when(part == "train", valid_start).when(part == "validation", test_start).otherwise(F.col(series.ROWS))
    return labelled.withColumns({series.ROW: F.col(series.ROW) - start, series.ROWS: end - start})


def sequences(
    df: DataFrame, columns: Sequence[str], length: int, spec: FeatureSpec, into: str = "sequence"
) -> DataFrame:
    """For each row with ``length`` predecessors: their feature vectors, oldest first, the row left out."""
    rows, ordered, _, blocked = windowed(df, spec, length)
    vector = F.array(*[F.col(name).cast("double") for name in columns])
    history = F.collect_list(vector).over(ordered.rowsBetween(-length, -1))
    rows = rows.withColumn(into, history).where(F.size(into) == length)
    return _settle(rows, blocked)


def latest_context(
    df: DataFrame,
    columns: Sequence[str],
    length: int,
    site: str = S.SITE,
    order: Sequence[str] = (S.TIMESTAMP, S.SPLIT),
    into: str = "sequence",
) -> DataFrame:
    """The last ``length`` feature vectors of each site, oldest first."""
    tail = series.latest_rows(df, length, site, order)
    point = F.struct(*order, F.array(*[F.col(name).cast("double") for name in columns]).alias("vector"))
    nested = tail.groupBy(site).agg(F.sort_array(F.collect_list(point)).alias("_points"))
    return nested.select(site, F.col("_points.vector").alias(into)).where(F.size(into) == length)
