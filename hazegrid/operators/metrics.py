"""Regression metrics, residual spread, model choice, exact medians."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazegrid.session import materialize

MEDIAN_ACCURACY = 10_000
MEDIAN_BUCKETS = 4096


def regression_metrics(
    pairs: DataFrame, group: Sequence[str] = ("model", "target"), truth: str = "truth", prediction: str = "prediction"
) -> DataFrame:
    """RMSE, MAE, R2 and the refined index of agreement per group, over pairs that are known on both sides.

    Groups without any complete pair give no row; ``incomplete_pairs`` counts what was left out. Two passes, both with partial sums before the shuffle: the mean of the truth per group (written, so the
    planner knows its size when it is joined back), then everything else. R2 of a constant truth is 1 when
    the prediction is exact and 0 otherwise; R2 of a single row is null.
    """
    group = list(group)
    pairs = pairs.where(F.col(truth).isNotNull() & F.col(prediction).isNotNull())
    means = materialize(pairs.groupBy(*group).agg(F.avg(truth).alias("_mean")), "means")
    error = F.col(prediction) - F.col(truth)
    centred = pairs.join(means, group) if group else pairs.withColumn("_mean", means.select("_mean").scalar())
    sums = centred.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(error * error).alias("_sse"),
        F.sum(F.abs(error)).alias("_sae"),
        F.sum((F.col(truth) - F.col("_mean")) ** 2).alias("_sst"),
        F.sum(F.abs(F.col(truth) - F.col("_mean"))).alias("_spread"),
    )
    r2 = (
        F.when(F.col("_n") < 2, F.lit(None).cast("double"))
        .when(F.col("_sst") > 0, 1 - F.col("_sse") / F.nullif("_sst", F.lit(0.0)))
        .otherwise(F.when(F.col("_sse") == 0, 1.0).otherwise(0.0))
    )
    ratio = F.col("_sae") / F.nullif(2 * F.col("_spread"), F.lit(0.0))
    agreement = (
        F.when(F.col("_spread") == 0, 1.0)
        .when(ratio <= 1, 1 - ratio)
        .otherwise(1 / F.nullif(ratio, F.lit(0.0)) - 1)
    )
    return sums.select(
        *group,
        F.sqrt(F.col("_sse") / F.col("_n")).alias("rmse"),
        (F.col("_sae") / F.col("_n")).alias("mae"),
        r2.alias("r2"),
        agreement.alias("ria"),
    )


def incomplete_pairs(
    pairs: DataFrame, group: Sequence[str] = ("model", "target"), truth: str = "truth", prediction: str = "prediction"
) -> DataFrame:
    """Rows per group whose truth or prediction is unknown: what the metrics leave out."""
    unknown = F.col(truth).isNull() | F.col(prediction).isNull()
    return pairs.groupBy(*group).agg(F.count_if(unknown).alias("incomplete"))


def residual_spread(
    pairs: DataFrame, group: Sequence[str] = ("target",), truth: str = "truth", prediction: str = "prediction"
) -> DataFrame:
    """Population deviation of truth minus prediction."""
    return pairs.groupBy(*group).agg(F.stddev_pop(F.col(truth) - F.col(prediction)).alias("sigma"))


def active_model(metrics: DataFrame, listing: str = "listing") -> DataFrame:
    """The model with the lowest mean RMSE over its targets; the first listed one wins ties."""
    averaged = metrics.groupBy("model").agg(F.avg("rmse").alias("rmse"), F.min(listing).alias(listing))
    best = averaged.agg(F.min_by("model", F.struct("rmse", listing)).alias("model"), F.min("rmse").alias("rmse"))
    return best.where(F.col("model").isNotNull())


def _with_brackets(df: DataFrame, columns: Sequence[str], group: Sequence[str]) -> DataFrame:
    """``df`` with ``_near``: per column its count and a bracket that must hold the middle of its group."""
    half = 3.0 / MEDIAN_ACCURACY
    sketched = []
    for i, name in enumerate(columns):
        value = F.col(name).cast("double")
        near = F.percentile_approx(value, [0.5 - half, 0.5 + half], MEDIAN_ACCURACY)
        sketched.append(F.struct(F.count(value).alias("n"), F.get(near, F.lit(0)).alias("low"), F.get(near, F.lit(1)).alias("high")).alias(f"_{i}"))
    brackets = materialize(df.groupBy(*group).agg(F.struct(*sketched).alias("_near")), "brackets")
    if not group:
        return df.withColumn("_near", brackets.select("_near").scalar())
    known = brackets.select(*[F.col(name).alias(f"_g_{name}") for name in group], "_near")
    same = functools.reduce(operator.and_, [F.col(name).eqNullSafe(F.col(f"_g_{name}")) for name in group])
    return df.join(known, same).drop(*[f"_g_{name}" for name in group])


def _inside(wide: DataFrame, columns: Sequence[str], group: Sequence[str]) -> DataFrame:
    """A row per cell inside its bracket."""
    cells = []
    for i, name in enumerate(columns):
        value, near = F.col(name).cast("double"), F.col("_near")[f"_{i}"]
        cell = F.struct(F.lit(name).alias("column"), near["n"].alias("n"), near["low"].alias("low"), near["high"].alias("high"), value.alias("value"))
        cells.append(F.when(value.between(near["low"], near["high"]), cell))
    return wide.select(*group, F.explode(F.array_compact(F.array(*cells))).alias("c")).select(*group, "c.*")


def exact_medians(df: DataFrame, columns: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Exact median (mean of the two middle values) per column and group, as ``(group, column, median)``.

    The built-in exact median keeps every distinct value of a group in one buffer. Here a mergeable sketch
    first gives a narrow bracket that must hold the middle (three times its own error to either side). Rows stay
    wide: what lies below each column's bracket is counted by one aggregate over the wide row, and only cells
    inside a bracket become rows of their own, to be counted by value. Among those only the buckets around the
    middle are sorted.
    """
    group, columns = list(group), list(columns)
    keys = [*group, "column"]
    wide = _with_brackets(df, columns, group)
    inside = _inside(wide, columns, group)
    share = (F.col("value") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    bucket = F.coalesce(F.floor(share * MEDIAN_BUCKETS), F.lit(0)).cast("bigint")
    counts = inside.groupBy(*keys, "n", bucket.alias("_bucket"), F.col("value").alias("_value")).agg(F.count(F.lit(1)).alias("_count"))
    # Everything below a bracket is one line per key; its place is before bucket 0.
    below = []
    for i, name in enumerate(columns):
        near = F.col("_near")[f"_{i}"]
        under = F.count_if(F.col(name).cast("double") < near["low"]).alias("count")
        below.append(F.struct(F.lit(name).alias("column"), F.max(near["n"]).alias("n"), under))
    under = wide.groupBy(*group).agg(F.array(*below).alias("_cells")).select(*group, F.inline("_cells")).where("count > 0")
    under = under.select(*keys, "n", F.lit(-1).cast("bigint").alias("_bucket"), F.lit(None).cast("double").alias("_value"), F.col("count").alias("_count"))
    counts = materialize(counts.union(under), "median-counts")
    by_key = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    lower, upper = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    buckets = (
        counts.groupBy(*keys, "n", "_bucket")
        .agg(F.sum("_count").alias("_in"))
        .withColumn("_through", F.sum("_in").over(by_key))
        .where((F.col("_through") >= lower) & (F.col("_through") - F.col("_in") < upper))
        .select(*keys, "_bucket", (F.col("_through") - F.col("_in")).alias("_before"))
    )
    by_bucket = Window.partitionBy(*keys, "_bucket").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.join(buckets, [*keys, "_bucket"]).withColumn(
        "_through", F.sum("_count").over(by_bucket) + F.col("_before")
    )
    covers = [
        F.max(F.when((F.col("_through") >= at) & (F.col("_through") - F.col("_count") < at), F.col("_value")))
        for at in (lower, upper)
    ]
    return ranked.groupBy(*keys).agg(covers[0].alias("_a"), covers[1].alias("_b")).select(
        *keys, ((F.col("_a") + F.col("_b")) / 2).alias("median")
    )
