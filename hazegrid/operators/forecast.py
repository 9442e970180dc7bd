"""Forecast tables: bands, lead hours, peaks, timeline, anomalies. Inputs hold all sites at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazegrid import schema as S
from hazegrid.functions import risk
from hazegrid.operators.series import latest_rows, top_rows

DEFAULT_HORIZON = 24
BASELINE_MODEL = "baseline_random_forest"
BASELINE_POINTS = 72
TIMELINE_LIVE_POINTS = 24


def horizon_or_default(horizon: int | None, default: int = DEFAULT_HORIZON) -> int:
    """0 and None both mean the default."""
    return horizon or default


def align_to_model(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns a model needs and the table lacks are added as 0.0."""
    absent = {name: F.lit(0.0) for name in columns if name not in df.columns}
    return df.withColumns(absent) if absent else df


def model_columns(metadata: dict, model: str) -> list[str]:
    """The model's own feature list, else the shared one."""
    own = metadata.get("model_feature_columns", {})
    return own.get(model, metadata.get("feature_columns", []))


def model_errors(errors: DataFrame, model: str, fallback: str | None = BASELINE_MODEL) -> DataFrame:
    """``(target, sigma)`` of one model; an unknown model takes the fallback's when there is one.

    ``errors`` has one row per (model, target).
    """
    names = [model] if fallback is None else [model, fallback]
    rank = F.when(F.col("model") == model, 0).otherwise(1)
    chosen = errors.where(F.col("model").isin(*names))
    return chosen.groupBy("target").agg(F.min_by("sigma", rank).alias("sigma"))


def with_bands(points: DataFrame, sigmas: DataFrame) -> DataFrame:
    """95 % band around ``o3`` and ``no2``; ``sigmas`` has one row per target, read as one value each."""

    def sigma(target: str):
        return sigmas.where(F.col("target") == target).agg(F.max("sigma").alias("s")).select("s").scalar()

    widths = points.withColumns({"_s_o3": sigma("O3_target"), "_s_no2": sigma("NO2_target")})
    o3_lower, o3_upper = risk.band(F.col("o3"), F.col("_s_o3"))
    no2_lower, no2_upper = risk.band(F.col("no2"), F.col("_s_no2"))
    return widths.withColumns(
        {"o3_lower": o3_lower, "o3_upper": o3_upper, "no2_lower": no2_lower, "no2_upper": no2_upper}
    ).drop("_s_o3", "_s_no2")


def passthrough_forecast(
    unseen: DataFrame,
    errors: DataFrame,
    model: str = BASELINE_MODEL,
    horizon: int | None = DEFAULT_HORIZON,
    o3: str = "O3_forecast",
    no2: str = "NO2_forecast",
    site: str = S.SITE,
    order: Sequence[str] = (S.TIMESTAMP,),
) -> DataFrame:
    """The last ``horizon`` input rows per site taken as the forecast, with bands from the model's errors."""
    tail = latest_rows(unseen, horizon_or_default(horizon), site, order)
    points = tail.select(site, *order, F.col(o3).alias("o3"), F.col(no2).alias("no2"), F.lit(model).alias("model_name"))
    return with_bands(points, model_errors(errors, model))


def lead_hours(points: DataFrame, site: str = S.SITE, order: Sequence[str] = (S.TIMESTAMP,)) -> DataFrame:
    """1-based hour within the forecast; a forecast holds ``horizon`` rows per site."""
    return points.withColumn("lead_hour", F.row_number().over(Window.partitionBy(site).orderBy(*order)))


def reanchor(forecast: DataFrame, live: DataFrame, site: str = S.SITE, timestamp: str = S.TIMESTAMP) -> DataFrame:
    """Forecast times counted from the site's last live time; sites without live data keep theirs."""
    anchors = live.groupBy(site).agg(F.max(timestamp).alias("_anchor"))
    shifted = F.col("_anchor") + F.make_dt_interval(hours=F.col("lead_hour"))
    return (
        forecast.join(anchors, site, "left")
        .withColumn(timestamp, F.coalesce(shifted, F.col(timestamp)))
        .drop("_anchor")
    )


def peaks(forecast: DataFrame, site: str = S.SITE) -> DataFrame:
    """Highest ozone and nitrogen dioxide per site with their lead hours, the earliest on ties."""
    found = {}
    for name in ("o3", "no2"):
        found[name] = F.max(F.struct(F.col(name).alias("value"), (-F.col("lead_hour")).alias("back")))
    best = forecast.groupBy(site).agg(found["o3"].alias("_o3"), found["no2"].alias("_no2"))
    return best.select(
        site,
        F.col("_o3.value").alias("peak_o3"),
        (-F.col("_o3.back")).alias("peak_o3_hour"),
        F.col("_no2.value").alias("peak_no2"),
        (-F.col("_no2.back")).alias("peak_no2_hour"),
    )


def pulse(forecast: DataFrame, n: int = 4, site: str = S.SITE) -> DataFrame:
    """The ``n`` strongest hours by combined pressure, the earlier first on ties."""
    scored = forecast.withColumn("score", risk.pulse_score(F.col("o3"), F.col("no2")))
    scored = scored.withColumn("severity", risk.risk_label(F.col("o3"), F.col("no2")))
    return top_rows(scored, [site], [F.desc("score"), F.asc("lead_hour")], n, ["lead_hour"], rank="pulse_rank")


def timeline(
    live: DataFrame, forecast: DataFrame, live_points: int = TIMELINE_LIVE_POINTS, site: str = S.SITE
) -> DataFrame:
    """Last live points, then forecast points, with their phase."""
    columns = [site, S.TIMESTAMP, "o3", "no2"]
    past = latest_rows(live, live_points, site).select(*columns, F.lit("live").alias("phase"))
    return past.unionByName(forecast.select(*columns, F.lit("forecast").alias("phase")))


def anomalies(
    historical: DataFrame,
    live: DataFrame,
    points: int = 24,
    site: str = S.SITE,
    order: Sequence[str] = (S.TIMESTAMP,),
) -> DataFrame:
    """Observed points far above their own mean, per pollutant; at most ``2 * points`` rows per site go in."""
    columns = [site, *order, "o3", "no2"]
    seen = latest_rows(historical, points, site, order).select(*columns, F.lit(0).alias("phase_rank"))
    seen = seen.unionByName(latest_rows(live, points, site, order).select(*columns, F.lit(1).alias("phase_rank")))
    whole = Window.partitionBy(site)
    limits = seen.withColumns(
        {
            "_o3_limit": risk.anomaly_limit(F.avg("o3").over(whole), risk.ANOMALY_FLOOR_O3),
            "_no2_limit": risk.anomaly_limit(F.avg("no2").over(whole), risk.ANOMALY_FLOOR_NO2),
        }
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(label).alias("pollutant"),
                F.lit(rank).alias("pollutant_rank"),
                F.col(name).alias("value"),
                F.col(f"_{name}_limit").alias("limit"),
            )
            for rank, (label, name) in enumerate([("O3", "o3"), ("NO2", "no2")])
        ]
    )
    return limits.select(site, *order, "phase_rank", F.inline(cells)).where(F.col("value") > F.col("limit"))


def last_anomalies(found: DataFrame, n: int = 8, site: str = S.SITE, order: Sequence[str] = (S.TIMESTAMP,)) -> DataFrame:
    """The last ``n`` anomalies per site: historical before live, by time, ozone first."""
    newest = [F.desc("phase_rank"), *[F.desc(name) for name in order], F.desc("pollutant_rank")]
    return top_rows(found, [site], newest, n, [*order, "pollutant"])


def baseline_averages(
    history: DataFrame, points: int = BASELINE_POINTS, site: str = S.SITE, order: Sequence[str] = (S.TIMESTAMP,)
) -> DataFrame:
    """Mean over the last points of each site."""
    tail = latest_rows(history, points, site, order)
    return tail.groupBy(site).agg(F.avg("o3").alias("o3_avg"), F.avg("no2").alias("no2_avg"))


def baseline_deltas(current: DataFrame, baseline: DataFrame, site: str = S.SITE) -> DataFrame:
    """Now minus baseline; null when either side is missing."""
    return current.join(baseline, site, "left").select(
        site,
        (F.col("o3") - F.col("o3_avg")).alias("o3_delta"),
        (F.col("no2") - F.col("no2_avg")).alias("no2_delta"),
    )


def history_stats(
    history: DataFrame, points: int, site: str = S.SITE, order: Sequence[str] = (S.TIMESTAMP,), sites: DataFrame | None = None
) -> DataFrame:
    """Count, mean, maximum and span of the last points per site; sites without any get count 0."""
    stats = (
        latest_rows(history, points, site, order)
        .groupBy(site)
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.avg("o3").alias("avg_o3"),
            F.avg("no2").alias("avg_no2"),
            F.max("o3").alias("max_o3"),
            F.max("no2").alias("max_no2"),
            F.min(order[0]).alias("first_timestamp"),
            F.max(order[0]).alias("last_timestamp"),
        )
    )
    if sites is None:
        return stats
    return sites.select(site).join(stats, site, "left").fillna({"count": 0})
