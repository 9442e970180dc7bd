"""Threshold alerts and what is read from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid import schema as S
from hazegrid.functions import risk
from hazegrid.operators.series import top_rows

O3_THRESHOLD = 100.0
NO2_THRESHOLD = 80.0


def exceedances(df: DataFrame, o3_threshold: float = O3_THRESHOLD, no2_threshold: float = NO2_THRESHOLD) -> DataFrame:
    """Rows at or above either threshold."""
    return df.where((F.col("o3") >= o3_threshold) | (F.col("no2") >= no2_threshold))


def _candidate(name: str, rank: int, value: str, threshold: float):
    return F.struct(
        F.lit(name).alias("pollutant"),
        F.lit(rank).alias("pollutant_rank"),
        F.lit(f"Projected {name} spike exceeds configured threshold.").alias("message"),
        F.col(value).alias("value"),
        F.lit(float(threshold)).alias("threshold"),
    )


def threshold_alerts(
    points: DataFrame,
    o3_threshold: float = O3_THRESHOLD,
    no2_threshold: float = NO2_THRESHOLD,
    site: str = S.SITE,
    timestamp: str = S.TIMESTAMP,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per site, time and pollutant at or above its threshold. Stateless, so it also runs on streams.

    ``keep`` names further columns of the points to carry along.
    """
    both = F.array(_candidate("O3", 0, "o3", o3_threshold), _candidate("NO2", 1, "no2", no2_threshold))
    rows = points.select(site, timestamp, *keep, F.inline(both)).where(F.col("value") >= F.col("threshold"))
    return rows.withColumn("severity", risk.alert_severity(F.col("value"), F.col("threshold")))


def ordered_alerts(alerts: DataFrame, site: str = S.SITE, timestamp: str = S.TIMESTAMP) -> DataFrame:
    """By time, then site, ozone first."""
    return alerts.orderBy(timestamp, site, "pollutant_rank")


def forecast_alerts(
    points: DataFrame,
    o3_threshold: float = O3_THRESHOLD,
    no2_threshold: float = NO2_THRESHOLD,
    site: str = S.SITE,
    order: Sequence[str] = (S.TIMESTAMP,),
) -> DataFrame:
    """Alerts of a forecast of all sites (``site, *order, o3, no2, model_name``), to be listed with ``ordered_alerts``.

    The model's name and the order columns of the point stay beside each alert.
    """
    return threshold_alerts(points, o3_threshold, no2_threshold, site, order[0], [*order[1:], "model_name"])


def severity_counts(alerts: DataFrame, sites: DataFrame | None = None, site: str = S.SITE) -> DataFrame:
    """Alerts per severity and site; with ``sites`` also for sites that have none."""
    counted = alerts.groupBy(site).agg(
        *[F.count_if(F.col("severity") == name).alias(name) for name in risk.SEVERITY_WEIGHT]
    )
    if sites is None:
        return counted
    return sites.select(site).join(counted, site, "left").fillna(0, list(risk.SEVERITY_WEIGHT))


def lead_alert(alerts: DataFrame, n: int = 1, site: str = S.SITE, timestamp: str = S.TIMESTAMP) -> DataFrame:
    """Most severe alert per site, earliest on ties."""
    order = [F.desc(risk.severity_weight(F.col("severity"))), F.asc(timestamp), F.asc("pollutant_rank")]
    return top_rows(alerts, [site], order, n, [timestamp, "pollutant"])


def first_alerts(alerts: DataFrame, n: int, site: str = S.SITE, timestamp: str = S.TIMESTAMP) -> DataFrame:
    """The first ``n`` alerts per site in time order (the caps of the alert list and of the evidence text)."""
    order = [F.asc(timestamp), F.asc("pollutant_rank")]
    return top_rows(alerts, [site], order, n, [timestamp, "pollutant"], rank="place")


def highest_alert(alerts: DataFrame, site: str = S.SITE, timestamp: str = S.TIMESTAMP) -> DataFrame:
    """Highest value per site, the first one on ties."""
    order = [F.desc("value"), F.asc(timestamp), F.asc("pollutant_rank")]
    return top_rows(alerts, [site], order, 1, [timestamp, "pollutant"])
