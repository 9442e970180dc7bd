"""Threshold labels, pressure scores and driver choices as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (label, ozone from, nitrogen dioxide from), highest first.
RISK_LEVELS = [("High risk", 140, 110), ("Elevated", 95, 70)]
CRITICAL_FACTOR = 1.2
# Air-quality-index tones, (from, tone), highest first.
PRESSURE_TONES = [(160, "severe"), (120, "high"), (80, "moderate")]
BAND_WIDTH = 1.96
STABLE_WITHIN = 5
ANOMALY_FACTOR = 1.35
ANOMALY_FLOOR_O3 = 95
ANOMALY_FLOOR_NO2 = 70
SEVERITY_WEIGHT = {"critical": 3, "warning": 2, "info": 1}


def known_or(value: Column, *others: Column) -> Column:
    """First value that is neither null nor zero (an ``a or b`` chain; the last option is taken as it is)."""
    options = [value, *others]
    return F.coalesce(*[F.nullif(option, F.lit(0.0)) for option in options[:-1]], options[-1])


def risk_label(o3: Column, no2: Column, middle: str = "Elevated") -> Column:
    label = F.lit("Stable")
    for name, o3_from, no2_from in reversed(RISK_LEVELS):
        text = middle if name == "Elevated" else name
        label = F.when((o3 >= o3_from) | (no2 >= no2_from), text).otherwise(label)
    return label


def alert_severity(value: Column, threshold: Column) -> Column:
    return F.when(value >= threshold * CRITICAL_FACTOR, "critical").otherwise("warning")


def severity_weight(severity: Column) -> Column:
    return (
        F.when(severity == "critical", SEVERITY_WEIGHT["critical"])
        .when(severity == "warning", SEVERITY_WEIGHT["warning"])
        .when(severity == "info", SEVERITY_WEIGHT["info"])
    )


def band(prediction: Column, sigma: Column) -> tuple[Column, Column]:
    """Lower and upper end of the 95 % band."""
    return prediction - BAND_WIDTH * sigma, prediction + BAND_WIDTH * sigma


def band_span(lower: Column, upper: Column) -> Column:
    return F.greatest(upper - lower, F.lit(0.0))


def aqi_pressure(us_aqi: Column, european_aqi: Column) -> Column:
    return F.greatest(F.coalesce(us_aqi, F.lit(0.0)), F.coalesce(european_aqi, F.lit(0.0)))


def pressure_tone(pressure: Column) -> Column:
    tone = F.lit("low")
    for start, name in reversed(PRESSURE_TONES):
        tone = F.when(pressure >= start, name).otherwise(tone)
    return tone


def shown_aqi(us_aqi: Column, european_aqi: Column) -> Column:
    return F.coalesce(us_aqi, european_aqi)


def trend_direction(current: Column, baseline: Column) -> Column:
    """Unknown without a baseline; an unknown current value reads 0."""
    delta = F.coalesce(current, F.lit(0.0)) - baseline
    return (
        F.when(baseline.isNull(), "unknown")
        .when(F.abs(delta) < STABLE_WITHIN, "stable")
        .when(delta > 0, "rising")
        .otherwise("falling")
    )


def strongest_driver(o3: Column, no2: Column, o3_baseline: Column, no2_baseline: Column) -> Column:
    """Pollutant farther from its baseline; without a baseline its own size counts. Unknown values read 0, ties go to O3."""
    o3, no2 = (F.coalesce(value, F.lit(0.0)) for value in (o3, no2))
    o3_distance = F.abs(o3 - F.coalesce(o3_baseline, F.lit(0.0)))
    no2_distance = F.abs(no2 - F.coalesce(no2_baseline, F.lit(0.0)))
    return F.when(o3_distance >= no2_distance, "O3").otherwise("NO2")


def pulse_score(o3: Column, no2: Column) -> Column:
    return o3 * 0.65 + no2 * 0.35


def anomaly_limit(mean: Column, floor: float) -> Column:
    return F.greatest(F.lit(float(floor)), F.coalesce(mean, F.lit(0.0)) * ANOMALY_FACTOR)


def leading_pollutant(o3_peak: Column, no2_peak: Column) -> Column:
    """Unknown peaks read 0, ties go to O3."""
    return F.when(F.coalesce(o3_peak, F.lit(0.0)) >= F.coalesce(no2_peak, F.lit(0.0)), "O3").otherwise("NO2")


def watch_driver(
    o3_now: Column, no2_now: Column, o3_avg: Column, no2_avg: Column, o3_peak: Column, no2_peak: Column
) -> Column:
    """Pollutant to watch while no alert is active."""
    zero = F.lit(0.0)
    o3_shift = F.abs(F.coalesce(o3_now - o3_avg, zero))
    no2_shift = F.abs(F.coalesce(no2_now - no2_avg, zero))
    o3_pressure = F.greatest(F.coalesce(o3_peak, zero), F.coalesce(o3_now, zero))
    no2_pressure = F.greatest(F.coalesce(no2_peak, zero), F.coalesce(no2_now, zero))
    return F.when(no2_shift > o3_shift, "NO2").when(o3_pressure >= no2_pressure, "O3").otherwise("NO2")
