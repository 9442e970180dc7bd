"""Calendar columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def hourly_timestamp(year: str, month: str, day: str, hour: str) -> Column:
    """Zone-free timestamp from whole or fractional parts; fractions are cut off."""
    parts = [F.col(name).cast("int") for name in (year, month, day, hour)]
    return F.make_timestamp_ntz(*parts, F.lit(0), F.lit(0))


def cyclic_hour(hour: Column) -> tuple[Column, Column]:
    angle = hour * (2 * math.pi) / 24.0
    return F.sin(angle), F.cos(angle)


def cyclic_day_of_year(timestamp: Column) -> tuple[Column, Column]:
    angle = F.dayofyear(timestamp) * (2 * math.pi) / 366.0
    return F.sin(angle), F.cos(angle)


def is_weekend(timestamp: Column) -> Column:
    return F.weekday(timestamp).isin(5, 6).cast("int")


def calendar_columns(timestamp: str = "timestamp") -> dict[str, Column]:
    at = F.col(timestamp)
    hour_sin, hour_cos = cyclic_hour(F.hour(at))
    doy_sin, doy_cos = cyclic_day_of_year(at)
    return {
        "hour_sin": hour_sin,
        "hour_cos": hour_cos,
        "doy_sin": doy_sin,
        "doy_cos": doy_cos,
        "is_weekend": is_weekend(at),
    }


def iso_text(timestamp: Column) -> Column:
    """ISO text to the second, with microseconds only when there are any."""
    whole = F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(timestamp, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat_ws(".", whole, micros))
