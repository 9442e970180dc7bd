"""Median imputation and standardisation as a savable pipeline stage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid.operators.metrics import exact_medians

SCALED = "_z_"


def column_statistics(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float, float]]:
    """``column -> (median, mean, deviation)``; mean and population deviation hold after imputation.

    Two jobs over the table; what reaches the driver is three numbers per column.
    """
    medians = {row["column"]: row["median"] for row in exact_medians(df, columns).collect()}
    return _spread(df, columns, medians)


def mean_and_deviation(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """``column -> (mean, population deviation)`` of the known values; one job."""
    return {name: (mean, deviation) for name, (_, mean, deviation) in _spread(df, columns, None).items()}


def _spread(df: DataFrame, columns: Sequence[str], medians: dict[str, float] | None):
    def value(name: str):
        known = F.col(name).cast("double")
        return known if medians is None else F.coalesce(known, F.lit(medians.get(name, 0.0)))

    cells = [
        F.struct(F.lit(name).alias("column"), F.avg(value(name)).alias("mean"), F.stddev_pop(value(name)).alias("deviation"))
        for name in columns
    ]
    found = df.agg(F.array(*cells).alias("cells")).first()["cells"]
    centres = medians or {}
    return {
        cell["column"]: (centres.get(cell["column"], 0.0), cell["mean"] or 0.0, cell["deviation"] or 0.0) for cell in found
    }


def scale_stage(statistics: dict[str, tuple[float, float, float]]) -> SQLTransformer:
    """Adds ``_z_<column>`` per column; a constant column becomes 0."""
    scaled = []
    for name, (median, mean, deviation) in statistics.items():
        value = f"coalesce(CAST(`{name}` AS DOUBLE), {median!r}D) - {mean!r}D"
        scaled.append(f"({value}) / {deviation or 1.0!r}D AS `{SCALED}{name}`")
    return SQLTransformer(statement=f"SELECT *, {', '.join(scaled)} FROM __THIS__")


def scaled_names(columns: Sequence[str]) -> list[str]:
    return [f"{SCALED}{name}" for name in columns]
