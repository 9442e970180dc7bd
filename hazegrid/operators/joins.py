"""Joins of the site-hour table with its side tables.

No join carries a broadcast hint: side tables read from files have a known size, and the planner broadcasts
them only below ``spark.sql.autoBroadcastJoinThreshold``; above it, adaptive execution splits hot keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid import schema as S


def with_coordinates(df: DataFrame, coordinates: DataFrame, site: str = S.SITE) -> DataFrame:
    """Observations with latitude and longitude; sites without coordinates keep nulls."""
    return df.join(coordinates, site, "left")


def with_external(df: DataFrame, external: DataFrame, site: str = S.SITE, timestamp: str = S.TIMESTAMP) -> DataFrame:
    """Observations with the external measures of the same site and hour.

    The external table must be unique per key (``external_duplicates`` finds offenders).
    """
    return df.join(external, [site, timestamp], "left")


def external_duplicates(external: DataFrame, site: str = S.SITE, timestamp: str = S.TIMESTAMP) -> DataFrame:
    counted = external.groupBy(site, timestamp).agg(F.count(F.lit(1)).alias("rows"))
    return counted.where(F.col("rows") > 1)


def combine_splits(train: DataFrame, unseen: DataFrame) -> DataFrame:
    """Train rows and unseen rows by column name; a column one side lacks is null there."""
    return train.unionByName(unseen, allowMissingColumns=True)


def truth_with_prediction(
    truth: DataFrame, prediction: DataFrame, site: str = S.SITE, timestamp: str = S.TIMESTAMP
) -> DataFrame:
    """Pairs matched on their key, never by position."""
    return truth.join(prediction, [site, timestamp])
