"""How the given tables stand in for the site-hour tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazegrid.operators.resample import hourly_mean
from hazegrid.session import materialize


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` read as a site series; 7 of 10 rows are labelled train, the others unseen."""
    return table(spark, folder, "events").select(
        "event_id",
        F.col("event_type").alias("site_id"),
        F.col("ts").alias("timestamp"),
        F.col("value").alias("o3"),
        F.get_json_object("props", "$.k").cast("double").alias("no2"),
        F.when(F.col("event_id") % 10 < 7, "train").otherwise("unseen").alias("dataset_split"),
    )


def hourly(spark: SparkSession, folder: str) -> DataFrame:
    """Unique site-hour table: hourly means, rounded so that both engines compare the same numbers."""
    means = hourly_mean(observations(spark, folder), ["o3", "no2"])
    return means.withColumns({"o3": F.round("o3", 6), "no2": F.round("no2", 6)})


def stored_hours(spark: SparkSession, folder: str) -> DataFrame:
    """The hourly table written once, for queries that read it several times."""
    return materialize(hourly(spark, folder), "hours")


EV = """ev AS (
  SELECT event_id, event_type AS site_id, ts AS "timestamp", value AS o3,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS no2,
         CASE WHEN event_id % 10 < 7 THEN 'train' ELSE 'unseen' END AS dataset_split
  FROM events)"""

HOURLY = (
    EV
    + """, hourly AS (
  SELECT site_id, date_trunc('hour', "timestamp") AS "timestamp",
         round(avg(o3), 6) AS o3, round(avg(no2), 6) AS no2
  FROM ev GROUP BY 1, 2)"""
)

# Coordinates of the stand-in sites.
SITE_COORDINATES = [
    ("click", 28.6953, 77.1817),
    ("error", 28.5718, 77.0719),
    ("purchase", 28.5832, 77.2201),
    ("signup", 28.8229, 77.1020),
    ("view", 28.5308, 77.2713),
]


def coordinates(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{site}', {lat}D, {lon}D)" for site, lat, lon in SITE_COORDINATES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(site_id, latitude, longitude)")


COORDINATES = "coords(site_id, latitude, longitude) AS (VALUES {})".format(
    ", ".join(
        f"('{site}', CAST({lat} AS DOUBLE), CAST({lon} AS DOUBLE))" for site, lat, lon in SITE_COORDINATES
    )
)
