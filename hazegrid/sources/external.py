"""External air-quality context landed as JSON payloads, and its stored history."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazegrid import schema as S
from hazegrid.operators.resample import interpolate_hourly
from hazegrid.sources.tables import read_partitioned
from hazegrid.sources.versions import VersionedDocument

DATA_SOURCE = "openmeteo"
# Fixed value: first day with history per domain.
FIRST_DAY = {"cams_global": datetime.date(2022, 8, 1)}


def read_external_payload(spark: SparkSession, path: str) -> DataFrame:
    """Landed payload documents (one JSON object per line), with their explicit schema."""
    return spark.read.schema(S.EXTERNAL_PAYLOAD_SCHEMA).json(path)


def payload_hours(payloads: DataFrame) -> DataFrame:
    """The parallel hourly arrays as rows; payloads without hours give none."""
    arrays = F.arrays_zip(*[F.col(f"hourly.{name}") for name in ("time", *S.EXTERNAL_MEASURES)])
    return payloads.select(S.SITE, F.explode(arrays).alias("h")).select(
        S.SITE,
        F.col("h.time").cast("timestamp_ntz").alias(S.TIMESTAMP),
        *[F.col(f"h.{name}").alias(f"external_{name}") for name in S.EXTERNAL_MEASURES],
    )


def external_table(payloads: DataFrame) -> DataFrame:
    """Hourly external measures, gap-free and interpolated per site, unique per site and hour."""
    filled = interpolate_hourly(payload_hours(payloads), S.EXTERNAL_COLUMNS)
    return filled.withColumn("data_source", F.lit(DATA_SOURCE))


def payload_current(payloads: DataFrame) -> DataFrame:
    """The current values; unknown measures read 0, an unknown time reads now (UTC)."""
    measures = dict(zip(("o3", "no2", "us_aqi", "european_aqi"), S.EXTERNAL_MEASURES))
    at = F.coalesce(F.col("current.time").cast("timestamp_ntz"), F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.localtimestamp()))
    return payloads.where(F.col("current").isNotNull()).select(
        S.SITE,
        at.alias(S.TIMESTAMP),
        *[F.coalesce(F.col(f"current.{name}"), F.lit(0.0)).alias(alias) for alias, name in measures.items()],
    )


BATCH = "_batch"


def _manifest(spark: SparkSession, path: str) -> VersionedDocument:
    return VersionedDocument(spark, f"{path}/_versions")


def _owners(spark: SparkSession, path: str, batches: list[dict], site_type) -> DataFrame:
    """``site, _batch``: the batch that a site's rows are read from.

    The last batch that replaced the site, or else the first that brought it. Reads the lists of sites only.
    """
    place = F.create_map(*[part for i, b in enumerate(batches) for part in (F.lit(b["id"]), F.lit((i + 1) if b["refresh"] else -(i + 1)))])
    listed = spark.read.schema(T.StructType().add(S.SITE, site_type).add(BATCH, "string")).parquet(f"{path}/sites")
    listed = listed.withColumn("_place", place[F.col(BATCH)]).where(F.col("_place").isNotNull())
    return listed.groupBy(S.SITE).agg(F.max_by(BATCH, "_place").alias(BATCH))


def upsert_external(fresh: DataFrame, path: str, refresh: bool = False) -> None:
    """Add external history to the stored table.

    Sites already stored are kept, or replaced as a whole with ``refresh``; other sites are never touched. Rows go
    to a folder of their own, the list of their sites beside it, and a new version of the manifest names both when
    they are complete, so a failed write leaves the table as it was, and which sites are stored is read from the
    lists, not from the data. Of two writers that bring the same new site the one that commits first has it.
    """
    spark = fresh.sparkSession
    kind = fresh.schema[S.SITE].dataType
    manifest = _manifest(spark, path)
    batches = manifest.read()[1].get("batches", [])
    rows = fresh
    if not refresh and batches:
        stored = _owners(spark, path, batches, kind).select(S.SITE)
        rows = fresh.join(stored, S.SITE, "left_anti")
    name = uuid.uuid4().hex
    folder = f"{path}/data/{BATCH}={name}"
    laid = rows.repartitionByRange(S.SITE, S.TIMESTAMP).sortWithinPartitions(S.SITE, S.TIMESTAMP)
    laid.write.partitionBy(S.SITE).parquet(folder)
    if not _written(spark, folder):
        return
    own = read_partitioned(spark, folder, {S.SITE: kind}).select(S.SITE).distinct()
    own.write.parquet(f"{path}/sites/{BATCH}={name}")
    entry = {"id": name, "refresh": refresh}
    manifest.update(lambda document: {"batches": [*document.get("batches", []), entry]})


def read_external(spark: SparkSession, path: str, site_type: T.DataType | str = "string") -> DataFrame:
    """The stored external history. Site is a folder name, so its type is given here."""
    site_type = T.DataType.fromDDL(site_type) if isinstance(site_type, str) else site_type
    batches = _manifest(spark, path).read()[1].get("batches", [])
    if not batches:
        raise ValueError(f"nothing is stored under {path}")
    known = [b["id"] for b in batches]
    rows = read_partitioned(spark, f"{path}/data", {BATCH: "string", S.SITE: site_type}).where(F.col(BATCH).isin(known))
    return rows.join(_owners(spark, path, batches, site_type), [S.SITE, BATCH], "left_semi").drop(BATCH)


def _written(spark: SparkSession, path: str) -> bool:
    """Whether a write has left any folder of a site."""
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(location)
    return any(status.isDirectory() and status.getPath().getName().startswith(f"{S.SITE}=") for status in listed)


def external_fetch_plan(df: DataFrame, domain: str = "cams_global") -> DataFrame:
    """First and last day to fetch per site; the start is not before the domain's first day."""
    plan = df.groupBy(S.SITE).agg(
        F.to_date(F.min(S.TIMESTAMP)).alias("start_date"), F.to_date(F.max(S.TIMESTAMP)).alias("end_date")
    )
    first = FIRST_DAY.get(domain)
    if first is None:
        return plan
    return plan.withColumn("start_date", F.greatest("start_date", F.lit(first)))
