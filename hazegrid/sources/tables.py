"""Stored tables: site scans, feature tables, JSON documents, named profiles."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from hazegrid import schema as S
from hazegrid.sources.versions import VersionedDocument


def with_required(columns: Sequence[str]) -> list[str]:
    """The wanted columns after the two every scan needs, each once."""
    return list(dict.fromkeys([S.TIMESTAMP, S.SITE, *columns]))


def scan_site(
    source: DataFrame,
    site: int | str,
    split: str | None = None,
    columns: Sequence[str] | None = None,
    order: str | None = S.TIMESTAMP,
) -> DataFrame:
    """Rows of one site in time order. The filters and the column list reach the Parquet scan.

    Timestamps stored as text are cast, as older feature files hold them so.
    """
    rows = source.where(F.col(S.SITE) == site)
    if split is not None:
        rows = rows.where(F.col(S.SPLIT) == split)
    if columns is not None:
        rows = rows.select(*with_required(columns))
    if dict(rows.dtypes)[S.TIMESTAMP] == "string":
        rows = rows.withColumn(S.TIMESTAMP, F.col(S.TIMESTAMP).cast("timestamp_ntz"))
    return rows.orderBy(order) if order else rows


def observation_frame(source: DataFrame, site: int | str, split: str = S.TRAIN, order: str | None = S.TIMESTAMP):
    return scan_site(source, site, split, S.TARGET_COLUMNS, order)


def forecast_input_frame(source: DataFrame, site: int | str, order: str | None = S.TIMESTAMP):
    return scan_site(source, site, S.UNSEEN, ["O3_forecast", "NO2_forecast"], order)


def write_features(features: DataFrame, path: str, mode: str = "overwrite", rows_per_file: int = 5_000_000) -> None:
    """Feature table as Parquet by split and site, rows in time order inside each file.

    Rows are laid out by range of (split, site, time): a site of any size is shared by several tasks, and
    row groups stay narrow in time, so scans of a site or period skip the rest.
    """
    ordered = features.repartitionByRange(S.SPLIT, S.SITE, S.TIMESTAMP).sortWithinPartitions(
        S.SPLIT, S.SITE, S.TIMESTAMP
    )
    ordered.write.mode(mode).option("maxRecordsPerFile", rows_per_file).partitionBy(S.SPLIT, S.SITE).parquet(path)


def read_features(
    spark: SparkSession, path: str, split: str | None = None, site_type: DataType | str = "string"
) -> DataFrame:
    """A table written by ``write_features``. Site and split are folder names, so the type of the site is given here.

    Left to itself Spark would guess it from the names and read site ``007`` as the number 7.
    """
    rows = read_partitioned(spark, path, {S.SPLIT: "string", S.SITE: site_type})
    return rows if split is None else rows.where(F.col(S.SPLIT) == split)


def read_partitioned(spark: SparkSession, path: str, partitions: dict[str, DataType | str]) -> DataFrame:
    """A partitioned Parquet table whose partition columns have the given types, whatever their names look like."""
    files = spark.read.option("basePath", path).parquet(path)
    names = [name for name in files.columns if name not in partitions]
    schema = StructType([files.schema[name] for name in names])
    for name, kind in partitions.items():
        schema = schema.add(name, kind)
    return spark.read.schema(schema).parquet(path)


def write_documents(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows as JSON lines; nulls are written, so every line has every field."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_json_document(spark: SparkSession, document: dict, path: str) -> None:
    """One small document (model metadata, a summary) as a one-line JSON text file."""
    line = spark.createDataFrame([(json.dumps(document),)], "value string")
    line.coalesce(1).write.mode("overwrite").text(path)


def read_json_document(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


class ProfileBook:
    """Named profiles, each a folder of tables; one is active, for every session that opens the same folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._pointer = VersionedDocument(spark, f"{self.root}/_published")

    def path(self, profile: str, table: str) -> str:
        return f"{self.root}/{profile}/{table}"

    def write(self, profile: str, table: str, df: DataFrame) -> None:
        """Store a table of a profile under a new folder; what is published stays as it is until ``publish``."""
        folder = f"{self.path(profile, table)}/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        VersionedDocument(self.spark, f"{self.path(profile, table)}/_latest").update(lambda _: {"folder": folder})

    def _latest(self, profile: str, table: str) -> str:
        folder = VersionedDocument(self.spark, f"{self.path(profile, table)}/_latest").read()[1].get("folder")
        if folder is None:
            raise KeyError(f"profile {profile} has no table {table}")
        return folder

    def publish(self, profile: str, tables: Sequence[str]) -> None:
        """Make a profile's tables the active ones, all at once: one new version of a small document.

        Every table is opened first, so a missing one changes nothing. Tables of earlier publications that are not
        named are no longer active.
        """
        folders = {table: self._latest(profile, table) for table in tables}
        for folder in folders.values():
            self.spark.read.parquet(folder)
        self._pointer.update(lambda _: {"profile": profile, "tables": folders})

    def active_profile(self) -> str | None:
        return self._pointer.read()[1].get("profile")

    def active(self, table: str) -> DataFrame:
        folders = self._pointer.read()[1].get("tables", {})
        if table not in folders:
            raise KeyError(f"no table {table} is published")
        return self.spark.read.parquet(folders[table])
