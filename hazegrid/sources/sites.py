"""Site observation files and site coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazegrid import schema as S
from hazegrid.functions.calendar import hourly_timestamp

# File name endings per split.
FILE_ENDINGS = {S.TRAIN: "train_data", S.UNSEEN: "unseen_input_data"}


def site_from_path(path: Column) -> Column:
    """Site number out of ``site_<n>_<ending>.csv``; a file or a folder of parts may carry the name."""
    name = "|".join(FILE_ENDINGS.values())
    digits = F.regexp_extract(path, rf"site_(\d+)_(?:{name})\.csv", 1)
    bad = F.raise_error(F.concat(F.lit("Unrecognized file naming convention: "), path)).cast("int")
    return F.when(digits != "", digits.cast("int")).otherwise(bad)


def read_site_csv(spark: SparkSession, folder: str, split: str, pattern: str = "site_*_{ending}.csv") -> DataFrame:
    """All site files of one split as one table; the explicit schema spares a pass over the files.

    Temporal parts are read as numbers and cut to whole ones.
    """
    ending = FILE_ENDINGS[split]
    raw = (
        spark.read.schema(S.site_csv_schema(split == S.TRAIN))
        .option("header", "true")
        .csv(f"{folder.rstrip('/')}/{pattern.format(ending=ending)}")
    )
    parts = {name: F.col(name).cast("int") for name in S.TEMPORAL_COLUMNS}
    return raw.withColumns(
        {
            S.SITE: site_from_path(F.col("_metadata.file_path")),
            S.SPLIT: F.lit(split),
            S.TIMESTAMP: hourly_timestamp(*S.TEMPORAL_COLUMNS),
            **parts,
        }
    )


def read_site_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated site coordinates; blanks around header names are ignored."""
    raw = spark.read.option("sep", "\t").option("header", "true").option("ignoreLeadingWhiteSpace", "true").csv(path)
    trimmed = raw.toDF(*[name.strip() for name in raw.columns])
    return trimmed.select(
        F.col("Site").cast("int").alias(S.SITE),
        F.col("Latitude N").cast("double").alias("latitude"),
        F.col("Longitude E").cast("double").alias("longitude"),
    )


def read_dataset(spark: SparkSession, folder: str, coordinates: str = "lat_lon_sites.txt") -> DataFrame:
    """Train and unseen rows of all sites with their coordinates, as one table."""
    train, unseen = (read_site_csv(spark, folder, split) for split in (S.TRAIN, S.UNSEEN))
    sites = read_site_coordinates(spark, f"{folder.rstrip('/')}/{coordinates}")
    return train.unionByName(unseen, allowMissingColumns=True).join(sites, S.SITE, "left")
