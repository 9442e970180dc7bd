"""Streams over landed files: ingest, hourly means, alerts, duplicates, latest state, scoring.

Every job runs on the available files and ends (``availableNow``), or keeps running with another trigger;
progress and state live in a checkpoint in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazegrid import schema as S
from hazegrid.operators.alerts import NO2_THRESHOLD, O3_THRESHOLD, threshold_alerts
from hazegrid.operators.forecast import align_to_model, with_bands
from hazegrid.sources.external import payload_hours

FRESH_SECONDS = 45
WATERMARK = "10 minutes"


def payload_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Landed payload documents as a stream of site-hour rows."""
    landed = (
        spark.readStream.schema(S.EXTERNAL_PAYLOAD_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(folder)
    )
    return payload_hours(landed)


def reading_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet") -> DataFrame:
    """Landed Parquet files as a stream. Event times must be cast to ``TIMESTAMP`` before a watermark."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def append_to(stream: DataFrame, path: str, checkpoint: str, partition_by: tuple[str, ...] = ()):
    """Start an append job into Parquet files; returns the query."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.trigger(availableNow=True).start(path)


def each_batch_to(
    stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None, mode: str = "append"
):
    """Write each micro-batch to its own folder; a repeated batch replaces its folder, so nothing doubles."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = transform(batch) if transform else batch
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.foreachBatch(write).trigger(availableNow=True).start()


def hourly_means(
    stream: DataFrame, measures: tuple[str, ...] = ("o3", "no2"), delay: str = WATERMARK, site: str = S.SITE
) -> DataFrame:
    """Tumbling hourly mean per site; an hour is given out once the watermark has passed its end."""
    hour = F.window(S.TIMESTAMP, "1 hour")
    means = stream.withWatermark(S.TIMESTAMP, delay).groupBy(site, hour).agg(*[F.avg(m).alias(m) for m in measures])
    return means.select(site, F.col("window.start").alias(S.TIMESTAMP), *measures)


def alert_stream(stream: DataFrame, o3_threshold: float = O3_THRESHOLD, no2_threshold: float = NO2_THRESHOLD) -> DataFrame:
    """Threshold alerts; stateless, the batch operator unchanged."""
    return threshold_alerts(stream, o3_threshold, no2_threshold)


def without_duplicates(stream: DataFrame, delay: str = WATERMARK, site: str = S.SITE) -> DataFrame:
    """First reading per site and time among those within the watermark delay."""
    return stream.withWatermark(S.TIMESTAMP, delay).dropDuplicatesWithinWatermark([site, S.TIMESTAMP])


def latest_state(stream: DataFrame, tie: str, fields: tuple[str, ...] = ("o3", "no2"), site: str = S.SITE) -> DataFrame:
    """Newest reading per site as running state (update mode): one line of state per site."""
    order = F.struct(S.TIMESTAMP, tie)
    reading = F.struct(S.TIMESTAMP, tie, *fields)
    return stream.groupBy(site).agg(F.max_by(reading, order).alias("_r")).select(site, "_r.*")


def with_freshness(latest: DataFrame, as_of, limit_seconds: int = FRESH_SECONDS) -> DataFrame:
    """Age of each site's newest reading and whether it is too old."""
    age = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col(S.TIMESTAMP).cast("timestamp"))
    aged = latest.withColumn("age_seconds", age / 1_000_000)
    return aged.withColumn("stale", F.col("age_seconds") >= limit_seconds)


def score_batches(stream: DataFrame, forecaster, sigmas: DataFrame, path: str, checkpoint: str, keep: tuple[str, ...]):
    """Predictions with bands for the rows of each micro-batch. For models that need no preceding rows.

    Models over row sequences keep state: ``streaming.state.score_sequences``.
    """
    if forecaster.history_rows():
        raise ValueError("a model over row sequences is scored by streaming.state.score_sequences")

    def score(batch: DataFrame) -> DataFrame:
        predicted = forecaster.predict(align_to_model(batch, forecaster.feature_columns))
        points = predicted.select(
            *keep,
            F.col(f"prediction_{S.TARGET_COLUMNS[0]}").alias("o3"),
            F.col(f"prediction_{S.TARGET_COLUMNS[1]}").alias("no2"),
            F.lit(forecaster.name).alias("model_name"),
        )
        return with_bands(points, sigmas)

    return each_batch_to(stream, path, checkpoint, score)
