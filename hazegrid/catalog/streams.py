"""Streaming jobs run over the given files to their end, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazegrid.catalog.models import PLAIN, band_flags, fitted_forest, forecast_table, train_parts
from hazegrid.catalog.registry import query
from hazegrid.catalog.scalars import THRESHOLD_ALERTS
from hazegrid.catalog.sources import payloads
from hazegrid.catalog.tables import EV, HOURLY, observations, table
from hazegrid.operators import series
from hazegrid.plans.forecasters import SequenceForecaster
from hazegrid.session import materialize, shared_path
from hazegrid.streaming import live, state


def reading_stream(spark, folder):
    """The event file as a stream of site readings with a zoned event time."""
    schema = table(spark, folder, "events").schema
    return live.reading_stream(spark, folder, schema, "events.parquet").select(
        "event_id",
        F.col("event_type").alias("site_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("value").alias("o3"),
        F.get_json_object("props", "$.k").cast("double").alias("no2"),
    )


def finish(spark, start, label):
    """Run a job started by ``start(path, checkpoint)`` to its end and read its table."""
    path = shared_path(spark, label)
    start(f"{path}/table", f"{path}/checkpoint").awaitTermination()
    rows = spark.read.parquet(f"{path}/table")
    zoned = [name for name, kind in rows.dtypes if kind == "timestamp"]
    return rows.withColumns({name: F.col(name).cast("timestamp_ntz") for name in zoned})


@query(
    "i1_snapshot_ingest",
    f"""WITH {HOURLY} SELECT site_id, "timestamp", o3 AS external_ozone, no2 AS external_nitrogen_dioxide FROM hourly""",
)
def i1_snapshot_ingest(spark, folder):
    landed = shared_path(spark, "landed")
    payloads(spark, folder).drop("day").write.json(landed)
    stream = live.payload_stream(spark, landed).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    rows = finish(spark, lambda path, checkpoint: live.append_to(stream, path, checkpoint), "ingest")
    return rows.select("site_id", "timestamp", "external_ozone", "external_nitrogen_dioxide")


@query(
    "i2_streaming_hourly_mean",
    f"""WITH {HOURLY} SELECT site_id, "timestamp", o3, no2 FROM hourly
      WHERE "timestamp" + INTERVAL 1 HOUR <= (SELECT max("timestamp") FROM ev) - INTERVAL 10 MINUTE""",
)
def i2_streaming_hourly_mean(spark, folder):
    means = live.hourly_means(reading_stream(spark, folder))
    rows = finish(spark, lambda path, checkpoint: live.append_to(means, path, checkpoint), "means")
    return rows.withColumns({"o3": F.round("o3", 6), "no2": F.round("no2", 6)})


@query("i3_streaming_alerts", THRESHOLD_ALERTS)
def i3_streaming_alerts(spark, folder):
    found = live.alert_stream(reading_stream(spark, folder))
    return finish(spark, lambda path, checkpoint: live.append_to(found, path, checkpoint), "alerts").drop("pollutant_rank")


@query(
    "i4_duplicate_suppression",
    f"""WITH {EV} SELECT DISTINCT site_id, "timestamp" FROM ev""",
)
def i4_duplicate_suppression(spark, folder):
    """Each reading is landed twice; every key comes out once."""
    readings = reading_stream(spark, folder)
    unique = live.without_duplicates(readings.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))))
    rows = finish(spark, lambda path, checkpoint: live.append_to(unique, path, checkpoint), "unique")
    return rows.select("site_id", "timestamp")


LATEST = f"""WITH {EV}, newest AS (SELECT * FROM ev
    QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY "timestamp" DESC, event_id DESC) = 1),
  now AS (SELECT max("timestamp") + INTERVAL 30 SECOND AS moment FROM ev)
  SELECT site_id, event_id, o3, no2, round(epoch(moment) - epoch("timestamp"), 3) AS age_seconds,
    epoch(moment) - epoch("timestamp") >= 45 AS stale FROM newest, now"""


@query("i5_latest_snapshot", LATEST)
def i5_latest_snapshot(spark, folder):
    df = observations(spark, folder)
    as_of = df.agg((F.max("timestamp") + F.expr("INTERVAL 30 SECONDS")).alias("t")).select("t").scalar()
    latest = series.latest_per_key(df, ["site_id"], ["timestamp", "event_id"])
    aged = live.with_freshness(latest, as_of)
    return aged.select("site_id", "event_id", "o3", "no2", F.round("age_seconds", 3).alias("age_seconds"), "stale")


@query(
    "i5_streaming_latest",
    f"""WITH {EV} SELECT site_id, event_id, o3, no2 FROM ev
      QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY "timestamp" DESC, event_id DESC) = 1""",
)
def i5_streaming_latest(spark, folder):
    state = live.latest_state(reading_stream(spark, folder), "event_id")
    rows = finish(
        spark, lambda path, checkpoint: live.each_batch_to(state, path, checkpoint, mode="update"), "latest"
    )
    # Later batches replace earlier ones per site.
    newest = series.latest_per_key(rows, ["site_id"], ["batch", "event_id"])
    return newest.select("site_id", "event_id", "o3", "no2")


@query(
    "i6_streaming_scoring",
    f"""WITH {EV} SELECT site_id, event_id, 'baseline_random_forest' AS model_name, true AS band_fits, true AS as_in_batch FROM ev""",
)
def i6_streaming_scoring(spark, folder):
    """Keys of all rows scored as a stream, whether their bands fit, and whether a batch gives the same values."""
    forest, sigmas = fitted_forest(spark, folder)
    landed = shared_path(spark, "scoring-input")
    forecast_table(spark, folder).write.parquet(landed)
    stream = live.reading_stream(spark, landed, spark.read.parquet(landed).schema)
    rows = finish(
        spark,
        lambda path, checkpoint: live.score_batches(stream, forest, sigmas, path, checkpoint, ("site_id", "event_id")),
        "scores",
    )
    once = forest.predict(spark.read.parquet(landed)).select(
        "event_id", F.col("prediction_O3_target").alias("_o3"), F.col("prediction_NO2_target").alias("_no2")
    )
    same = (F.abs(F.col("o3") - F.col("_o3")) < 1e-9) & (F.abs(F.col("no2") - F.col("_no2")) < 1e-9)
    joined = rows.join(once, "event_id", "left").withColumn("as_in_batch", F.coalesce(same, F.lit(False)))
    flags = band_flags(joined, sigmas, ["site_id", "event_id", "as_in_batch"])
    return flags.select("site_id", "event_id", "model_name", "band_fits", "as_in_batch")


@query(
    "i5_streaming_stale",
    f"""WITH {EV}, now AS (SELECT date_trunc('millisecond', max("timestamp")) - INTERVAL 10 SECOND AS moment FROM ev)
      SELECT site_id, event_id, o3, no2, date_trunc('millisecond', "timestamp") + INTERVAL 45 SECOND < moment AS stale FROM ev, now
      QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY "timestamp" DESC, event_id DESC) = 1""",
)
def i5_streaming_stale(spark, folder):
    """The last word of a stream on each site: its newest reading, and whether it has fallen silent since."""
    said = state.freshness(reading_stream(spark, folder), "event_id")
    with state.state_store(spark):
        rows = finish(spark, lambda path, checkpoint: live.append_to(said, path, checkpoint), "freshness")
    newest = series.latest_per_key(rows, ["site_id"], ["timestamp", "event_id", "stale"])
    return newest.select("site_id", "event_id", "o3", "no2", "stale")


@query(
    "i6_streaming_sequences",
    f"""WITH {EV} SELECT site_id, event_id, true AS as_in_batch FROM ev
      QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY "timestamp", event_id) > 6""",
)
def i6_streaming_sequences(spark, folder):
    """Rows scored as a stream by a model over the six rows before each, and whether a batch gives the same values.

    The rows are landed in three parts, in time order; rows at the head of a part need state from the part before.
    """
    fitting, checking, _ = train_parts(forecast_table(spark, folder))
    model = SequenceForecaster(PLAIN, 6, tie_break=("event_id",))
    model.fit(fitting, checking)
    rows = materialize(forecast_table(spark, folder), "sequence-rows")
    first, last = rows.agg(F.percentile_approx("timestamp", [0.33, 0.67]).alias("t")).first()["t"]
    parts = [F.col("timestamp") <= first, (F.col("timestamp") > first) & (F.col("timestamp") <= last), F.col("timestamp") > last]
    path = shared_path(spark, "sequences")
    for part in parts:
        rows.where(part).write.mode("append").parquet(f"{path}/landed")
        stream = live.reading_stream(spark, f"{path}/landed", rows.schema)
        state.score_sequences(stream, model, f"{path}/scores", f"{path}/checkpoint", ("site_id", "event_id"), ("timestamp", "event_id")).awaitTermination()
    names = ("prediction_O3_target", "prediction_NO2_target")
    once = model.predict(rows).select("event_id", *[F.col(name).alias(f"_{name}") for name in names])
    joined = spark.read.parquet(f"{path}/scores").join(once, "event_id", "left")
    same = [F.abs(F.col(name) - F.col(f"_{name}")) < 1e-9 for name in names]
    return joined.select("site_id", "event_id", F.coalesce(same[0] & same[1], F.lit(False)).alias("as_in_batch"))
