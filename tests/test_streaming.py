"""Streams over several landed files, one micro-batch each."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hazegrid.operators import alerts, resample
from hazegrid.streaming import live

SCHEMA = "event_id long, site_id string, timestamp timestamp, o3 double, no2 double"


def moment(hour, minute=0):
    return dt.datetime(2024, 1, 1, hour, minute)


def land(spark, folder, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in/{i}")


def stream(spark, folder):
    schema = spark.createDataFrame([], SCHEMA).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def run(query):
    query.awaitTermination()
    assert query.exception() is None


def test_late_rows_are_dropped(spark, tmp_path):
    batches = [
        [(1, "a", moment(0, 10), 10.0, 1.0), (2, "a", moment(0, 20), 20.0, 1.0)],
        [(3, "a", moment(3, 0), 30.0, 1.0)],
        [(4, "a", moment(0, 30), 999.0, 1.0), (5, "a", moment(5, 0), 5.0, 1.0)],
        [(6, "a", moment(8, 0), 7.0, 1.0)],
    ]
    for i, batch in enumerate(batches):
        land(spark, str(tmp_path), [batch]) if i == 0 else None
        if i:
            spark.createDataFrame(batch, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        run(live.append_to(live.hourly_means(stream(spark, tmp_path)), f"{tmp_path}/out", f"{tmp_path}/cp"))
    got = {r["timestamp"].hour: r["o3"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {0: 15.0, 3: 30.0, 5: 5.0}


def test_duplicates_across_batches(spark, tmp_path):
    rows = [(1, "a", moment(0), 1.0, 1.0), (2, "b", moment(0), 2.0, 1.0)]
    land(spark, str(tmp_path), [rows, rows, [(3, "a", moment(0, 1), 3.0, 1.0)]])
    run(live.append_to(live.without_duplicates(stream(spark, tmp_path)), f"{tmp_path}/out", f"{tmp_path}/cp"))
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, "ab"[i % 2], moment(i % 20, i % 60), float(i % 150), float(i % 99)) for i in range(300)]
    land(spark, str(tmp_path), [rows[:100], rows[100:]])
    run(live.append_to(live.alert_stream(stream(spark, tmp_path)), f"{tmp_path}/alerts", f"{tmp_path}/cp1"))
    columns = ["site_id", "timestamp", "pollutant", "value", "severity"]
    batch = alerts.threshold_alerts(spark.createDataFrame(rows, SCHEMA)).select(*columns)
    streamed = spark.read.parquet(f"{tmp_path}/alerts").select(*columns)
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0
    run(live.append_to(live.hourly_means(stream(spark, tmp_path), delay="2 days"), f"{tmp_path}/means", f"{tmp_path}/cp2"))
    # Nothing is closed while the watermark has not passed.
    assert spark.read.schema("site_id string").parquet(f"{tmp_path}/means").count() == 0
    assert resample.hourly_mean(spark.createDataFrame(rows, SCHEMA), ["o3"]).count() > 0


def test_latest_state_over_batches(spark, tmp_path):
    land(spark, str(tmp_path), [[(1, "a", moment(2), 1.0, 1.0), (2, "b", moment(1), 2.0, 1.0)], [(3, "a", moment(1), 3.0, 1.0), (4, "b", moment(3), 4.0, 1.0)]])
    state = live.latest_state(stream(spark, tmp_path), "event_id")
    run(live.each_batch_to(state, f"{tmp_path}/out", f"{tmp_path}/cp", mode="update"))
    rows = spark.read.parquet(f"{tmp_path}/out")
    newest = {r["site_id"]: r["event_id"] for r in rows.orderBy("batch").collect()}
    assert newest == {"a": 1, "b": 4}


def test_repeated_batch_replaces_its_folder(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", moment(0), 1.0, 1.0)], SCHEMA)
    for _ in range(2):
        rows.write.mode("overwrite").parquet(f"{tmp_path}/out/batch=0")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1


def test_freshness(spark):
    latest = spark.createDataFrame([("a", moment(0, 0)), ("b", moment(0, 1))], "site_id string, timestamp timestamp_ntz")
    aged = live.with_freshness(latest, F.lit("2024-01-01 00:01:30").cast("timestamp_ntz"))
    assert {r["site_id"]: (r["age_seconds"], r["stale"]) for r in aged.collect()} == {"a": (90.0, True), "b": (30.0, False)}


def test_sequence_models_cannot_score_batches(spark, tmp_path):
    class Needy:
        name, feature_columns = "needy", []

        def history_rows(self):
            return 3

    with pytest.raises(ValueError):
        live.score_batches(stream(spark, _landed(spark, tmp_path)), Needy(), spark.range(1), "x", "y", ())


def _landed(spark, tmp_path):
    land(spark, str(tmp_path), [[(1, "a", moment(0), 1.0, 1.0)]])
    return tmp_path
