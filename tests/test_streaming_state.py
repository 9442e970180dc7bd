"""Streams with state per site, over several files landed one after another."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from hazegrid.plans.forecasters import SequenceForecaster
from hazegrid.session import passing_tables, shared_path
from hazegrid.streaming import live, state

SCHEMA = "event_id long, site_id string, timestamp timestamp, o3 double, no2 double"


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def run_parts(spark, tmp_path, parts, start):
    """Land each part and run the job on it, with one checkpoint."""
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        query = start(stream)
        query.awaitTermination()
        assert query.exception() is None


def said(spark, tmp_path):
    rows = spark.read.parquet(f"{tmp_path}/out").select("site_id", "event_id", "stale").collect()
    return sorted((r.site_id, r.event_id, r.stale) for r in rows)


def test_a_silent_site_turns_stale_and_fresh_again(spark, tmp_path):
    def start(stream):
        with state.state_store(spark):
            return live.append_to(state.freshness(stream, "event_id", delay="0 seconds"), f"{tmp_path}/out", f"{tmp_path}/cp")

    run_parts(spark, tmp_path, [[(1, "a", at(0), 1.0, 1.0), (2, "b", at(0), 2.0, 1.0)]], start)
    assert said(spark, tmp_path) == [("a", 1, False), ("b", 2, False)]
    # Site b goes on without a; 30 s are not enough, 60 s are.
    run_parts(spark, tmp_path, [[(3, "b", at(30), 2.0, 1.0)]], start)
    assert said(spark, tmp_path) == [("a", 1, False), ("b", 2, False), ("b", 3, False)]
    run_parts(spark, tmp_path, [[(4, "b", at(60), 2.0, 1.0)]], start)
    assert [row for row in said(spark, tmp_path) if row[0] == "a"] == [("a", 1, False), ("a", 1, True)]
    # A new reading makes it fresh; of equal times the larger id counts, an older reading changes nothing.
    run_parts(spark, tmp_path, [[(6, "a", at(70), 9.0, 1.0), (5, "a", at(70), 8.0, 1.0), (9, "a", at(65), 7.0, 1.0), (7, "a", None, 7.0, 1.0)]], start)
    assert [row for row in said(spark, tmp_path) if row[0] == "a"] == [("a", 1, False), ("a", 1, True), ("a", 6, False)]
    run_parts(spark, tmp_path, [[(8, "c", at(200), 9.0, 1.0)]], start)
    assert ("a", 6, True) in said(spark, tmp_path) and ("b", 4, True) in said(spark, tmp_path)
    assert ("c", 8, True) not in said(spark, tmp_path)


def test_the_setting_for_state_is_put_back(spark):
    before = spark.conf.get(state.STORE, None)
    with state.state_store(spark):
        assert spark.conf.get(state.STORE) == state.ROCKS
    assert spark.conf.get(state.STORE, None) == before


def test_windows_reach_over_files(spark, tmp_path):
    rows = [(i, "ab"[i % 2], at(i), float(i), 0.0) for i in range(20)] + [(100, "c", at(3), 1.0, 0.0)]
    parts = [[r for r in rows if r[2] < at(5)], [r for r in rows if at(5) <= r[2] < at(6)], [r for r in rows if r[2] >= at(6)]]

    def start(stream):
        windows = state.sequence_stream(stream, ["o3", "no2"], 3, ("event_id",), ("timestamp", "event_id"))
        with state.state_store(spark):
            return live.append_to(windows, f"{tmp_path}/out", f"{tmp_path}/cp")

    run_parts(spark, tmp_path, parts, start)
    got = {r.event_id: r.sequence for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {i: [[float(i - d), 0.0] for d in (6, 4, 2)] for i in range(6, 20)}


def test_scores_of_a_stream_are_those_of_a_batch(spark, tmp_path):
    rows = [(i, "ab"[i % 2], at(i), float(i % 7), float(i % 5)) for i in range(120)]
    model = SequenceForecaster(["o3", "no2"], 4, targets=("O3_target", "NO2_target"), tie_break=("event_id",))
    labelled = spark.createDataFrame(rows, SCHEMA).withColumns({"O3_target": F.col("o3") * 2, "NO2_target": F.col("no2") + 1})
    model.fit(labelled, labelled)

    def start(stream):
        return state.score_sequences(stream, model, f"{tmp_path}/out", f"{tmp_path}/cp", ("site_id", "event_id"), ("timestamp", "event_id"))

    run_parts(spark, tmp_path, [rows[:50], rows[50:53], rows[53:]], start)
    got = {r.event_id: (r.prediction_O3_target, r.prediction_NO2_target) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    expected = {r.event_id: (r.prediction_O3_target, r.prediction_NO2_target) for r in model.predict(labelled).collect()}
    assert len(got) == 112 and got.keys() == expected.keys()
    assert all(abs(x - y) < 1e-9 for key in got for x, y in zip(got[key], expected[key]))


def test_sequences_are_scored_without_a_site_in_python(spark, tmp_path):
    """No Python process gets a site's rows, whatever a micro-batch holds; a repeated batch gives the same, once."""
    rows = [(i, "ab"[i % 2] if i % 5 else None, at(i // 2), float(i % 7), float(i % 5)) for i in range(200)]
    model = SequenceForecaster(["o3", "no2"], 4, targets=("O3_target", "NO2_target"), tie_break=("event_id",))
    labelled = spark.createDataFrame(rows, SCHEMA).withColumns({"O3_target": F.col("o3") * 2, "NO2_target": F.col("no2") + 1})
    model.fit(labelled.where("site_id IS NOT NULL"), labelled.where("site_id IS NOT NULL"))
    queries = []

    def start(stream):
        keep, order = ("site_id", "event_id"), ("timestamp", "event_id")
        queries.append(state.score_sequences(stream, model, f"{tmp_path}/out", f"{tmp_path}/cp", keep, order))
        return queries[-1]

    def scores():
        found = spark.read.parquet(f"{tmp_path}/out")
        assert found.count() == found.select("event_id").distinct().count()
        return {r.event_id: (r.site_id, r.prediction_O3_target, r.prediction_NO2_target) for r in found.collect()}

    # The second part holds one site only: the others' last rows have to outlive it.
    parts = [rows[:90], [r for r in rows[90:130] if r[1] == "a"], [r for r in rows[90:130] if r[1] != "a"] + rows[130:]]
    run_parts(spark, tmp_path, parts, start)
    assert not any("Python" in q._jsq.explainInternal(False) or "PySpark" in q._jsq.explainInternal(False) for q in queries)
    got = scores()
    expected = {r.event_id: (r.site_id, r.prediction_O3_target, r.prediction_NO2_target) for r in model.predict(labelled).collect()}
    assert len(got) == 188 and got.keys() == expected.keys()
    assert all(got[i][0] == expected[i][0] and abs(got[i][1] - expected[i][1]) < 1e-9 and abs(got[i][2] - expected[i][2]) < 1e-9 for i in got)
    kept = sorted(path.name for path in (tmp_path / "cp" / "last_rows").iterdir())
    assert kept == ["batch=1", "batch=2"]
    last = spark.read.parquet(f"{tmp_path}/cp/last_rows/batch=2").groupBy("site_id").count().collect()
    assert {r["site_id"]: r["count"] for r in last} == {"a": 4, "b": 4, None: 4}
    # The last batch is run again, as after a failure before its end was noted.
    for path in (tmp_path / "cp" / "commits").glob("*2*"):
        path.unlink()
    again = start(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"))
    again.awaitTermination()
    assert again.exception() is None and scores() == got


def test_tables_of_a_passing_batch_are_deleted(spark):
    kept = shared_path(spark, "kept")
    with passing_tables(spark):
        passing = shared_path(spark, "passing")
        for path in (kept, passing):
            spark.range(1).write.parquet(path)
    assert spark.read.parquet(kept).count() == 1
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(passing)
    assert not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
