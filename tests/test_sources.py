from __future__ import annotations

import csv
import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import plan_of
from hazegrid import schema as S
from hazegrid.sources import documents, external, sites, tables, versions


def write_site(folder, name, with_targets, days=(3, 1, 2)):
    columns = [f.name for f in S.site_csv_schema(with_targets).fields]
    with open(os.path.join(folder, name), "w", newline="") as handle:
        out = csv.writer(handle)
        out.writerow(columns)
        for day in days:
            for hour in range(24):
                moment = {"year": "2024.0", "month": "1.0", "day": f"{day}.0", "hour": f"{hour}.0"}
                out.writerow([moment.get(c, "" if c in S.SATELLITE_COLUMNS else day * 100 + hour) for c in columns])


def test_site_files(spark, tmp_path):
    write_site(tmp_path, "site_1_train_data.csv", True)
    write_site(tmp_path, "site_12_train_data.csv", True)
    write_site(tmp_path, "site_1_unseen_input_data.csv", False, days=(9,))
    (tmp_path / "lat_lon_sites.txt").write_text("Site \t Latitude N\tLongitude E \n1\t28.5\t77.1\n12\t28.6\t77.2\n")
    df = sites.read_dataset(spark, str(tmp_path))
    counts = {(r["site_id"], r["dataset_split"]): r["n"] for r in df.groupBy("site_id", "dataset_split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {(1, "train"): 72, (12, "train"): 72, (1, "unseen"): 24}
    row = df.where("site_id = 12 AND timestamp = TIMESTAMP_NTZ'2024-01-02 05:00:00'").first()
    assert (row["O3_target"], row["NO2_satellite"], row["latitude"], row["hour"]) == (205.0, None, 28.6, 5)
    assert df.where("dataset_split = 'unseen' AND O3_target IS NOT NULL").count() == 0


def test_unknown_file_name(spark, tmp_path):
    write_site(tmp_path, "site_x_train_data.csv", True)
    with pytest.raises(Exception, match="Unrecognized file naming convention"):
        sites.read_site_csv(spark, str(tmp_path), "train").collect()


def payload(site, hourly=None, current=None):
    return json.dumps({"site_id": site, **({"hourly": hourly} if hourly is not None else {}), **({"current": current} if current is not None else {})})


def test_payloads(spark, tmp_path):
    times = ["2024-01-01T00:00", "2024-01-01T01:00", "2024-01-01T03:00"]
    hours = {"time": times, "ozone": [None, 3.0, 9.0], "nitrogen_dioxide": [1.0, 1.0, 1.0], "us_aqi": [None] * 3, "european_aqi": [5.0, None, 7.0]}
    (tmp_path / "a.json").write_text("\n".join([payload("1", hours, {"ozone": None, "us_aqi": 4.0}), payload("2", {}), payload("3")]))
    read = external.read_external_payload(spark, str(tmp_path))
    rows = external.external_table(read).orderBy("timestamp").collect()
    assert [r["external_ozone"] for r in rows] == [3.0, 3.0, 6.0, 9.0]
    assert [r["external_european_aqi"] for r in rows] == [5.0, pytest.approx(17 / 3), pytest.approx(19 / 3), 7.0]
    assert {r["external_us_aqi"] for r in rows} == {None} and {r["site_id"] for r in rows} == {"1"}
    current = external.payload_current(read).collect()
    assert len(current) == 1 and (current[0]["o3"], current[0]["us_aqi"]) == (0.0, 4.0)
    assert abs(current[0]["timestamp"] - dt.datetime.now(dt.UTC).replace(tzinfo=None)) < dt.timedelta(minutes=5)


def test_external_history(spark, tmp_path):
    path = str(tmp_path / "history")

    def rows(*pairs):
        return spark.createDataFrame([(s, dt.datetime(2024, 1, 1), float(v)) for s, v in pairs], "site_id int, timestamp timestamp_ntz, v double")

    def stored():
        return {r["site_id"]: r["v"] for r in external.read_external(spark, path, "int").collect()}

    external.upsert_external(rows((1, 1), (2, 2)), path)
    external.upsert_external(rows((2, 20), (3, 30)), path)
    assert stored() == {1: 1.0, 2: 2.0, 3: 30.0}
    external.upsert_external(rows((2, 20)), path, refresh=True)
    assert stored() == {1: 1.0, 2: 20.0, 3: 30.0}


def history_rows(spark, *pairs):
    return spark.createDataFrame([(s, dt.datetime(2024, 1, 1), float(v)) for s, v in pairs], "site_id int, timestamp timestamp_ntz, v double")


def test_a_failed_write_leaves_the_history_as_it_was(spark, tmp_path):
    path = str(tmp_path / "history")
    external.upsert_external(history_rows(spark, (1, 1)), path)
    broken = history_rows(spark, (2, 2)).withColumn("v", F.when(F.col("site_id") == 2, F.raise_error(F.lit("broken"))).otherwise(F.col("v")).cast("double"))
    with pytest.raises(Exception, match="broken"):
        external.upsert_external(broken, path)
    assert [(r["site_id"], r["v"]) for r in external.read_external(spark, path, "int").collect()] == [(1, 1.0)]
    # Nothing new: no version is written.
    before = external._manifest(spark, path).read()
    external.upsert_external(history_rows(spark, (1, 5)), path)
    assert external._manifest(spark, path).read() == before


def test_two_writers_keep_each_others_sites(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "history")
    external.upsert_external(history_rows(spark, (1, 1)), path)
    written, busy = external._written, []

    def meanwhile(session, folder):
        found = written(session, folder)
        if not busy:
            busy.append(True)
            external.upsert_external(history_rows(spark, (9, 90), (8, 80)), path)
        return found

    monkeypatch.setattr(external, "_written", meanwhile)
    external.upsert_external(history_rows(spark, (9, 9), (10, 10)), path)
    stored = {r["site_id"]: r["v"] for r in external.read_external(spark, path, "int").collect()}
    assert stored == {1: 1.0, 8: 80.0, 9: 90.0, 10: 10.0}


def test_stored_sites_come_from_the_lists_alone(spark, tmp_path):
    path = str(tmp_path / "history")
    external.upsert_external(history_rows(spark, (1, 1), (2, 2)), path)
    owners = external._owners(spark, path, external._manifest(spark, path).read()[1]["batches"], T.IntegerType())
    assert owners.inputFiles() and all("/sites/" in name for name in owners.inputFiles())
    with pytest.raises(ValueError):
        external.read_external(spark, str(tmp_path / "none"))


ODD_SITES = ["007", "7", "1e3", "2024-01-01", "ok"]


def test_external_history_keeps_odd_ids(spark, tmp_path):
    path = str(tmp_path / "odd")
    first = spark.createDataFrame([(s, dt.datetime(2024, 1, 1), 1.0) for s in ODD_SITES], "site_id string, timestamp timestamp_ntz, v double")
    external.upsert_external(first, path)
    external.upsert_external(first.withColumn("v", F.lit(2.0)).unionByName(first.withColumns({"site_id": F.lit("new"), "v": F.lit(3.0)}).limit(1)), path)
    stored = external.read_external(spark, path)
    assert {r["site_id"]: r["v"] for r in stored.collect()} == {**{s: 1.0 for s in ODD_SITES}, "new": 3.0}


def test_features_keep_odd_ids(spark, tmp_path):
    path = str(tmp_path / "features")
    df = spark.createDataFrame([(s, "train", dt.datetime(2024, 1, 1), 1.0) for s in ODD_SITES], "site_id string, dataset_split string, timestamp timestamp_ntz, v double")
    tables.write_features(df, path)
    back = tables.read_features(spark, path)
    assert back.schema["site_id"].dataType.simpleString() == "string"
    assert back.join(df, ["site_id", "timestamp"]).count() == len(ODD_SITES)


def test_fetch_plan(spark):
    df = spark.createDataFrame([(1, dt.datetime(2020, 5, 5)), (1, dt.datetime(2023, 1, 2)), (2, dt.datetime(2023, 3, 3))], "site_id int, timestamp timestamp_ntz")
    plan = {r["site_id"]: (str(r["start_date"]), str(r["end_date"])) for r in external.external_fetch_plan(df).collect()}
    assert plan == {1: ("2022-08-01", "2023-01-02"), 2: ("2023-03-03", "2023-03-03")}
    free = {r["site_id"]: str(r["start_date"]) for r in external.external_fetch_plan(df, "other").collect()}
    assert free[1] == "2020-05-05"


def test_documents(spark, tmp_path):
    (tmp_path / "a.md").write_text("  Hello \n\n  world  " + "x" * 4000)
    (tmp_path / "b.md").write_text(" \n ")
    chunks = documents.document_chunks(documents.read_text_documents(spark, str(tmp_path))).collect()
    assert [r["source_id"] for r in chunks] == ["a.md"]
    assert len(chunks[0]["text"]) == 3500 and chunks[0]["text"].startswith("Hello world")


def test_feature_round_trip_and_pruning(spark, tmp_path):
    path = str(tmp_path / "features")
    df = spark.range(100).select(
        (F.col("id") % 2).cast("int").alias("site_id"),
        F.timestamp_add("HOUR", F.col("id").cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("timestamp"),
        F.when(F.col("id") < 70, "train").otherwise("unseen").alias("dataset_split"),
        F.col("id").cast("double").alias("O3_target"),
        F.col("id").cast("double").alias("NO2_target"),
        F.lit("unused").alias("other"),
    )
    tables.write_features(df, path)
    assert tables.read_features(spark, path).count() == 100
    scan = tables.observation_frame(spark.read.parquet(path), 1)
    assert scan.columns == ["timestamp", "site_id", "O3_target", "NO2_target"] and scan.count() == 35
    plan = plan_of(scan).split("== Physical Plan ==")[-1]
    assert "PartitionFilters" in plan and "other" not in plan


def test_text_timestamps_are_cast(spark):
    df = spark.createDataFrame([(1, "2024-01-02T00:00:00", 1.0), (1, "2024-01-01T00:00:00", 2.0)], "site_id int, timestamp string, v double")
    got = tables.scan_site(df, 1, columns=["v"]).collect()
    assert [r["v"] for r in got] == [2.0, 1.0] and got[0]["timestamp"] == dt.datetime(2024, 1, 1)


def test_profiles(spark, tmp_path):
    book = tables.ProfileBook(spark, str(tmp_path))
    book.write("one", "t", spark.range(1))
    book.write("two", "t", spark.range(2))
    book.publish("one", ["t"])
    assert book.active("t").count() == 1 and book.active_profile() == "one"
    # Another session sees it, and sees the next publication.
    other = tables.ProfileBook(spark.newSession(), str(tmp_path))
    assert other.active("t").count() == 1
    book.publish("two", ["t"])
    assert other.active("t").count() == 2
    # A table written again is not public before the next publication.
    book.write("two", "t", spark.range(5))
    assert other.active("t").count() == 2
    for profile, names in (("three", ["t"]), ("one", ["t", "missing"])):
        with pytest.raises(KeyError):
            book.publish(profile, names)
    assert other.active("t").count() == 2 and other.active_profile() == "two"
    with pytest.raises(KeyError):
        other.active("missing")


def test_versions_are_never_overwritten(spark, tmp_path):
    first, second = (versions.VersionedDocument(spark, str(tmp_path / "d")) for _ in range(2))
    assert first.read() == (0, {})
    assert first.write({"a": 1}, 0) == 1
    with pytest.raises(versions.VersionConflict):
        second.write({"a": 2}, 0)
    assert second.read() == (1, {"a": 1})

    def late(document):
        # Somebody else commits between reading and writing, once.
        if first.read()[0] == 1:
            first.write({**document, "b": 2}, 1)
        return {**document, "c": 3}

    assert second.update(late) == {"a": 1, "b": 2, "c": 3} and first.read() == (3, {"a": 1, "b": 2, "c": 3})
    # A version whose writer died is passed over.
    (tmp_path / "d" / "0000000004.json").write_text('{"a": ')
    assert first.read() == (4, {"a": 1, "b": 2, "c": 3})
    assert first.update(lambda document: {**document, "d": 4})["d"] == 4 and first.read()[0] == 5


def test_json_documents(spark, tmp_path):
    document = {"a": [1, 2], "b": {"c": None}}
    tables.write_json_document(spark, document, str(tmp_path / "d"))
    assert tables.read_json_document(spark, str(tmp_path / "d")) == document
    tables.write_documents(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "rows"))
    assert spark.read.text(str(tmp_path / "rows")).first()[0] == '{"a":1,"b":null}'
