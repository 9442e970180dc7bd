from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from hazegrid import schema as S
from hazegrid.functions.calendar import calendar_columns, iso_text
from hazegrid.operators import features, quality
from hazegrid.operators.features import FeatureSpec


@pytest.fixture(scope="module")
def canonical(spark):
    """200 hours at two sites, all canonical columns."""
    hours = spark.range(400).select(
        (F.col("id") % 2 + 1).cast("int").alias("site_id"),
        F.timestamp_add("HOUR", F.floor(F.col("id") / 2).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("timestamp"),
        "id",
    )
    return hours.select(
        *[f(F.col("timestamp")).cast("int").alias(n) for n, f in (("year", F.year), ("month", F.month), ("day", F.dayofmonth), ("hour", F.hour))],
        *[(F.sin(F.col("id") * (i + 1)) * 50).alias(c) for i, c in enumerate(S.FORECAST_COLUMNS)],
        *[F.when(F.col("id") % 5 == 0, F.col("id") * 1.0).alias(c) for c in S.SATELLITE_COLUMNS],
        *[F.when(F.col("id") < 380, F.col("id") * 1.0).alias(c) for c in S.TARGET_COLUMNS],
        "site_id",
        F.when(F.col("id") < 380, "train").otherwise("unseen").alias("dataset_split"),
        "timestamp",
        F.lit(28.6).alias("latitude"),
        F.lit(77.2).alias("longitude"),
    )


def with_external(df):
    known = F.col("hour") != 3
    return df.withColumns(
        {
            **{c: F.when(known, F.lit(1.5)) for c in S.EXTERNAL_COLUMNS},
            "data_source": F.when(known, "openmeteo"),
        }
    )


def test_feature_counts(canonical):
    plain = features.build_features(canonical)
    assert len(features.feature_columns(plain, S.TARGET_COLUMNS)) == 119
    wide = features.build_features(with_external(canonical))
    assert len(features.feature_columns(wide, S.TARGET_COLUMNS)) == 183


def test_rows_kept(canonical):
    plain = features.build_features(canonical)
    # 168 rows of history are missing at the start of each site.
    assert plain.count() == 400 - 2 * 168
    assert plain.where("dataset_split = 'unseen'").count() == 20
    matched = features.build_features(with_external(canonical))
    assert matched.count() == plain.where("hour(timestamp) <> 3").count()
    kept = features.build_features(with_external(canonical), FeatureSpec(require_external_match=False))
    assert kept.count() == plain.count()


def test_flags_before_fill(canonical):
    row = features.build_features(canonical).agg(
        F.sum("NO2_satellite_missing"), F.count_if(F.col("NO2_satellite").isNull())
    ).first()
    assert row[0] > 0 and row[1] == 0


def test_first_rows_of_rolling_statistics(spark):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([4, 8, 6])], "site_id int, timestamp int, v double")
    spec = FeatureSpec(tie_break=(), lag_columns=("v",), sparse_columns=(), windows=(6,))
    got = features.add_window_features(df, spec, lags=False).orderBy("timestamp").collect()
    assert [r["v_roll_mean_6"] for r in got] == [None, 4.0, 6.0]
    assert [round(r["v_roll_std_6"], 6) for r in got] == [0.0, 0.0, 2.828427]


def test_keep_complete_without_targets(spark):
    df = spark.createDataFrame([(1, None), (None, 2)], "a int, b int")
    assert features.keep_complete(df).count() == 0
    assert features.keep_complete(df, ["b"]).count() == 0
    assert features.keep_complete(df.select("a")).count() == 1


def test_split_cuts(spark):
    df = spark.range(7).select(F.lit(1).alias("site_id"), F.col("id").alias("timestamp"), F.lit("train").alias("dataset_split"))
    parts = features.chronological_split(df, 0.15, 0.15).orderBy("timestamp").collect()
    # int(7 * 0.7) = 4, int(7 * 0.85) = 5
    assert [r["part"] for r in parts] == ["train"] * 4 + ["validation"] + ["test"] * 2


def test_split_keeps_positions(spark):
    df = spark.range(14).select((F.col("id") % 2).alias("site_id"), F.col("id").alias("timestamp"), F.lit("train").alias("dataset_split"))
    parts = features.chronological_split(df, 0.15, 0.15, keep_rows=True).where("site_id = 1").orderBy("timestamp").collect()
    assert [(r["part"][0], r["_row"], r["_rows"]) for r in parts] == [
        ("t", 0, 4), ("t", 1, 4), ("t", 2, 4), ("t", 3, 4), ("v", 0, 1), ("t", 0, 2), ("t", 1, 2)
    ]


def test_calendar(spark):
    row = spark.sql("SELECT TIMESTAMP_NTZ'2024-12-29 06:00:00' AS timestamp").select(
        *[c.alias(n) for n, c in calendar_columns().items()], iso_text(F.col("timestamp")).alias("t")
    ).first()
    assert row["is_weekend"] == 1 and round(row["hour_sin"], 9) == 1.0 and row["t"] == "2024-12-29T06:00:00"


def test_validation(spark):
    clean = spark.createDataFrame([(1, 1), (1, 2)], "site_id int, timestamp int")
    assert quality.validation_report(clean, ["site_id"]).first()["passed"]
    broken = spark.createDataFrame([(1, 1, 1), (1, 1, 2), (2, None, 3)], "site_id int, timestamp int, seq int")
    report = quality.validation_report(broken, ["site_id", "z", "a"], sequence="seq").first()
    assert not report["passed"]
    assert report["issues"] == [
        "Missing columns: ['a', 'z']",
        "Timestamp contains null values.",
        "Duplicate site_id/timestamp combinations found.",
        "1 site(s) not sorted chronologically.",
    ]


def test_cross_split_duplicates(spark):
    df = spark.createDataFrame([(1, 1, "train"), (1, 1, "unseen"), (1, 2, "train")], "site_id int, timestamp int, dataset_split string")
    assert [tuple(r) for r in quality.cross_split_duplicates(df).collect()] == [(1, 1)]


def test_summary_of_sites_without_unseen_rows(spark):
    df = spark.createDataFrame([("a", "train"), ("b", "train"), ("b", "unseen"), ("c", "unseen")], "site_id string, dataset_split string")
    counts = quality.site_counts(df.where("dataset_split = 'train'"), df.where("dataset_split = 'unseen'"))
    assert {tuple(r) for r in counts.collect()} == {("a", 1, 0), ("b", 1, 1)}
    totals = quality.dataset_totals(df).first()
    assert (totals["total_sites"], totals["total_train_rows"], totals["total_unseen_rows"]) == (2, 2, 2)


def test_validation_of_rows_of_one_moment(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("b", 1, 1)], "site_id string, timestamp long, event_id long")
    assert quality.validation_report(df, []).first()["issues"] == ["Duplicate site_id/timestamp combinations found."]
    assert quality.validation_report(df, [], tie_break=["event_id"]).first()["passed"]
    twice = quality.validation_report(df.unionByName(df), [], tie_break=["event_id"]).first()
    assert twice["issues"] == ["Duplicate site_id/timestamp/event_id combinations found."]
