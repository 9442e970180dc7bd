from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from hazegrid.operators import metrics


def score(spark, rows):
    df = spark.createDataFrame([("m", "t", float(a), float(b)) for a, b in rows], "model string, target string, truth double, prediction double")
    return metrics.regression_metrics(df).first().asDict()


def test_hand_values(spark):
    got = score(spark, [(1, 1.1), (2, 1.9), (3, 3.2)])
    assert got["mae"] == pytest.approx(0.4 / 3) and got["rmse"] == pytest.approx(0.141421, abs=1e-6)
    assert got["r2"] == pytest.approx(0.97) and got["ria"] == pytest.approx(0.9)


def test_constant_truth(spark):
    exact, off = score(spark, [(2, 2), (2, 2)]), score(spark, [(2, 2), (2, 3)])
    assert (exact["r2"], exact["ria"]) == (1.0, 1.0)
    assert (off["r2"], off["ria"]) == (0.0, 1.0)


def test_bad_prediction_and_single_row(spark):
    bad = score(spark, [(1, 11), (2, 12)])
    assert bad["ria"] == pytest.approx(1 / 10 - 1)
    assert score(spark, [(1, 2)])["r2"] is None


def test_ungrouped(spark):
    df = spark.createDataFrame([(1.0, 1.1), (2.0, 1.9), (3.0, 3.2)], "truth double, prediction double")
    assert metrics.regression_metrics(df, group=()).first()["ria"] == pytest.approx(0.9)


def test_active_model_tie(spark):
    df = spark.createDataFrame([("b", 1.0, 1), ("a", 1.0, 0), ("c", 2.0, 2)], "model string, rmse double, listing int")
    assert metrics.active_model(df).first()["model"] == "a"


@pytest.mark.parametrize("kind", ["normal", "heavy ties", "outliers", "even"])
def test_exact_medians_beyond_the_sketch(spark, monkeypatch, kind):
    monkeypatch.setattr(metrics, "MEDIAN_ACCURACY", 100)
    rng = random.Random(kind)
    make = {
        "normal": lambda i: rng.gauss(0, 1),
        "heavy ties": lambda i: float(rng.choice([1, 1, 1, 2, 3])),
        "outliers": lambda i: rng.random() if i % 50 else 1e300 * rng.random(),
        "even": lambda i: float(i % 2),
    }[kind]
    values = [("g" if i % 9 else "h", make(i), None if i % 3 else make(i)) for i in range(6001)]
    df = spark.createDataFrame(values, "g string, a double, b double").repartition(7)
    got = {(r["g"], r["column"]): r["median"] for r in metrics.exact_medians(df, ["a", "b"], ["g"]).collect()}
    for group in "gh":
        for place, column in ((1, "a"), (2, "b")):
            known = [v[place] for v in values if v[0] == group and v[place] is not None]
            assert got[(group, column)] == pytest.approx(statistics.median(known), rel=1e-12), (group, column)


def test_median_of_nothing(spark):
    df = spark.range(3).select(F.lit(None).cast("double").alias("a"), F.col("id").alias("b"))
    assert {r["column"]: r["median"] for r in metrics.exact_medians(df, ["a", "b"]).collect()} == {"b": 1.0}


def test_unknown_values_are_left_out(spark):
    rows = [("m", "t", 1.0, 2.0), ("m", "t", 2.0, 3.0), ("m", "t", 3.0, None), ("m", "t", None, 3.0), ("none", "t", None, 1.0)]
    pairs = spark.createDataFrame(rows, "model string, target string, truth double, prediction double")
    got = metrics.regression_metrics(pairs).collect()
    assert len(got) == 1 and (got[0]["rmse"], got[0]["mae"], got[0]["r2"]) == (1.0, 1.0, -3.0)
    assert {r["model"]: r["incomplete"] for r in metrics.incomplete_pairs(pairs).collect()} == {"m": 2, "none": 1}


def test_only_cells_near_the_middle_become_rows(spark):
    df = spark.range(200_000).select(F.rand(1).alias("a"), F.randn(2).alias("b"), (F.col("id") % 4).alias("g"))
    df = df.withColumn("a", F.when(F.col("a") > 0.1, F.col("a")))
    for group in ([], ["g"]):
        wide = metrics._with_brackets(df, ["a", "b"], group)
        assert 0 < metrics._inside(wide, ["a", "b"], group).count() < 0.05 * 400_000
    exact = df.agg(F.median("a").alias("a"), F.median("b").alias("b")).first()
    got = {r["column"]: r["median"] for r in metrics.exact_medians(df, ["a", "b"]).collect()}
    assert got == {"a": exact["a"], "b": exact["b"]}
