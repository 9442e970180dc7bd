from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from hazegrid.functions import risk, text, vectors


def values(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_fixed_text_is_exact(spark):
    rng = random.Random(3)
    numbers = [0.0, -0.0, 0.05, 0.15, 0.25, 2.15, 2.25, 2.35, 2.5, 3.5, -0.04, -2.25, 1234.75, 99.95, 0.3, 536870911.9, 1e12, -7.77e15]
    numbers += [rng.randrange(-100000, 100000) / 100 for _ in range(3000)] + [rng.uniform(-500, 500) for _ in range(1000)]
    df = values(spark, [(n,) for n in numbers] + [(None,)], "x double")
    cells = [text.fixed_text(F.col("x"), d).alias(f"d{d}") for d in (0, 1, 2)]
    for row in df.select("x", *cells, text.number_text(F.col("x")).alias("n"), text.signed_text(F.col("x")).alias("s")).collect():
        if row["x"] is None:
            assert (row["d1"], row["n"], row["s"]) == (None, "n/a", "n/a")
            continue
        for d in (0, 1, 2):
            assert row[f"d{d}"] == f"{row['x']:.{d}f}", row
        assert row["s"] == ("+" if row["x"] >= 0 else "") + f"{row['x']:.1f}"


def test_white_space(spark):
    raw = "  a b\x1cc　\x85 d \n"
    row = values(spark, [(raw,)], "t string").select(
        text.squeeze(F.col("t")).alias("q"), text.strip(F.col("t")).alias("s"), text.tokens(F.col("t")).alias("k")
    ).first()
    assert row["q"] == " ".join(raw.split()) and row["s"] == raw.strip() and row["k"] == ["a", "b", "c", "d"]


def test_similarity(spark):
    df = values(spark, [("A b b c", "b C d e"), ("", "a"), ("x", "  ")], "a string, b string")
    got = [r[0] for r in df.select(text.lexical_similarity(text.tokens(F.col("a")), text.tokens(F.col("b")))).collect()]
    assert got == [pytest.approx(2 / (3**0.5 * 4**0.5)), 0.0, 0.0]


@pytest.mark.parametrize(
    "query, expected",
    [
        ("Compare the RISK", "alert"),
        ("show data for the city", "dataset"),
        ("Compare Delhi with next week", "comparison"),
        ("the next 24 hours", "forecast"),
        ("Why so low?", "diagnostic"),
        ("hello", "brief"),
    ],
)
def test_intent(spark, query, expected):
    assert values(spark, [(query,)], "q string").select(text.intent(F.col("q"))).first()[0] == expected


def test_query_cleaning(spark):
    df = values(spark, [("  Why?\n\nContext:\n- Site 1",), (" \n ",), ("x" * 100,), (None,)], "q string")
    rows = df.select(text.clean_query(F.col("q")).alias("c"), text.session_title(text.clean_query(F.col("q"))).alias("t")).collect()
    assert rows[0]["c"] == "Why?" and rows[0]["t"] == "Why?"
    assert rows[1]["t"] == "New research session" and len(rows[2]["t"]) == 72 and rows[3]["t"] == "New research session"


def test_extraction(spark):
    said = "O3 12 then NO2 at 3.5 and Average O3 is 1.5; AVERAGE no2 is 9. Peak O3 is 80.5 ug/m3 at 2024-01-01T05:00:00+00:00"
    df = values(spark, [(said,), ("nothing",)], "t string")
    cells = {**text.pollutant_values(F.col("t")), **text.forecast_peaks(F.col("t"))}
    first, second = df.select(*[c.alias(n) for n, c in cells.items()]).collect()
    assert (first["o3"], first["no2"], first["avg_o3"], first["avg_no2"]) == (12.0, 3.5, 1.5, 9.0)
    assert (first["peak_o3"], first["peak_o3_time"], first["peak_no2"]) == (80.5, "2024-01-01T05:00:00+00:00", None)
    assert set(second.asDict().values()) == {None}


def test_labels(spark):
    df = values(spark, [(140.0, 0.0), (0.0, 110.0), (95.0, 0.0), (0.0, 70.0), (94.9, 69.9)], "o3 double, no2 double")
    got = [r[0] for r in df.select(risk.risk_label(F.col("o3"), F.col("no2"))).collect()]
    assert got == ["High risk", "High risk", "Elevated", "Elevated", "Stable"]
    watched = df.select(risk.risk_label(F.col("o3"), F.col("no2"), middle="Watch")).collect()
    assert watched[2][0] == "Watch"


def test_drivers_and_directions(spark):
    df = values(
        spark,
        [(50.0, 50.0, None, None), (50.0, 60.0, 45.0, 55.0), (54.9, 1.0, 50.0, 1.0), (60.0, 1.0, 50.0, 1.0), (40.0, 1.0, 50.0, 1.0)],
        "o3 double, no2 double, a double, b double",
    )
    c = F.col
    rows = df.select(
        risk.strongest_driver(c("o3"), c("no2"), c("a"), c("b")).alias("s"),
        risk.trend_direction(c("o3"), c("a")).alias("d"),
        risk.watch_driver(c("o3"), c("no2"), c("a"), c("b"), F.lit(None).cast("double"), F.lit(None).cast("double")).alias("w"),
    ).collect()
    assert [r["s"] for r in rows] == ["O3", "O3", "O3", "O3", "O3"]
    assert [r["d"] for r in rows] == ["unknown", "rising", "stable", "rising", "falling"]
    # Equal shifts: the larger pressure decides, a tie goes to ozone.
    assert [r["w"] for r in rows] == ["O3", "NO2", "O3", "O3", "O3"]


def test_zero_counts_as_missing_in_chains(spark):
    df = values(spark, [(0.0, 5.0), (None, 5.0), (3.0, 5.0), (0.0, None), (0.0, 0.0)], "a double, b double")
    assert [r[0] for r in df.select(risk.known_or(F.col("a"), F.col("b"))).collect()] == [5.0, 5.0, 3.0, None, 0.0]


def test_pressure(spark):
    df = values(spark, [(160.0, None), (None, 120.0), (80.0, 79.0), (None, None)], "u double, e double")
    pressure = risk.aqi_pressure(F.col("u"), F.col("e"))
    rows = df.select(pressure.alias("p"), risk.pressure_tone(pressure).alias("t"), risk.shown_aqi(F.col("u"), F.col("e")).alias("s")).collect()
    assert [tuple(r) for r in rows] == [(160.0, "severe", 160.0), (120.0, "high", 120.0), (80.0, "moderate", 80.0), (0.0, "low", None)]


def test_cosine(spark):
    df = values(spark, [([1.0, 0.0], [2.0, 0.0]), ([1.0, 0.0], [0.0, 3.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    assert [r[0] for r in df.select(vectors.cosine(a, b, vectors.norm(a), vectors.norm(b))).collect()] == [1.0, 0.0, None]


def test_small_labels(spark):
    row = values(spark, [("a_b_c", None, "")], "m string, n string, e string").select(
        text.model_label(F.col("m")), text.model_label(F.col("n")), text.model_label(F.col("e")),
        text.credibility_cluster(F.lit("live"), F.lit(0.9)), text.credibility_cluster(F.lit("live"), F.lit(0.75)),
        text.credibility_cluster(F.lit("live"), F.lit(0.7)), text.safe_double(F.lit("x")),
        text.intent_title(F.lit("brief"), F.lit("forecast")),
    ).first()
    assert tuple(row) == ("a b c", "standby", "standby", "live-high", "live-medium", "live-exploratory", None, "Forecast intelligence brief")


def test_fixed_text_of_large_values(spark):
    values = [536870911.25, 536870912.25, 0.05, 2.15, 0.25, 0.35, 99.95, 999999999999.95, 2.0**53, 2.0**53 + 2, -0.04, 1e15 + 0.5, float(2**61)]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", text.fixed_text(F.col("v")).alias("t"))
    assert [r["t"] for r in df.collect()] == [f"{v:.1f}" for v in values]
    whole = spark.createDataFrame([(v,) for v in (0.5, 1.5, 2.5, 2.0**40 + 0.5)], "v double").select(text.fixed_text(F.col("v"), 0).alias("t"))
    assert [r["t"] for r in whole.collect()] == [f"{v:.0f}" for v in (0.5, 1.5, 2.5, 2.0**40 + 0.5)]


def test_unknown_values_in_labels(spark):
    df = spark.createDataFrame([(None, 10.0), (None, None), (3.0, None)], "a double, b double")
    got = df.select(risk.trend_direction(F.col("a"), F.col("b")).alias("t"), risk.leading_pollutant(F.col("a"), F.col("b")).alias("l"),
                    risk.strongest_driver(F.col("a"), F.col("b"), F.lit(0.0), F.lit(0.0)).alias("d")).collect()
    assert [r["t"] for r in got] == ["falling", "unknown", "unknown"]
    assert [r["l"] for r in got] == ["NO2", "O3", "O3"] and [r["d"] for r in got] == ["NO2", "O3", "O3"]
