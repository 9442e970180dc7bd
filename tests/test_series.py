"""Row blocks must give exactly what one window over a whole site gives."""

from __future__ import annotations

import dataclasses
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import plan_of
from hazegrid.operators import features, quality, series
from hazegrid.operators.features import FeatureSpec


@pytest.fixture(scope="module")
def skewed(spark):
    """One site with most rows, one of a single row, ties in time, gaps in the values."""
    rng = random.Random(5)
    rows = []
    for i in range(900):
        site = "hot" if i % 10 else ("b" if i % 20 else "c")
        rows.append((i, site, rng.randrange(300), None if rng.random() < 0.6 else rng.random() * 100, rng.random()))
    rows.append((900, "single", 5, 1.0, 2.0))
    rows += [(901 + i, "blank", i, None, float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, site_id string, t int, sparse double, v double")
    return df.withColumn("timestamp", F.timestamp_add("HOUR", "t", F.lit("2024-01-01").cast("timestamp_ntz"))).drop("t")


SPEC = FeatureSpec(
    tie_break=("id",), lag_columns=("v", "sparse"), sparse_columns=("sparse",), targets=(), lookback=12, windows=(6, 24)
)


def rows(df, digits=9):
    return sorted(
        (tuple(round(x, digits) if isinstance(x, float) else x for x in r) for r in df.select(*sorted(df.columns)).collect()),
        key=repr,
    )


@pytest.mark.parametrize("block", [73, 100, 10_000])
def test_blocks_equal_whole_sites(skewed, block):
    whole = features.add_window_features(skewed, dataclasses.replace(SPEC, block_rows=None))
    blocked = features.add_window_features(skewed, dataclasses.replace(SPEC, block_rows=block))
    assert rows(whole) == rows(blocked.select(*whole.columns))


@pytest.mark.parametrize("causal", [False, True])
@pytest.mark.parametrize("block", [7, 50])
def test_fill_in_blocks(skewed, block, causal):
    spec = dataclasses.replace(SPEC, lag_columns=(), causal=causal)
    whole = features.fill_sparse(skewed, dataclasses.replace(spec, block_rows=None))
    blocked = features.fill_sparse(skewed, dataclasses.replace(spec, block_rows=block))
    assert rows(whole) == rows(blocked.select(*whole.columns))
    assert {r["sparse"] for r in blocked.where("site_id = 'blank'").collect()} == {0.0}


def test_sequences_in_blocks(skewed):
    whole = features.sequences(skewed, ["v"], 12, dataclasses.replace(SPEC, block_rows=None))
    blocked = features.sequences(skewed, ["v"], 12, dataclasses.replace(SPEC, block_rows=30))
    assert rows(whole) == rows(blocked.select(*whole.columns))
    assert blocked.where("site_id = 'single'").count() == 0


def test_index_rows(skewed):
    indexed = series.index_rows(skewed, ["site_id"], ["timestamp", "id"])
    expected = Window.partitionBy("site_id").orderBy("timestamp", "id")
    checked = indexed.withColumn("e", F.row_number().over(expected) - 1).withColumn(
        "n", F.count(F.lit(1)).over(Window.partitionBy("site_id"))
    )
    assert checked.where(f"e <> {series.ROW} OR n <> {series.ROWS}").count() == 0
    assert checked.count() == skewed.count()


def test_index_rows_with_null_site(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "site_id string, id int")
    got = {(r["site_id"], r["id"]): r[series.ROW] for r in series.index_rows(df, ["site_id"], ["id"]).collect()}
    assert got == {(None, 1): 0, (None, 2): 1, ("a", 3): 0}


def test_halo_must_fit(skewed):
    with pytest.raises(ValueError):
        features.add_window_features(skewed, dataclasses.replace(SPEC, block_rows=10))


def test_one_shuffle_for_all_windows(skewed):
    indexed = series.index_rows(skewed, ["site_id"], ["timestamp", "id"])
    spec = dataclasses.replace(SPEC, sparse_columns=(), block_rows=100)
    physical = plan_of(features.add_window_features(indexed, spec)).split("== Physical Plan ==")[-1]
    assert physical.count("Exchange hashpartitioning") == 1


def test_top_rows_equal_one_window(skewed):
    got = series.latest_rows(skewed, 7, order=("timestamp", "id"))
    window = Window.partitionBy("site_id").orderBy(F.desc("timestamp"), F.desc("id"))
    expected = skewed.withColumn("r", F.row_number().over(window)).where("r <= 7").drop("r")
    assert rows(got) == rows(expected)


def test_order_check_across_blocks(spark):
    df = spark.createDataFrame(
        [("up", i, i) for i in range(20)] + [("inside", i, -i) for i in range(3)] + [("joint", 4, 9), ("joint", 5, 1)] + [("null", 1, None)],
        "site_id string, seq int, timestamp int",
    )
    got = {r["site_id"]: r["out_of_order"] for r in quality.order_check(df, "seq", block_rows=5).collect()}
    assert got == {"up": False, "inside": True, "joint": True, "null": True}


def test_order_check_of_sparse_numbers(spark):
    """Numbers far apart, and one site with nine tenths of the rows."""
    big = [("big", i * 10**9 + i % 7, i) for i in range(900)]
    back = [("back", i * 10**9, i if i != 50 else 1) for i in range(100)]
    df = spark.createDataFrame(big + back, "site_id string, seq long, timestamp int").repartition(5)
    got = {r["site_id"]: r["out_of_order"] for r in quality.order_check(df, "seq", block_rows=64).collect()}
    assert got == {"big": False, "back": True}


def test_newest_row_takes_one_shuffle(spark):
    from conftest import plan_of

    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", None, "z")], "site_id string, t int, v string")
    newest = series.latest_per_key(df, ["site_id"], ["t"])
    assert plan_of(newest).split("== Physical Plan ==")[-1].count("Exchange") == 1
    assert newest.columns == ["site_id", "t", "v"] and {(r["site_id"], r["v"]) for r in newest.collect()} == {("a", "y"), ("b", "z")}


def test_nested_pages_are_bounded(skewed):
    pages = series.nest_pages(skewed, ["site_id"], "id", ["v"], page_rows=50)
    assert pages.agg(F.max(F.size("points"))).first()[0] <= 50
    assert pages.select(F.sum(F.size("points"))).first()[0] == skewed.count()
