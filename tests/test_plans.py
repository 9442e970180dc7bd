from __future__ import annotations

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazegrid.catalog import models
from hazegrid.catalog.models import SiteMean
from hazegrid.operators import features
from hazegrid.plans import preprocess, training
from hazegrid.plans.forecasters import ForestForecaster, LeastSquaresForecaster, ModelRegistry, SequenceForecaster
from hazegrid.session import materialize, shared_path


@pytest.fixture(scope="module")
def known(spark, folder):
    return models.forecast_table(spark, folder).where("dataset_split = 'train'").cache()


def test_scaling_by_hand(spark):
    df = spark.createDataFrame([(1.0, 5.0), (None, 5.0), (3.0, 5.0), (8.0, None)], "a double, b double")
    stage = preprocess.scale_stage(preprocess.column_statistics(df, ["a", "b"]))
    got = [(round(r["_z_a"], 6), r["_z_b"]) for r in stage.transform(df).collect()]
    # Median 3; filled values 1, 3, 3, 8 with mean 3.75 and population deviation 2.586020.
    assert got == [(-1.06341, 0.0), (-0.290021, 0.0), (-0.290021, 0.0), (1.643452, 0.0)]


def test_forest_beats_the_mean(known):
    forest = ForestForecaster(models.PLAIN, trees=5, depth=5)
    forest.fit(known)
    mean = SiteMean(forest.targets)
    mean.fit(known)
    scored = {(r["model"], r["target"]): r["rmse"] for r in training.evaluate([forest, mean], known, forest.targets).collect()}
    for target in forest.targets:
        assert scored[(forest.name, target)] < 0.7 * scored[("site_mean", target)]


@pytest.mark.parametrize("family", ["linear", "boosted"])
def test_sequence_model(spark, known, family):
    model = SequenceForecaster(models.PLAIN, 4, family=family, tie_break=("event_id",))
    model.fit(known, known)
    predicted = model.predict(known)
    per_site = known.groupBy("site_id").count().collect()
    assert predicted.count() == sum(max(r["count"] - 4, 0) for r in per_site)
    assert all(value > 0 for value in model.residual_std.values())
    registry = ModelRegistry(spark, shared_path(spark, "registry"))
    registry.save(model)
    registry.save_metadata({"available_models": [model.name]})
    again = registry.load(model.name)
    assert again.residual_std == model.residual_std and again.lookback == 4
    with pytest.raises(KeyError):
        registry.load("other")


def test_forecast_of_all_sites(spark, folder, known):
    model = SequenceForecaster(models.PLAIN, 4, tie_break=("event_id",))
    model.fit(known, known)
    unseen = models.forecast_table(spark, folder).where("dataset_split = 'unseen'").drop("hour_sin")
    sigmas = training.model_sigmas(spark, {}, model)
    points = training.batch_forecast(model, unseen, sigmas, 6, order=("timestamp", "event_id"))
    counts = {r["count"] for r in points.groupBy("site_id").count().collect()}
    assert counts == {6}
    row = points.first()
    width = row["o3_upper"] - row["o3_lower"]
    assert width == pytest.approx(2 * 1.96 * model.residual_std["O3_target"])


def test_training_job(spark, folder):
    root = shared_path(spark, "job")
    spec = dataclasses.replace(models.SPEC, lookback=6, windows=(6,))
    mean = SiteMean(spec.targets)
    metadata = training.train(models.dataset(spark, folder), root, spec, models.CONFIG, extra_forecasters=[mean])
    assert metadata["available_models"] == ["baseline_random_forest", "sequence", "site_mean"]
    errors = {m: sum(t["rmse"] for t in targets.values()) for m, targets in metadata["metrics"].items()}
    assert metadata["active_model"] == min(errors, key=errors.get)
    assert "event_id" not in metadata["model_feature_columns"]["baseline_random_forest"]
    assert "O3_forecast_lag_6" in metadata["model_feature_columns"]["baseline_random_forest"]
    registry = ModelRegistry(spark, root)
    assert registry.metadata()["active_model"] == metadata["active_model"]
    forest = registry.load("baseline_random_forest")
    unseen = features.split_rows(spark.read.parquet(f"{root}/features"), "unseen")
    sigmas = training.model_sigmas(spark, metadata, forest)
    assert training.batch_forecast(forest, unseen, sigmas, 3, order=("timestamp", "event_id")).count() == 15


def test_training_stops_on_bad_data(spark, folder):
    df = models.dataset(spark, folder)
    doubled = df.unionByName(df)
    with pytest.raises(ValueError, match="Duplicate"):
        training.train(doubled, shared_path(spark, "bad"), models.SPEC, models.CONFIG)


def readings_of_one_moment(spark, folder, external=False):
    """Every reading twice: same site and time, another event."""
    df = models.dataset(spark, folder, external)
    return df.unionByName(df.withColumn("event_id", F.col("event_id") + 1_000_000))


def test_training_takes_several_rows_of_one_moment(spark, folder):
    spec = dataclasses.replace(models.SPEC, lookback=3, windows=(6,))
    config = training.TrainingConfig(lookback=3, trees=2, depth=2)
    df = readings_of_one_moment(spark, folder)
    root = shared_path(spark, "moments")
    metadata = training.train(df, root, spec, config)
    assert all(value is not None for targets in metadata["metrics"].values() for t in targets.values() for value in t.values())
    kept = spark.read.parquet(f"{root}/features")
    assert kept.count() == kept.select("site_id", "event_id").distinct().count() == df.count() - 5 * 72
    # Rows that no column of the order tells apart still end the job.
    with pytest.raises(ValueError, match="Duplicate site_id/timestamp/event_id"):
        training.train(df.unionByName(df.limit(1)), shared_path(spark, "bad"), spec, config)


def test_profiles_with_several_rows_of_one_moment(spark, folder):
    spec = dataclasses.replace(models.SPEC, lookback=3, windows=(6,), lag_columns=("O3_forecast",))
    config = training.TrainingConfig(lookback=3, trees=1, depth=1)
    profiles = {"plain": readings_of_one_moment(spark, folder), "more": readings_of_one_moment(spark, folder, external=True)}
    table = training.compare_profiles(profiles, shared_path(spark, "p"), spec, config, lambda profile: [SiteMean(spec.targets)])
    assert table.count() == 24
    assert table.where(F.col("plain").isNull() | F.col("more").isNull()).count() == 0


def test_profiles_side_by_side(spark, folder):
    small = dataclasses.replace(models.SPEC, lookback=3, windows=(6,))
    config = training.TrainingConfig(lookback=3, trees=2, depth=2)
    profiles = {"plain": models.dataset(spark, folder), "more": models.dataset(spark, folder, external=True)}
    table = training.compare_profiles(profiles, shared_path(spark, "p"), small, config)
    assert table.count() == 16 and {"plain", "more"} <= set(table.columns)
    assert table.where(F.col("plain").isNull()).count() == 0


def test_least_squares_equals_a_direct_solution(spark):
    r = np.random.default_rng(5)
    x = r.normal(3, 2, (400, 2))
    y = 1.5 + x @ [2.0, -0.7] + r.normal(0, 0.3, 400)
    rows = [(*map(float, pair), 4.0, float(value), float(2 * value)) for pair, value in zip(x, y)]
    rows += [(None, 1.0, 4.0, 99.0, 99.0), (1.0, 1.0, 4.0, None, None)]
    df = spark.createDataFrame(rows, "a double, b double, constant double, O3_target double, NO2_target double")
    model = LeastSquaresForecaster(["a", "b", "constant"], ["O3_target", "NO2_target"])
    model.fit(df, df)
    direct = np.linalg.lstsq(np.column_stack([np.ones(400), x]), y, rcond=None)[0]
    assert model.weights["O3_target"][:3] == pytest.approx(direct, abs=1e-9) and model.weights["O3_target"][3] == 0.0
    assert model.weights["NO2_target"][:3] == pytest.approx(2 * direct, abs=1e-9)
    predicted = model.predict(df).orderBy("a", "b").collect()
    assert len(predicted) == 402 and predicted[0]["prediction_O3_target"] is None
    registry = ModelRegistry(spark, shared_path(spark, "registry"))
    registry.save(model)
    registry.save_metadata({"available_models": [model.name]})
    assert registry.load(model.name) == model


def test_least_squares_without_rows_or_with_twin_columns(spark):
    schema = "a double, b double, O3_target double"
    empty = LeastSquaresForecaster(["a", "b"], ("O3_target",))
    empty.fit(spark.createDataFrame([], schema))
    assert empty.weights == {"O3_target": [0.0, 0.0, 0.0]}
    twins = LeastSquaresForecaster(["a", "b"], ("O3_target",))
    twins.fit(spark.createDataFrame([(float(i), 2.0 * i, 10.0 * i) for i in range(9)], schema))
    line = spark.createDataFrame([(3.0, 6.0, 0.0)], schema)
    assert twins.predict(line).first()["prediction_O3_target"] == pytest.approx(30.0)


def test_profiles_are_checked_before_they_are_compared(spark, folder):
    good = models.dataset(spark, folder)
    bad = good.unionByName(good)
    with pytest.raises(ValueError, match="Duplicate"):
        training.compare_profiles({"bad": bad}, shared_path(spark, "profiles"), models.SPEC, models.CONFIG)


def windowed_fit(model, train):
    """The regression on written windows, as the library itself fits it."""
    labels = [((F.col(name) - mean) / deviation).alias(f"_scaled_{name}") for name, (mean, deviation) in model.target_scale.items()]
    windows = model._windows(train).select("_vector", *labels).cache()
    return [model._regressor(target).fit(windows) for target in model.targets]


@pytest.mark.parametrize("lookback, block_rows", [(1, 50_000), (4, 50_000), (7, 60)])
def test_sequence_weights_equal_those_of_written_windows(known, monkeypatch, lookback, block_rows):
    monkeypatch.setattr(features.FeatureSpec, "block_rows", block_rows)
    monkeypatch.setattr(features.FeatureSpec.__init__, "__defaults__", tuple(block_rows if d == 50_000 else d for d in features.FeatureSpec.__init__.__defaults__))
    model = SequenceForecaster(models.PLAIN, lookback, tie_break=("event_id",))
    model.fit(known, known)
    for mine, direct in zip(model.model.stages[1:], windowed_fit(model, known), strict=True):
        assert mine.coefficients.toArray() == pytest.approx(direct.coefficients.toArray(), abs=1e-6)
        assert mine.intercept == pytest.approx(direct.intercept, abs=1e-6)


def test_sequence_fit_writes_no_windows(spark, known, monkeypatch):
    """Whatever the lookback, a fit writes about what its input holds: row numbers and the columns it reads."""
    written = []
    monkeypatch.setattr("hazegrid.operators.series.materialize", lambda df, label="table": written.append(df) or materialize(df, label))
    model = SequenceForecaster(models.PLAIN, 24, tie_break=("event_id",))
    model.fit(known, known)
    cells = [len(df.columns) for df in written]
    assert max(cells) <= len(known.columns) + len(models.PLAIN) + 2
    assert all("vector" not in kind for df in written for _, kind in df.dtypes)


def test_sequence_fit_needs_windows_and_targets(known):
    with pytest.raises(ValueError, match="rows before"):
        SequenceForecaster(models.PLAIN, 40_000, tie_break=("event_id",)).fit(known, known)
    with pytest.raises(ValueError, match="known targets"):
        unknown = known.withColumn("O3_target", F.when(F.col("event_id") % 50 > 0, F.col("O3_target")))
        SequenceForecaster(models.PLAIN, 2, tie_break=("event_id",)).fit(unknown, known)
