"""Jobs: train, evaluate, choose, score, compare profiles."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid import schema as S
from hazegrid.operators import features, forecast, metrics, quality
from hazegrid.operators.features import FeatureSpec
from hazegrid.operators.series import latest_rows
from hazegrid.plans.forecasters import (
    PREDICTION,
    Forecaster,
    ForestForecaster,
    ModelRegistry,
    SequenceForecaster,
    latest_with_history,
)
from hazegrid.session import materialize
from hazegrid.sources.tables import read_features, write_features

# Band width for a sequence model that carries no residual spread.
DEFAULT_RESIDUAL = 5.0


@dataclass(frozen=True)
class TrainingConfig:
    """The keys the training job reads."""

    lookback: int = 168
    validation_fraction: float = 0.15
    test_fraction: float = 0.15
    trees: int = 80
    depth: int = 10
    sequence_family: str = "linear"


def scored_pairs(predicted: DataFrame, model: str, targets: Sequence[str]) -> DataFrame:
    """Truth and prediction per target, both from the same row."""
    cells = F.array(
        *[
            F.struct(
                F.lit(target).alias("target"),
                F.col(target).cast("double").alias("truth"),
                F.col(f"{PREDICTION}{target}").alias("prediction"),
            )
            for target in targets
        ]
    )
    return predicted.select(F.lit(model).alias("model"), F.inline(cells))


def evaluate(forecasters: Sequence[Forecaster], test: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Metrics per model and target on the test rows each model can predict.

    The predictions are written once, since the metrics read them twice and each model should run once per row.
    """
    pairs = None
    for model in forecasters:
        scored = scored_pairs(model.predict(test), model.name, targets)
        pairs = scored if pairs is None else pairs.unionByName(scored)
    return metrics.regression_metrics(materialize(pairs, "scored"))


def train(
    dataset: DataFrame,
    root: str,
    spec: FeatureSpec = FeatureSpec(),
    config: TrainingConfig = TrainingConfig(),
    extra_forecasters: Sequence[Forecaster] = (),
    validate: bool = True,
    sources: Sequence[str] = (),
    sequence: str | None = None,
) -> dict:
    """The whole job: checks, features, split, two models, metrics, choice, metadata document.

    The checks ask for every input column that features are derived from, the satellite columns among them, and
    for ``sequence`` (a unique row number of the source, if there is one) also for rows in time order. A row is known
    by its site and ``spec.order``: rows of one moment are no duplicates where a further column tells them apart.
    ``dataset`` holds train and unseen rows; features are derived over both, then split. The feature table
    is written once and read back by everything after it.
    """
    spark = dataset.sparkSession
    if validate:
        tie_break = [name for name in spec.tie_break if name != spec.split]  # the same all over a split
        inputs = [name for name in dict.fromkeys([*spec.lag_columns, *spec.sparse_columns]) if name not in S.EXTERNAL_COLUMNS]
        for split, targets in ((S.TRAIN, spec.targets), (S.UNSEEN, ())):
            required = [spec.site, spec.timestamp, *inputs, *targets]
            rows = features.split_rows(dataset, split)
            report = quality.validation_report(rows, required, sequence=sequence, tie_break=tie_break).first()
            if not report["passed"]:
                raise ValueError({split: report["issues"]})
    write_features(features.build_features(dataset, spec), f"{root}/features")
    train_rows = read_features(spark, f"{root}/features", S.TRAIN, dataset.schema[spec.site].dataType)
    excluded = [*spec.excluded, *spec.tie_break]
    columns = features.feature_columns(train_rows, spec.targets, excluded)
    parts = features.chronological_split(
        train_rows, config.validation_fraction, config.test_fraction, spec.site, spec.order, keep_rows=True
    )
    parts.write.mode("overwrite").partitionBy("part").parquet(f"{root}/parts")
    parts = spark.read.parquet(f"{root}/parts")
    fitting, checking, testing = (
        parts.where(F.col("part") == name).drop("part") for name in ("train", "validation", "test")
    )
    derived = ("_lag_", "_roll_mean_", "_roll_std_")
    plain = [name for name in columns if not any(mark in name for mark in derived)]
    forecasters: list[Forecaster] = [
        ForestForecaster(columns, spec.targets, config.trees, config.depth),
        SequenceForecaster(plain, config.lookback, spec.targets, config.sequence_family, tuple(spec.tie_break)),
        *extra_forecasters,
    ]
    registry = ModelRegistry(spark, root)
    for model in forecasters:
        model.fit(fitting, checking)
        registry.save(model)
    names = [model.name for model in forecasters]
    rows = evaluate(forecasters, testing, spec.targets).collect()  # one row per model and target
    table: dict[str, dict[str, dict[str, float]]] = {name: {} for name in names}
    for row in rows:
        table[row["model"]][row["target"]] = {key: row[key] for key in ("rmse", "mae", "r2", "ria")}
    listed = spark.createDataFrame(
        [(row["model"], row["rmse"], names.index(row["model"])) for row in rows], "model string, rmse double, listing int"
    )
    metadata = {
        "active_model": metrics.active_model(listed).first()["model"],
        "available_models": names,
        "metrics": table,
        "feature_columns": plain,
        "model_feature_columns": {model.name: list(model.feature_columns) for model in forecasters},
        "training_data_sources": list(sources),
        "external_feature_columns": [name for name in S.EXTERNAL_COLUMNS if name in train_rows.columns],
        "targets": list(spec.targets),
        "config": {"lookback": config.lookback, "trees": config.trees, "depth": config.depth},
    }
    registry.save_metadata(metadata)
    return metadata


def metrics_table(spark, metadata: dict) -> DataFrame:
    """The metrics of a metadata document as rows (model, target, metric, value)."""
    rows = [
        (model, target, name, value)
        for model, targets in metadata["metrics"].items()
        for target, values in targets.items()
        for name, value in values.items()
    ]
    return spark.createDataFrame(rows, "model string, target string, metric string, value double")


def model_sigmas(spark, metadata: dict, forecaster: Forecaster) -> DataFrame:
    """Band widths: a model's own ``residual_std`` where it has one, else its RMSE."""
    own = getattr(forecaster, "residual_std", None)
    if own is not None:
        spread = {name: own.get(name, DEFAULT_RESIDUAL) for name in forecaster.targets}
    else:
        spread = {name: values["rmse"] for name, values in metadata["metrics"][forecaster.name].items()}
    rows = [(name, float(value)) for name, value in spread.items()]
    return spark.createDataFrame(rows, "target string, sigma double")


def batch_forecast(
    forecaster: Forecaster,
    unseen: DataFrame,
    sigmas: DataFrame,
    horizon: int | None = forecast.DEFAULT_HORIZON,
    order: Sequence[str] = (S.TIMESTAMP,),
) -> DataFrame:
    """Forecast of the last ``horizon`` rows of every site in one job, with bands and the model's name."""
    wanted = forecast.horizon_or_default(horizon)
    inputs = latest_with_history(unseen, wanted, forecaster.history_rows(), order)
    predicted = forecaster.predict(forecast.align_to_model(inputs, forecaster.feature_columns))
    points = latest_rows(predicted, wanted, S.SITE, order)
    o3, no2 = (f"{PREDICTION}{target}" for target in S.TARGET_COLUMNS)
    named = points.select(
        S.SITE, *order, F.col(o3).alias("o3"), F.col(no2).alias("no2"), F.lit(forecaster.name).alias("model_name")
    )
    return forecast.with_bands(named, sigmas)


def compare_profiles(
    profiles: dict[str, DataFrame],
    root: str,
    spec: FeatureSpec,
    config: TrainingConfig,
    extra_forecasters: Callable[[str], Sequence[Forecaster]] = lambda profile: (),
    validate: bool = True,
) -> DataFrame:
    """The same checked job per profile, metrics side by side: one column per profile.

    ``extra_forecasters`` gives the further models of a profile. A profile that fails the checks ends the comparison.
    """
    rows = None
    for name, dataset in profiles.items():
        metadata = train(dataset, f"{root}/{name}", spec, config, extra_forecasters(name), validate=validate)
        measured = metrics_table(dataset.sparkSession, metadata).withColumn("profile", F.lit(name))
        rows = measured if rows is None else rows.unionByName(measured)
    return rows.groupBy("model", "target", "metric").pivot("profile", list(profiles)).agg(F.first("value"))
