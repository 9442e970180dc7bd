"""Forecasters: the protocol, a forest on the feature table, a regressor on row sequences."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor, LinearRegression, LinearRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazegrid import schema as S
from hazegrid.operators.features import FeatureSpec, sequences
from hazegrid.operators.series import ROW, ROWS, index_rows, latest_rows
from hazegrid.plans.normal_equations import window_moments
from hazegrid.plans.preprocess import column_statistics, mean_and_deviation, scale_stage, scaled_names
from hazegrid.session import materialize
from hazegrid.sources.tables import read_json_document, write_json_document

SEED = 42
PENALTY = 0.01
PREDICTION = "prediction_"


def _without_positions(df: DataFrame) -> list[str]:
    """Row positions hold for a whole table only and end with the windows over it."""
    return [name for name in df.columns if name not in (ROW, ROWS)]


class Forecaster(Protocol):
    """What a model must offer to be trained, scored, chosen and saved by the jobs in this package."""

    name: str
    feature_columns: list[str]

    def fit(self, train: DataFrame, validation: DataFrame) -> None: ...

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction_<target>`` columns; rows a model cannot predict are left out."""
        ...

    def history_rows(self) -> int:
        """Preceding rows per site a prediction needs."""
        ...

    def save(self, path: str) -> None: ...


@dataclass
class ForestForecaster:
    """One random forest per target on imputed and scaled features, all features tried at every split."""

    feature_columns: list[str]
    targets: Sequence[str] = tuple(S.TARGET_COLUMNS)
    trees: int = 300
    depth: int = 14
    name: str = "baseline_random_forest"
    model: PipelineModel | None = None

    def history_rows(self) -> int:
        return 0

    def fit(self, train: DataFrame, validation: DataFrame | None = None) -> None:
        stages = [scale_stage(column_statistics(train, self.feature_columns))]
        stages.append(VectorAssembler(inputCols=scaled_names(self.feature_columns), outputCol="_vector"))
        rows = train
        for stage in stages:
            rows = stage.transform(rows)
        # Two columns stay per row, written once: every tree level reads them again.
        rows = materialize(rows.select("_vector", *self.targets), "forest-input")
        for target in self.targets:
            forest = RandomForestRegressor(
                featuresCol="_vector",
                labelCol=target,
                predictionCol=f"{PREDICTION}{target}",
                numTrees=self.trees,
                maxDepth=self.depth,
                featureSubsetStrategy="all",
                seed=SEED,
            )
            stages.append(forest.fit(rows))
        self.model = PipelineModel(stages)

    def predict(self, df: DataFrame) -> DataFrame:
        wanted = [*df.columns, *[f"{PREDICTION}{target}" for target in self.targets]]
        return self.model.transform(df).select(*wanted)

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/pipeline")
        document = {"kind": "forest", "feature_columns": self.feature_columns, "targets": list(self.targets)}
        write_json_document(SparkSession.active(), {**document, "name": self.name}, f"{path}/document")


def _linear_model(regressor: LinearRegression, slopes: np.ndarray, intercept: float) -> LinearRegressionModel:
    """A fitted stage from known weights, so that it scores and is saved like any other."""
    context = SparkSession.active().sparkContext
    weights = _py2java(context, Vectors.dense(slopes.tolist()))
    made = context._jvm.org.apache.spark.ml.regression.LinearRegressionModel(regressor.uid, weights, intercept)
    return regressor._copyValues(LinearRegressionModel(made))


@dataclass
class SequenceForecaster:
    """A regressor per target on the flattened scaled rows before each row, fitted on the scaled target.

    The linear family is fitted from sums over the rows as they are (``normal_equations``); a boosted one reads
    windows that are built from the stored rows while it is fitted. No window is written.
    """

    feature_columns: list[str]
    lookback: int = S.MAX_LOOKBACK
    targets: Sequence[str] = tuple(S.TARGET_COLUMNS)
    family: str = "linear"
    tie_break: Sequence[str] = (S.SPLIT,)
    name: str = "sequence"
    model: PipelineModel | None = None
    target_scale: dict[str, tuple[float, float]] = field(default_factory=dict)
    residual_std: dict[str, float] = field(default_factory=dict)

    def history_rows(self) -> int:
        return self.lookback

    def _windows(self, df: DataFrame, scaled: DataFrame | None = None) -> DataFrame:
        rows = self.model.stages[0].transform(df) if scaled is None else scaled
        spec = FeatureSpec(tie_break=self.tie_break)
        built = sequences(rows, scaled_names(self.feature_columns), self.lookback, spec, into="_steps")
        flat = array_to_vector(F.flatten("_steps")).alias("_vector")
        return built.select(*_without_positions(df), flat)

    def _regressor(self, target: str):
        options = {"featuresCol": "_vector", "labelCol": f"_scaled_{target}", "predictionCol": f"_fit_{target}"}
        if self.family == "boosted":
            return GBTRegressor(seed=SEED, **options)
        return LinearRegression(regParam=PENALTY, **options)

    def fit(self, train: DataFrame, validation: DataFrame) -> None:
        stages = [scale_stage(column_statistics(train, self.feature_columns))]
        self.model = PipelineModel(stages)
        self.target_scale = {
            name: (mean, deviation or 1.0) for name, (mean, deviation) in mean_and_deviation(train, self.targets).items()
        }
        labels = [
            ((F.col(name) - mean) / deviation).alias(f"_scaled_{name}") for name, (mean, deviation) in self.target_scale.items()
        ]
        spec = FeatureSpec(tie_break=self.tie_break)
        positions = [name for name in (ROW, ROWS) if name in train.columns]
        scaled = stages[0].transform(train).select(spec.site, *spec.order, *positions, *self.step_columns(), *labels)
        rows = scaled if positions else index_rows(scaled, [spec.site], spec.order)
        if self.family == "boosted":
            windows = self._windows(rows, rows).select("_vector", *[f"_scaled_{name}" for name in self.targets])
            stages += [self._regressor(target).fit(windows) for target in self.targets]
        else:
            names = [f"_scaled_{name}" for name in self.targets]
            moments = window_moments(rows, spec.site, self.step_columns(), names, self.lookback, spec.block_rows)
            stages += [_linear_model(self._regressor(target), *moments.ridge(i, PENALTY)) for i, target in enumerate(self.targets)]
        self.model = PipelineModel(stages)
        spread = self.predict(validation).agg(
            *[F.stddev_pop(F.col(name) - F.col(f"{PREDICTION}{name}")).alias(name) for name in self.targets]
        )
        self.residual_std = {name: value or 0.0 for name, value in spread.first().asDict().items()}

    def predict(self, df: DataFrame) -> DataFrame:
        return self._fitted(self._windows(df), _without_positions(df))

    def step_columns(self) -> list[str]:
        """Scaled columns that make up one step of a sequence."""
        return scaled_names(self.feature_columns)

    def predict_steps(self, df: DataFrame, keep: Sequence[str], steps: str = "_steps") -> DataFrame:
        """Predictions for rows that carry the scaled vectors of the rows before them."""
        return self._fitted(df.select(*keep, array_to_vector(F.flatten(steps)).alias("_vector")), keep)

    def _fitted(self, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
        for fitted in self.model.stages[1:]:
            rows = fitted.transform(rows)
        unscaled = [
            (F.col(f"_fit_{name}") * deviation + mean).alias(f"{PREDICTION}{name}")
            for name, (mean, deviation) in self.target_scale.items()
        ]
        return rows.select(*keep, *unscaled)

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/pipeline")
        document = {
            "kind": "sequence",
            "name": self.name,
            "feature_columns": self.feature_columns,
            "targets": list(self.targets),
            "lookback": self.lookback,
            "family": self.family,
            "tie_break": list(self.tie_break),
            "target_scale": {name: list(pair) for name, pair in self.target_scale.items()},
            "residual_std": self.residual_std,
        }
        write_json_document(SparkSession.active(), document, f"{path}/document")


@dataclass
class LeastSquaresForecaster:
    """A line per target, fitted in closed form: means and covariances in one aggregate, solved on the driver.

    What reaches the driver are (columns + 1)^2 numbers per target, whatever the rows. Rows with an unknown feature
    or target take no part in the fit and get no prediction. Of columns that determine each other the solution of
    least norm is taken.
    """

    feature_columns: list[str]
    targets: Sequence[str] = tuple(S.TARGET_COLUMNS)
    name: str = "least_squares"
    weights: dict[str, list[float]] = field(default_factory=dict)  # intercept first
    residual_std: dict[str, float] = field(default_factory=dict)

    def history_rows(self) -> int:
        return 0

    def fit(self, train: DataFrame, validation: DataFrame | None = None) -> None:
        cells = []
        for target in self.targets:
            complete = F.col(target).isNotNull()
            for name in self.feature_columns:
                complete &= F.col(name).isNotNull()
            known = [F.when(complete, F.col(name).cast("double")) for name in (*self.feature_columns, target)]
            moments = [F.coalesce(F.covar_pop(x, y), F.lit(0.0)) for i, x in enumerate(known) for y in known[i:]]
            cells.append(F.array(*[F.coalesce(F.avg(x), F.lit(0.0)) for x in known], *moments).alias(target))
        found = train.agg(*cells).first()
        k = len(self.feature_columns)
        for target in self.targets:
            means, moments = np.array(found[target][: k + 1]), found[target][k + 1 :]
            spread = np.zeros((k + 1, k + 1))
            spread[np.triu_indices(k + 1)] = moments
            spread = spread + np.triu(spread, 1).T
            scale = np.sqrt(np.where(np.diag(spread)[:k] > 0, np.diag(spread)[:k], 1.0))
            slopes = np.linalg.lstsq(spread[:k, :k] / np.outer(scale, scale), spread[:k, k] / scale, rcond=None)[0] / scale
            self.weights[target] = [float(means[k] - slopes @ means[:k]), *slopes.tolist()]
        if validation is not None:
            errors = [F.stddev_pop(F.col(name) - F.col(f"{PREDICTION}{name}")).alias(name) for name in self.targets]
            spread = self.predict(validation).agg(*errors).first().asDict()
            self.residual_std = {name: value or 0.0 for name, value in spread.items()}

    def predict(self, df: DataFrame) -> DataFrame:
        lines = {}
        for target, (intercept, *slopes) in self.weights.items():
            line = F.lit(intercept)
            for name, slope in zip(self.feature_columns, slopes, strict=True):
                line = line + F.col(name).cast("double") * F.lit(slope)
            lines[f"{PREDICTION}{target}"] = line
        return df.select(*_without_positions(df), *[line.alias(name) for name, line in lines.items()])

    def save(self, path: str) -> None:
        document = {key: getattr(self, key) for key in ("name", "feature_columns", "weights", "residual_std")}
        document = {"kind": "least_squares", "targets": list(self.targets), **document}
        write_json_document(SparkSession.active(), document, f"{path}/document")


def _load_least_squares(spark: SparkSession, path: str, document: dict) -> LeastSquaresForecaster:
    return LeastSquaresForecaster(**{key: value for key, value in document.items() if key != "kind"})


def _load_forest(spark: SparkSession, path: str, document: dict) -> ForestForecaster:
    model = PipelineModel.load(f"{path}/pipeline")
    return ForestForecaster(document["feature_columns"], document["targets"], name=document["name"], model=model)


def _load_sequence(spark: SparkSession, path: str, document: dict) -> SequenceForecaster:
    kept = {key: document[key] for key in ("feature_columns", "lookback", "targets", "family", "tie_break", "name", "residual_std")}
    scale = {key: tuple(pair) for key, pair in document["target_scale"].items()}
    return SequenceForecaster(**kept, model=PipelineModel.load(f"{path}/pipeline"), target_scale=scale)


class ModelRegistry:
    """Saved models by name under one folder, with the metadata document of their training job.

    A saved model has a document whose ``kind`` says how to load it. ``loaders`` adds kinds of one's own: a
    function of session, folder and document.
    """

    def __init__(self, spark: SparkSession, root: str, loaders: dict[str, Callable] | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        known = {"forest": _load_forest, "sequence": _load_sequence, "least_squares": _load_least_squares}
        self.loaders = {**known, **(loaders or {})}

    def path(self, name: str) -> str:
        return f"{self.root}/models/{name}"

    def save(self, forecaster: Forecaster) -> None:
        forecaster.save(self.path(forecaster.name))

    def save_metadata(self, metadata: dict) -> None:
        write_json_document(self.spark, metadata, f"{self.root}/metadata")

    def metadata(self) -> dict:
        return read_json_document(self.spark, f"{self.root}/metadata")

    def load(self, name: str) -> Forecaster:
        if name not in self.metadata()["available_models"]:
            raise KeyError(f"Unknown model: {name}")
        document = read_json_document(self.spark, f"{self.path(name)}/document")
        if document["kind"] not in self.loaders:
            raise KeyError(f"No loader for models of kind {document['kind']}")
        return self.loaders[document["kind"]](self.spark, self.path(name), document)


def latest_with_history(df: DataFrame, horizon: int, history: int, order: Sequence[str]) -> DataFrame:
    """The rows a model needs to predict the last ``horizon`` rows of every site."""
    return latest_rows(df, horizon + history, S.SITE, order)
