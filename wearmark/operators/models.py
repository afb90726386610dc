"""Spark ML regressors behind one small factory."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from .segments import UNIT
from .splits import final_fit_units

# Default hyperparameters of the tree learners.
FOREST = {"numTrees": 300, "maxDepth": 30, "seed": 42}
BOOSTED = {
    "maxIter": 500,
    "maxDepth": 6,
    "stepSize": 0.05,
    "subsamplingRate": 0.8,
    "featureSubsetStrategy": "0.8",
    "seed": 42,
}
PATIENCE = 30

Scorer = Callable[[DataFrame], DataFrame]


class MeanModel:
    """Predicts the mean target of the training rows; the mean stays a one-row table."""

    def __init__(self, mean: DataFrame):
        self.mean = mean

    def transform(self, df: DataFrame) -> DataFrame:
        return df.crossJoin(F.broadcast(self.mean))


class FormulaModel:
    """Fixed linear formula over feature columns; used where SQL must give the same answer."""

    def __init__(self, intercept: float, weights: dict[str, float], digits: int | None = None):
        self.intercept, self.weights, self.digits = intercept, weights, digits

    def transform(self, df: DataFrame) -> DataFrame:
        value = F.lit(self.intercept)
        for name, weight in self.weights.items():
            value = value + F.lit(weight) * F.col(name)
        if self.digits is not None:
            value = F.round(value, self.digits) + F.lit(0.0)
        return df.withColumn("prediction", value)


def make_estimator(name: str, params: dict | None = None, label: str = "rul"):
    """Spark ML estimator by name; ``params`` override the defaults."""
    params = params or {}
    common = {"featuresCol": "features", "labelCol": label, "predictionCol": "prediction"}
    if name == "linear":
        return LinearRegression(**common, **{"regParam": 0.0, "solver": "normal", **params})
    if name == "forest":
        return RandomForestRegressor(**common, **{**FOREST, **params})
    if name == "boosted":
        return GBTRegressor(**common, **{**BOOSTED, **params})
    raise ValueError(f"unknown model: {name}")


def fit_model(
    name: str, features: DataFrame, inputs: Sequence[str], params: dict | None = None, label: str = "rul"
):
    """Fit one model on feature rows. Scaling is left out on purpose: trees and
    plain least squares predict the same from affinely rescaled columns."""
    if name == "mean":
        return MeanModel(features.agg(F.avg(F.col(label).cast("double")).alias("prediction")))
    assembler = VectorAssembler(inputCols=list(inputs), outputCol="features")
    return Pipeline(stages=[assembler, make_estimator(name, params, label)]).fit(
        features.select(*inputs, F.col(label).cast("double").alias(label))
    )


def predict(df: DataFrame, model) -> DataFrame:
    """Add ``prediction``; helper vectors are dropped."""
    scored = model.transform(df) if hasattr(model, "transform") else model(df)
    return scored.drop("features")


def best_iteration(
    model: PipelineModel, stop: DataFrame, label: str = "rul", patience: int | None = PATIENCE
) -> int:
    """0-based round with the lowest squared error on the monitor rows.

    One distributed pass evaluates every round. With ``patience`` the search
    ends after that many rounds without improvement.
    """
    assembler, booster = model.stages[0], model.stages[-1]
    rows = assembler.transform(stop.withColumn(label, F.col(label).cast("double")))
    losses = booster.evaluateEachIteration(rows.select("features", label), "squared")
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif patience is not None and i - best >= patience:
            break
    return best


def save_model(model: PipelineModel | MeanModel | FormulaModel, path: str, spark) -> str:
    """Store a fitted model in a folder any later session can load."""
    if isinstance(model, PipelineModel):
        model.write().overwrite().save(path)
    elif isinstance(model, MeanModel):
        model.mean.write.mode("overwrite").parquet(f"{path}/mean")
    else:
        parts = [(model.intercept, model.weights, model.digits)]
        schema = "intercept double, weights map<string,double>, digits int"
        spark.createDataFrame(parts, schema).write.mode("overwrite").parquet(f"{path}/formula")
    return path


def load_model(path: str, kind: str, spark) -> PipelineModel | MeanModel | FormulaModel:
    """Load what ``save_model`` stored; ``kind`` is mean, formula or any fitted learner."""
    if kind == "mean":
        return MeanModel(spark.read.parquet(f"{path}/mean"))
    if kind == "formula":
        row = spark.read.parquet(f"{path}/formula").first()
        return FormulaModel(row["intercept"], row["weights"], row["digits"])
    return PipelineModel.load(path)


def clip_predictions(df: DataFrame, cap: float, floor: float = 0.0) -> DataFrame:
    return df.withColumn(
        "prediction", F.greatest(F.least(F.col("prediction"), F.lit(float(cap))), F.lit(float(floor)))
    )


def fit_final(
    features: DataFrame,
    assignments: DataFrame,
    name: str,
    inputs: Sequence[str],
    params: dict | None = None,
    roles: Sequence[str] = ("train", "validation"),
    u: str = UNIT,
    label: str = "rul",
):
    """Final fit on the development population; calibration units never enter."""
    allowed = final_fit_units(assignments, roles, u)
    return fit_model(name, features.join(allowed, u, "left_semi"), inputs, params, label)


def score_sequences(
    seqs: DataFrame, predict_batch: Callable[[np.ndarray, np.ndarray], np.ndarray], w: int
) -> DataFrame:
    """Score padded windows with any sequence model, Arrow batch by Arrow batch.

    ``predict_batch(X, mask)`` gets float32 arrays of shape (n, w, features) and
    (n, w) and returns n predictions.
    """
    schema = seqs.drop("seq", "mask").withColumn("prediction", F.lit(0.0)).schema

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch.drop(columns=["seq", "mask"])
            if len(batch):
                x = np.stack([np.stack(s) for s in batch["seq"]]).astype(np.float32)
                m = np.stack(batch["mask"].to_numpy()).astype(np.float32)
                if x.shape[1] != w:
                    raise ValueError(f"windows have {x.shape[1]} rows, the model expects {w}")
                out["prediction"] = np.asarray(predict_batch(x, m), dtype=float).reshape(-1)
            else:
                out["prediction"] = pd.Series(dtype=float)
            yield out

    return seqs.mapInPandas(score, schema)
