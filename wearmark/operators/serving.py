"""Batch serving: one terminal prediction per unit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.text import read_labels, read_trajectories
from .evaluate import metric_columns
from .features import features_at, legacy_features
from .models import clip_predictions, predict
from .segments import ORDER, UNIT


def history_warning(n: Column, w: int) -> Column:
    """Warning text for short histories, NULL for full windows."""
    # Fixed value: the wording of the warning.
    text = F.format_string(
        f"Limited observed history: only %d cycles observed; window {w} -> %d timesteps padded.",
        n.cast("long"),
        (F.lit(w) - n).cast("long"),
    )
    return F.when(n < w, text)


def _terminal(df: DataFrame, u: str, o: str) -> DataFrame:
    """Last cycle and number of rows of every unit, from one aggregation."""
    return df.groupBy(u).agg(F.max(o).alias("cutoff_cycle"), F.count(F.lit(1)).alias("n_cycles_observed"))


def serve_batch(
    df: DataFrame,
    model,
    q: float,
    cols: Sequence[str],
    w: int,
    mode: str = "windowed",
    version: str = "v1",
    u: str = UNIT,
    o: str = ORDER,
    gapless: bool = False,
) -> DataFrame:
    """Terminal prediction with interval, padding facts and the short-history warning.

    The default mode reads the last ``w`` rows, as the models are trained.
    """
    missing = {u, o} - set(df.columns)
    if missing:
        raise ValueError(f"frame must contain {sorted(missing)}")
    if mode not in ("full", "windowed"):
        raise ValueError("mode must be 'full' or 'windowed'")
    features = features_at(
        df, _terminal(df, u, o), cols, None if mode == "full" else w, u, o, gapless
    )
    scored = predict(features, model)
    n = F.col("n_cycles_observed")
    return scored.select(
        u,
        F.lit(version).alias("model_version"),
        "n_cycles_observed",
        (n < w).alias("history_is_padded"),
        F.greatest(F.lit(w) - n, F.lit(0)).cast("long").alias("n_padded_timesteps"),
        (F.round("prediction", 2) + F.lit(0.0)).alias("prediction_raw_rul"),
        (F.round(F.col("prediction") - q, 2) + F.lit(0.0)).alias("lo"),
        (F.round(F.col("prediction") + q, 2) + F.lit(0.0)).alias("hi"),
        F.round(F.lit(2.0 * q), 2).alias("interval_width"),
        history_warning(n, w).alias("warning"),
    )


def fleet_padding(served: DataFrame) -> DataFrame:
    return served.agg(
        F.count(F.lit(1)).alias("units"), F.count_if("history_is_padded").alias("padded_units")
    )


def serve_capped(
    df: DataFrame,
    model,
    cols: Sequence[str],
    w: int,
    cap: float,
    u: str = UNIT,
    o: str = ORDER,
    gapless: bool = False,
) -> DataFrame:
    """Older capped predictor on zero-padded windows; prediction within 0..cap."""
    features = legacy_features(df, _terminal(df, u, o), cols, w, u, o, gapless)
    # the capped model knows the age as the number of observed cycles
    features = features.withColumn("engine_age", F.col("n_cycles_observed").cast("double"))
    return clip_predictions(predict(features, model), cap).select(
        u,
        F.col("n_cycles_observed").alias("n_cycles"),
        (F.col("n_cycles_observed") < w).alias("padded_short"),
        F.round("prediction", 4).alias("prediction"),
    )


def capped_metrics(served: DataFrame, labels: DataFrame, cap: float, u: str = UNIT) -> DataFrame:
    joined = served.join(labels, u)
    return joined.agg(*metric_columns(F.least(F.col("true_rul"), F.lit(cap)), F.col("prediction")))


def score_file(
    spark: SparkSession,
    path: str,
    model,
    cols: Sequence[str],
    w: int,
    cap: float,
    labels: str | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """Score a trajectory text file; metrics too when a label file is given."""
    served = serve_capped(read_trajectories(spark, path), model, cols, w, cap)
    if labels is None:
        return served, None
    return served, capped_metrics(served, read_labels(spark, labels), cap)
