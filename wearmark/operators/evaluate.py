"""Metrics, per-unit scores and drift checks."""

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import as_column, asymmetric_score, finite
from .checkpoints import terminal_manifest
from .features import features_at
from .models import predict
from .segments import ORDER, SEGMENT, SEGMENT_ROWS, UNIT, segment_of


def metric_columns(y: str | Column, p: str | Column, prefix: str = "") -> list[Column]:
    """RMSE, MAE, R2 (NULL when the target never varies), score sum and mean, bias, spread."""
    y, p = as_column(y).cast("double"), as_column(p).cast("double")
    e = p - y
    total = F.count(y) * F.var_pop(y)
    return [
        F.sqrt(F.avg(e * e)).alias(f"{prefix}rmse"),
        F.avg(F.abs(e)).alias(f"{prefix}mae"),
        F.when(F.min(y) < F.max(y), 1.0 - F.sum(e * e) / total).alias(f"{prefix}r2"),
        F.sum(asymmetric_score(y, p)).alias(f"{prefix}score_total"),
        F.avg(asymmetric_score(y, p)).alias(f"{prefix}score_mean"),
        F.avg(e).alias(f"{prefix}bias"),
        F.stddev_pop(p).alias(f"{prefix}prediction_std"),
        F.count(F.lit(1)).alias(f"{prefix}n"),
    ]


def metrics(
    df: DataFrame, y: str | Column = "true_raw_rul", p: str | Column = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    return df.groupBy(*by).agg(*metric_columns(y, p))


def clipped_and_raw_metrics(
    df: DataFrame, cap: float, y: str = "true_rul", p: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """Metrics against clipped and raw labels side by side, one pass."""
    clipped = F.least(F.col(y), F.lit(float(cap)))
    return df.groupBy(*by).agg(
        *metric_columns(clipped, p, "clipped_"), *metric_columns(F.col(y), p, "raw_")
    )


def per_unit_metrics(
    df: DataFrame,
    keys: Sequence[str] = ("candidate_id", "fold", UNIT),
    y: str = "true_raw_rul",
    p: str = "prediction",
) -> DataFrame:
    """RMSE, MAE, score sum and bias over the checkpoints of each unit."""
    e = F.col(p) - F.col(y)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_checkpoints"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.sum(asymmetric_score(y, p)).alias("score_sum"),
        F.avg(e).alias("bias"),
    )


def fold_rows(
    df: DataFrame, keys: Sequence[str] = ("candidate_id", "fold"), u: str = UNIT,
    y: str = "true_raw_rul", p: str = "prediction",
) -> DataFrame:
    """Metric row per candidate and fold, with the score averaged over units."""
    flat = df.groupBy(*keys).agg(*metric_columns(y, p))
    units = (
        per_unit_metrics(df, [*keys, u], y, p)
        .groupBy(*keys)
        .agg(F.avg("score_sum").alias("score_per_unit"), F.count(F.lit(1)).alias("units"))
    )
    return flat.join(units, list(keys))


def evaluate_manifest(
    df: DataFrame,
    manifest: DataFrame,
    model,
    cols: Sequence[str],
    w: int | None = None,
    u: str = UNIT,
    o: str = ORDER,
    gapless: bool = False,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """One prediction per manifest line from rows at or before its cutoff.

    Every line must get a prediction: a line without observed rows is an error.
    """
    found = predict(features_at(df, manifest, cols, w, u, o, gapless, segment_rows), model)
    scored = found.select(u, "cutoff_cycle", "prediction")
    joined = manifest.join(scored.dropDuplicates([u, "cutoff_cycle"]), [u, "cutoff_cycle"], "left")
    message = F.concat(F.lit("no prediction for unit "), F.col(u).cast("string"))
    ok = F.col("prediction").isNotNull()
    return joined.withColumn(
        "prediction", F.when(ok, F.col("prediction")).otherwise(F.raise_error(message).cast("double"))
    )


def evaluate_with_callable(
    df: DataFrame,
    manifest: DataFrame,
    predict_one: Callable[[pd.DataFrame, int], float],
    w: int,
    preprocess: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
    u: str = UNIT,
    o: str = ORDER,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Manifest evaluation with an arbitrary Python scorer over the last ``w`` cycles.

    Each call sees at most ``w`` cycles of one unit, so no group grows with the
    trajectory; the scorer is told the cutoff. Rows reach Python sorted, a frame
    of many checkpoints at a time, not one transfer per checkpoint.
    """
    size = max(segment_rows, w)
    keys = manifest.select(u, "cutoff_cycle").distinct()
    low = F.greatest(segment_of(F.col("cutoff_cycle") - (w - 1), size), F.lit(0))
    spread = keys.withColumn(SEGMENT, F.explode(F.sequence(low, segment_of("cutoff_cycle", size))))
    near = (
        df.withColumn(SEGMENT, segment_of(o, size))
        .join(spread, [u, SEGMENT])
        .filter((F.col(o) <= F.col("cutoff_cycle")) & (F.col(o) > F.col("cutoff_cycle") - w))
        .drop(SEGMENT)
    )
    id_type = df.schema[u].dataType.simpleString()

    def score(frame: pd.DataFrame, borders: Sequence[int]) -> pd.DataFrame:
        rows = frame.drop(columns=["cutoff_cycle"])
        firsts = frame[[u, "cutoff_cycle"]].iloc[list(borders[:-1])].reset_index(drop=True)
        values = []
        for low, high, cutoff in zip(borders, borders[1:], firsts["cutoff_cycle"]):
            history = rows.iloc[low:high].reset_index(drop=True)
            if preprocess is not None:
                history = preprocess(history)
            values.append(float(predict_one(history, int(cutoff))))
        return firsts.assign(prediction=pd.Series(values, dtype=float))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in frames:
            if rest is not None:
                frame = pd.concat([rest, frame], ignore_index=True)
            if not len(frame):
                continue
            ids, cuts = frame[u].to_numpy(), frame["cutoff_cycle"].to_numpy()
            starts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]) | (cuts[1:] != cuts[:-1])) + 1).tolist()]
            # the last checkpoint may go on in the next frame; it has at most w rows
            rest = frame.iloc[starts[-1] :]
            if len(starts) > 1:
                yield score(frame, starts)
        if rest is not None:
            yield score(rest, [0, len(rest)])

    dealt = near.repartition(u, "cutoff_cycle").sortWithinPartitions(u, "cutoff_cycle", o)
    scored = dealt.mapInPandas(run, f"{u} {id_type}, cutoff_cycle long, prediction double")
    joined = manifest.join(scored, [u, "cutoff_cycle"], "left")
    message = F.concat(F.lit("no prediction for unit "), F.col(u).cast("string"))
    return joined.withColumn(
        "prediction",
        F.when(F.col("prediction").isNotNull(), F.col("prediction")).otherwise(
            F.raise_error(message).cast("double")
        ),
    )


def evaluate_terminal(
    df: DataFrame,
    labels: DataFrame,
    model,
    cols: Sequence[str],
    w: int | None = None,
    u: str = UNIT,
    o: str = ORDER,
    gapless: bool = False,
) -> DataFrame:
    """Predictions at the last observed cycle joined to the true labels; finite or error."""
    scored = evaluate_manifest(df, terminal_manifest(df, u, o), model, cols, w, u, o, gapless)
    message = F.concat(F.lit("prediction is not finite for unit "), F.col(u).cast("string"))
    checked = F.when(finite("prediction"), F.col("prediction")).otherwise(
        F.raise_error(message).cast("double")
    )
    return scored.withColumn("prediction", checked).join(labels, u)


def prediction_table(df: DataFrame, w: int, u: str = UNIT, digits: int = 4) -> DataFrame:
    """Publication table: padded flag, integer label, rounded prediction."""
    return df.select(
        u,
        "n_cycles",
        (F.col("n_cycles") < w).alias("padded_short"),
        F.col("true_rul").cast("long").alias("true_rul"),
        F.round("prediction", digits).alias("prediction"),
    )


def long_metrics(df: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Wide metric rows to ``(keys..., metric, value)``."""
    cells = F.explode(
        F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    )
    return df.select(*keys, cells.alias("_m")).select(*keys, "_m.*")


def drift_check(
    actual: DataFrame, recorded: DataFrame, keys: Sequence[str], tol: float = 1e-3
) -> DataFrame:
    """Recorded against recomputed values; a value missing on either side fails."""
    left = actual.withColumnRenamed("value", "actual")
    right = recorded.withColumnRenamed("value", "recorded")
    joined = left.join(right, list(keys), "full_outer")
    gap = F.abs(F.col("actual") - F.col("recorded"))
    return joined.withColumn("gap", gap).withColumn("passed", F.coalesce(gap <= tol, F.lit(False)))


def falsify(
    predictions: DataFrame,
    recorded: DataFrame,
    by: Sequence[str],
    names: Sequence[str] = ("rmse", "mae", "r2", "score_total"),
    tol: float = 1e-3,
    y: str = "true_raw_rul",
    p: str = "prediction",
) -> DataFrame:
    """Recompute metrics from stored predictions and compare with the stored metrics."""
    fresh = long_metrics(metrics(predictions, y, p, by), by, names)
    return drift_check(fresh, long_metrics(recorded, by, names), [*by, "metric"], tol)
