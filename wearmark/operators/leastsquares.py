"""Least squares of every cross-validation fold from one scan.

Each fold is reduced to its centred moments (count, means, scatter of inputs and
label), which are additive: the moments of a training set are those of the other
folds put together, by Chan's merge, so nothing large is subtracted and no
digits are lost. A fold's model is then one small solve.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

# Partial moments put together in one piece.
PARTS = 64
# Directions with less than this part of the largest variance are left out.
RANK_CUT = 1e-13
PARTIAL = "fold int, part int, n long, mean binary, scatter binary"


@dataclass
class Moments:
    """Count, means and centred scatter of some rows; the label is the last column."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        if not self.n or not other.n:
            return other if not self.n else self
        n = self.n + other.n
        apart = other.mean - self.mean
        return Moments(
            n,
            self.mean + apart * (other.n / n),
            self.scatter + other.scatter + np.outer(apart, apart) * (self.n * other.n / n),
        )

    @classmethod
    def of(cls, table: np.ndarray) -> Moments:
        mean = table.mean(axis=0)
        apart = table - mean
        return cls(len(table), mean, apart.T @ apart)

    def packed(self, fold: int, part: int) -> tuple:
        return int(fold), int(part), int(self.n), self.mean.tobytes(), self.scatter.tobytes()

    @classmethod
    def unpacked(cls, line) -> Moments:
        mean = np.frombuffer(line["mean"])
        return cls(int(line["n"]), mean, np.frombuffer(line["scatter"]).reshape(len(mean), -1))


def fold_moments(
    rows: DataFrame, inputs: Sequence[str], label: str = "rul", fold: str = "fold"
) -> dict[int, Moments]:
    """Moments of every fold; one line per fold and task is shuffled, one per fold reaches the driver.

    Rows with a null, in a column that counts, are left out.
    """
    names = [*inputs, label]
    source = rows.select(F.col(fold).cast("int").alias("fold"), *[F.col(c).cast("double").alias(c) for c in names])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Moments] = {}
        for batch in batches:
            table = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
            folds = batch.column("fold").to_numpy(zero_copy_only=False)
            known = ~np.isnan(table).any(axis=1)
            for f in np.unique(folds[known]):
                found = Moments.of(table[known & (folds == f)])
                held[int(f)] = held[int(f)] + found if int(f) in held else found
        part = TaskContext.get().partitionId()
        lines = [m.packed(f, part) for f, m in held.items()]
        if lines:
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
            columns = [pa.array(list(c), kind) for c, kind in zip(zip(*lines), kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["fold", "part", "n", "mean", "scatter"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")  # one order of adding, so reruns agree
        total = sum((Moments.unpacked(r) for _, r in group.iterrows()), Moments(0, np.empty(0), np.empty((0, 0))))
        line = total.packed(group["fold"].iloc[0], group["part"].iloc[0])
        return pd.DataFrame([line], columns=["fold", "part", "n", "mean", "scatter"])

    parts = source.filter(F.col("fold").isNotNull()).mapInArrow(reduce, PARTIAL)
    some = parts.groupBy("fold", F.floor(F.col("part") / PARTS).alias("_p")).applyInPandas(add, PARTIAL)
    lines = some.groupBy("fold").applyInPandas(add, PARTIAL).collect()
    return {r["fold"]: Moments.unpacked(r) for r in sorted(lines, key=lambda r: r["fold"])}


def solved(moments: Moments) -> tuple[float, np.ndarray]:
    """Intercept and weights; inputs without variance, or that repeat others, share the least weights that fit."""
    xx, xy = moments.scatter[:-1, :-1], moments.scatter[:-1, -1]
    scale = np.sqrt(np.diag(xx))
    scale = np.where(scale > 0, scale, 1.0)
    values, axes = np.linalg.eigh(xx / np.outer(scale, scale))
    kept = values > RANK_CUT * max(values.max(initial=0.0), 1e-300) * len(values)
    inverse = np.where(kept, 1 / np.where(kept, values, 1.0), 0.0)
    weights = axes @ (inverse * (axes.T @ (xy / scale))) / scale
    return float(moments.mean[-1] - weights @ moments.mean[:-1]), weights


def training_moments(folds: dict[int, Moments]) -> dict[int, Moments]:
    """Per fold the moments of all other folds together."""
    none = Moments(0, np.empty(0), np.empty((0, 0)))
    return {f: sum((m for g, m in folds.items() if g != f), none) for f in folds}


def fold_models(
    rows: DataFrame, inputs: Sequence[str], label: str = "rul", fold: str = "fold"
) -> DataFrame:
    """``fold, n, intercept, weights, mean_label`` fitted on the rows outside each fold; one line per fold.

    A fold without other folds has no training rows and so no line.
    """
    lines = []
    for f, m in training_moments(fold_moments(rows, inputs, label, fold)).items():
        if m.n:
            intercept, weights = solved(m)
            lines.append((f, m.n, intercept, [float(w) for w in weights], float(m.mean[-1])))
    return rows.sparkSession.createDataFrame(
        lines, "fold int, n long, intercept double, weights array<double>, mean_label double"
    )


def predict_held_out(rows: DataFrame, models: DataFrame, inputs: Sequence[str], mean_only: bool = False) -> DataFrame:
    """``rows`` with the ``prediction`` of the model that did not see their fold; folds are few, so models are broadcast."""
    value = F.col("mean_label")
    if not mean_only:
        value = F.col("intercept")
        for i, c in enumerate(inputs):
            value = value + F.get("weights", F.lit(i)) * F.col(c)
    known = models.select("fold", "intercept", "weights", "mean_label")
    return (
        rows.join(F.broadcast(known), "fold")
        .withColumn("prediction", value)
        .drop("intercept", "weights", "mean_label")
    )
