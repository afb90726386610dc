"""Operating regimes: clustering of settings, scaling per regime, input variants."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .scaling import apply_scaler, fit_scaler

VARIANTS = ("A", "B", "C", "D")
SEED_ROUNDS = 3  # of drawing candidates for centres
OVERSAMPLE = 2  # candidates per round and wanted centre
LLOYD_ROUNDS = 50
MOVED = 1e-6  # centres that move less, in any start, are at rest


@dataclass
class RegimeModel:
    """Centres of the regimes, in ascending order, and the squared distance they leave."""

    centers: np.ndarray
    cost: float
    costs: list[float]  # of every start
    passes: int  # scans of the rows that the fit took

    def regime(self, settings: Sequence[str]) -> Column:
        """Nearest centre; the first of equally near ones. Null when a setting is."""
        parts = []
        for i, centre in enumerate(self.centers):
            gaps = [F.col(c).cast("double") - F.lit(float(v)) for c, v in zip(settings, centre)]
            far = sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])
            parts.append(F.struct(far.alias("far"), F.lit(i).alias("regime")))
        # pairs are ordered by distance, then number, so every distance is worked out once
        nearest = F.least(*parts) if len(parts) > 1 else parts[0]
        return F.when(parts[0]["far"].isNotNull(), nearest["regime"])


def _distances(table: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres, as differences so that near ones keep their digits."""
    out = np.zeros((len(table), len(centres)))
    for j in range(table.shape[1]):
        out += (table[:, j, None] - centres[None, :, j]) ** 2
    return out


ROWS = "_rows"


def _places(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Every different point with known settings once, and how many rows hold it.

    Settings take few values, so scans of the places cost far less than scans of
    the rows; where all rows differ they cost the same.
    """
    known = df.select(*[F.col(c).cast("double").alias(c) for c in names]).dropna()
    counted = known.groupBy(*names).agg(F.count(F.lit(1)).cast("double").alias(ROWS))
    return counted.sortWithinPartitions(*names)  # draws are alike in every run


def _tables(
    batches: Iterator[pa.RecordBatch], names: Sequence[str], rows: int = 8192
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Points and the rows at each."""
    for batch in batches:
        table = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in [*names, ROWS]])
        table = table[np.isfinite(table).all(axis=1)]
        for low in range(0, len(table), rows):
            yield table[low : low + rows, :-1], table[low : low + rows, -1]


def _step(points: DataFrame, names: list[str], starts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Per start: rows, sums of (row - centre) and cost of each centre's rows, all starts from one scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(c), len(names) + 2)) for c in starts]
        seen = False
        for table, held in _tables(batches, names):
            seen = True
            for total, centres in zip(sums, starts):
                apart = _distances(table, centres)
                near = apart.argmin(axis=1)
                total[:, 0] += np.bincount(near, held, len(centres))
                total[:, 1] += np.bincount(near, held * apart[np.arange(len(near)), near], len(centres))
                for j in range(len(names)):
                    total[:, 2 + j] += np.bincount(near, held * (table[:, j] - centres[near, j]), len(centres))
        if seen:
            keys = [(s, c) for s, total in enumerate(sums) for c in range(len(total))]
            flat = np.concatenate(sums)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in keys], pa.int32()),
                    pa.array([k[1] for k in keys], pa.int32()),
                    *[pa.array(flat[:, j]) for j in range(flat.shape[1])],
                ],
                names=["start", "centre", *[f"v{j}" for j in range(flat.shape[1])]],
            )

    values = [f"v{j}" for j in range(len(names) + 2)]
    found = points.mapInArrow(run, "start int, centre int, " + ", ".join(f"{v} double" for v in values))
    # one line per start and centre comes back
    lines = found.groupBy("start", "centre").agg(*[F.sum(v).alias(v) for v in values]).collect()
    tables = [np.zeros((len(c), len(values))) for c in starts]
    for r in lines:
        tables[r["start"]][r["centre"]] = [r[v] for v in values]
    return [(t[:, 0], t[:, 2:], float(t[:, 1].sum())) for t in tables]


def _candidates(points: DataFrame, names: list[str], k: int, seed: int, n_init: int) -> tuple[list[np.ndarray], int]:
    """Scalable seeding of all starts together: rows far from a start's candidates are likelier to become one."""
    # the least of these waiting times falls on a place as often as one of its rows is drawn
    waits = {f"_wait{s}": -F.log1p(-F.rand(seed + s)) / F.col(ROWS) for s in range(n_init)}
    first = points.withColumns(waits).agg(*[F.min_by(F.array(*names), wait).alias(wait) for wait in waits]).first()
    if first[0] is None:
        raise ValueError("no rows with known settings")
    chosen = [np.array([list(point)]) for point in first]
    passes = 1
    for turn in range(SEED_ROUNDS):
        costs = [found[2] for found in _step(points, names, chosen)]
        passes += 2
        wanted = OVERSAMPLE * k
        held = chosen

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # a task draws alike whenever it is run again
            rng = np.random.default_rng([seed, turn, TaskContext.get().partitionId()])
            for table, rows in _tables(batches, names):
                for s, (centres, cost) in enumerate(zip(held, costs)):
                    far = _distances(table, centres).min(axis=1)
                    share = np.minimum(wanted * far / max(cost, 1e-300), 1.0)
                    # a place is drawn when any of its rows is
                    with np.errstate(divide="ignore"):
                        taken = table[rng.random(len(table)) < -np.expm1(rows * np.log1p(-share))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([s] * len(taken), pa.int32()), *[pa.array(taken[:, j]) for j in range(len(names))]],
                        names=["start", *names],
                    )

        kind = "start int, " + ", ".join(f"`{c}` double" for c in names)
        # about wanted rows per start: the shares add up to that
        for r in points.mapInArrow(draw, kind).distinct().orderBy("start", *names).collect():
            chosen[r["start"]] = np.vstack([chosen[r["start"]], [list(r)[1:]]])
    return chosen, passes


def _seeded(candidates: np.ndarray, weights: np.ndarray, k: int, rng) -> np.ndarray:
    """``k`` of a start's weighted candidates, each likelier the farther it is from those chosen before."""
    centres = [candidates[rng.choice(len(candidates), p=weights / weights.sum())]]
    while len(centres) < k:
        pull = weights * _distances(candidates, np.array(centres)).min(axis=1)
        if not pull.sum() > 0:
            centres.append(centres[0])  # fewer different rows than centres
        else:
            centres.append(candidates[rng.choice(len(candidates), p=pull / pull.sum())])
    return np.array(centres)


def fit_regimes(
    df: DataFrame, settings: Sequence[str], k: int = 6, seed: int = 42, n_init: int = 10
) -> RegimeModel:
    """K-means on the settings only; the best of ``n_init`` starts.

    All starts are seeded and moved together: every scan assigns each row to the
    nearest centre of each start and brings back one line per (start, centre),
    so ten starts take the scans of one. The scans read every different point
    once, with its number of rows, which gives the sums of all rows. Rows with
    an unknown setting are left out. Regimes are numbered by ascending centre.
    """
    names = list(settings)
    points = _places(df, names).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        chosen, passes = _candidates(points, names, k, seed, n_init)
        weights = [found[0] for found in _step(points, names, chosen)]
        rng = np.random.default_rng(seed)
        starts = [_seeded(c, np.maximum(w, 1e-12), k, rng) for c, w in zip(chosen, weights)]
        passes += 1
        for _ in range(LLOYD_ROUNDS):
            found = _step(points, names, starts)
            passes += 1
            steps = [sums / np.maximum(n, 1)[:, None] for n, sums, _ in found]
            starts = [c + step for c, step in zip(starts, steps)]
            if max(np.abs(step).max() for step in steps) < MOVED:
                break
        costs = [cost for _, _, cost in _step(points, names, starts)]
    finally:
        points.unpersist()
    best = starts[int(np.argmin(costs))]
    best = best[np.lexsort(best.T[::-1])]
    return RegimeModel(best, min(costs), costs, passes + 1)


def assign_regime(df: DataFrame, model: RegimeModel, settings: Sequence[str]) -> DataFrame:
    """Nearest regime per row; nothing is refitted."""
    return df.withColumn("regime", model.regime(settings))


def one_hot_regime(df: DataFrame, k: int, regime: str = "regime") -> DataFrame:
    return df.withColumns({f"regime_{i}": (F.col(regime) == i).cast("double") for i in range(k)})


@dataclass
class Preprocessing:
    """Fitted parts of one input variant."""

    variant: str
    sensors: list[str]
    settings: list[str]
    model: RegimeModel | None = None
    sensor_params: DataFrame | None = None
    setting_params: DataFrame | None = None
    k: int = 0

    @property
    def inputs(self) -> list[str]:
        if self.variant == "A":
            return list(self.sensors)
        if self.variant == "B":
            return [*self.sensors, *self.settings]
        if self.variant == "C":
            return list(self.sensors)
        return [*self.sensors, *self.settings, *[f"regime_{i}" for i in range(self.k)]]


def fit_variant(
    df: DataFrame,
    variant: str,
    sensors: Sequence[str],
    settings: Sequence[str],
    k: int = 6,
    seed: int = 42,
    n_init: int = 10,
    like: Preprocessing | None = None,
) -> Preprocessing:
    """Fit what a variant needs on the permitted rows in ``df``.

    A: sensors, one scaler. B: sensors and settings, one scaler. C: sensors
    scaled per regime. D: as C, plus scaled settings and the regime one-hot.
    ``like`` is a variant fitted on the same rows with the same settings of the
    fit; its regimes, which would be found again, are taken over.
    """
    if variant not in VARIANTS:
        raise ValueError(f"variant must be one of {VARIANTS}")
    sensors, settings = list(sensors), list(settings)
    if variant in ("A", "B"):
        cols = sensors + (settings if variant == "B" else [])
        return Preprocessing(variant, sensors, settings, sensor_params=_kept(fit_scaler(df, cols)))
    if like is not None and like.model is not None:
        model, by_regime = like.model, like.sensor_params
    else:
        model = fit_regimes(df, settings, k, seed, n_init)
        by_regime = _kept(fit_scaler(assign_regime(df, model, settings), sensors, by=["regime"]))
    by_setting = _kept(fit_scaler(df, settings)) if variant == "D" else None
    return Preprocessing(variant, sensors, settings, model, by_regime, by_setting, k)


def _kept(params: DataFrame) -> DataFrame:
    """Fitted once, however often it is applied; one line per scope and column."""
    return params.sparkSession.createDataFrame(params.collect(), params.schema)


def variant_matrix(df: DataFrame, pre: Preprocessing) -> DataFrame:
    """Scaled inputs of a variant, row by row (a window may span several regimes)."""
    if pre.variant in ("A", "B"):
        return apply_scaler(df, pre.sensor_params, pre.inputs)
    rows = assign_regime(df, pre.model, pre.settings)
    rows = apply_scaler(rows, pre.sensor_params, pre.sensors, by=["regime"])
    if pre.variant == "D":
        rows = apply_scaler(rows, pre.setting_params, pre.settings)
        rows = one_hot_regime(rows, pre.k)
    return rows
