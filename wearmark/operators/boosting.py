"""Gradient boosting one round at a time, stopped by monitor rows while it trains.

Rows are cut into bins once: a line of the table that all rounds read holds some
thousands of rows, input by input, one byte each (two where borders are many), with
the fits they belong to and what each model leaves of their labels. Several fits,
such as those of cross-validation folds, grow side by side: a level of all their
trees is one scan, whose tasks add up residuals per fit, node, input and bin; those
sums are merged by the driver, by a shuffle where they are many, to choose the splits.
Of two sibling nodes the smaller one is scanned, the other one is what it leaves of
their parent. Every fit has its own borders, from its own rows; the table is cut at
the borders of all of them. One more scan a round takes the new trees off the
residuals and scores the monitor rows; when ``patience`` rounds bring no
improvement, no further round is fitted. The residuals are kept in memory and on
disk, and written every ``RENEW`` rounds. The result is an ordinary Spark ML
pipeline model.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import drop_table, new_table_path
from .models import BOOSTED, PATIENCE

RENEW = 10
SPLIT_ROWS = 10_000  # rows that place the borders of the bins, as Spark ML's trees take them
FITS = 16  # grown side by side; each takes two bits of a row's mark
BLOCK_BYTES = 1 << 18  # of bins that a line of the table holds at most
TABLE = "first long, bins binary, fits binary, gaps binary"
DRIVER_BYTES = 1 << 25  # of the tasks' sums that the driver adds up itself

@dataclass
class Boosted:
    """A fit: its 0-based best round, the monitor loss after every round that was fitted, and its trees."""

    best_iteration: int
    losses: list[float]
    rounds_fitted: int
    spark: SparkSession = field(repr=False)
    inputs: list[str] = field(repr=False)
    trees: list[tuple[Tree, float]] = field(repr=False)
    borders: list[np.ndarray] = field(repr=False)

    @cached_property
    def model(self) -> PipelineModel:
        """The fitted pipeline, made when it is first asked for: its nodes are many calls to the JVM."""
        assembler = VectorAssembler(inputCols=self.inputs, outputCol="features")
        return PipelineModel([assembler, assembled(self.spark, self.trees, self.borders)])

@dataclass
class Fit:
    """One of several fits on a table: its rows, and its monitor rows if it has any.

    With ``refit`` the model comes from both, in as many rounds as the monitor rows found best.
    """

    rows: Column
    stop: Column | None = None
    refit: bool = False

@dataclass
class Tree:
    """Nodes by number; a node without an input is a leaf, its right child follows the left one."""

    feature: list[int] = field(default_factory=lambda: [-1])
    border: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    stats: list[tuple[float, float, float]] = field(default_factory=lambda: [(0.0, 0.0, 0.0)])  # rows, sum, squares
    depth: int = 0

    def split(self, node: int, feature: int, border: int, gain: float, low, high) -> list[int]:
        self.feature[node], self.border[node], self.gain[node] = feature, border, gain
        self.left[node] = len(self.feature)
        for stats in (low, high):
            self.feature.append(-1)
            self.border.append(0)
            self.left.append(0)
            self.gain.append(0.0)
            self.stats.append(stats)
        return [self.left[node], self.left[node] + 1]

    def add_squares(self, squares: Sequence[float]) -> None:
        """Squares of the leaves; those above hold what is below them."""
        below = list(map(float, squares))
        for node in reversed(range(len(self.feature))):
            if self.feature[node] >= 0:
                below[node] = below[self.left[node]] + below[self.left[node] + 1]
        self.stats = [(n, s, q) for (n, s, _), q in zip(self.stats, below)]

@dataclass
class _Growth:
    """A model while it grows."""

    number: int
    rows: int  # bits of the rows it learns from
    stop: int = 0  # bit of its monitor rows
    leader: _Growth | None = None  # whose best round ends this one
    start: float = 0.0
    borders: list[np.ndarray] = field(default_factory=list)
    places: list[np.ndarray] = field(default_factory=list)  # of the borders among those of all models
    trees: list[tuple[Tree, float]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    best: int = 0

    @property
    def rounds(self) -> int:
        return len(self.trees) - 1

    @property
    def size(self) -> int:
        return max(map(len, self.borders)) + 1

    def goes_on(self, limit: int, patience: int | None) -> bool:
        if self.leader is not None:
            return bool(self.leader.losses) and self.rounds <= self.leader.best
        ended = self.losses and patience is not None and self.rounds - 1 - self.best >= patience
        return self.rounds < limit and not ended

    def flat(self, tree: Tree) -> tuple[list[int], list[int], list[int]]:
        """A tree over the bins of the table."""
        border = [int(self.places[j][b]) if j >= 0 else 0 for j, b in zip(tree.feature, tree.border)]
        return list(tree.feature), border, list(tree.left)

def _paths(tree: Tree, wanted: Sequence[int]) -> list[int]:
    """The wanted nodes and those above them; a node comes before its children."""
    above = {}
    for node, left in enumerate(tree.left):
        if tree.feature[node] >= 0:
            above[left] = above[left + 1] = node
    path = set()
    for node in wanted:
        while node is not None and node not in path:
            path.add(node)
            node = above.get(node)
    return sorted(path)

def _spread(bins: np.ndarray, tree, path: Sequence[int], at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The rows of each node that ends a path, of the rows ``at``; ``bins`` has a line per input."""
    feature, border, left = tree
    known, here = set(path), {0: at}
    for node in path:
        rows = here.pop(node)
        if feature[node] < 0:
            yield node, rows
            continue
        below = bins[feature[node]][rows] <= border[node]
        if left[node] in known:
            here[left[node]] = rows[below]
        if left[node] + 1 in known:
            here[left[node] + 1] = rows[~below]

def _drawn(first: int, count: int, seed: int, share: float) -> np.ndarray:
    """The rows of a round: the same ones at every level and in every run of a task."""
    if share >= 1.0:
        return np.ones(count, dtype=bool)
    with np.errstate(over="ignore"):
        z = np.arange(first, first + count).astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return (z >> np.uint64(11)).astype(float) * 2.0**-53 < share

def _binary(cells: Sequence[np.ndarray]) -> pa.Array:
    return pa.array([c.tobytes() for c in cells], pa.binary())

def _totals(lines: pa.Table) -> dict[int, np.ndarray]:
    """The sum of every chunk's lines, added task by task so that it is alike in every run."""
    chunks, tasks = (lines.column(c).to_numpy() for c in ("chunk", "task"))
    cells, found = lines.column("cells").combine_chunks(), {}
    for i in np.lexsort((tasks, chunks)):
        own = np.frombuffer(cells[int(i)].as_buffer(), "<f8")
        found[int(chunks[i])] = found[int(chunks[i])] + own if chunks[i] in found else own
    return found

TASK_SUMS = "chunk int, task int, cells binary"

def _lines(cells: Sequence[np.ndarray]) -> pa.RecordBatch:
    """A task's part of every chunk."""
    task = [TaskContext.get().partitionId()] * len(cells)
    columns = [pa.array(range(len(cells)), pa.int32()), pa.array(task, pa.int32()), _binary(cells)]
    return pa.RecordBatch.from_arrays(columns, names=["chunk", "task", "cells"])

def _merged(scanned: DataFrame, size: int) -> dict[int, np.ndarray]:
    """Every chunk's sum over the tasks.

    ``size`` bytes come from all tasks. Up to ``DRIVER_BYTES`` are added up by the driver,
    more by a shuffle, after which one line per chunk comes back.
    """

    def merge(lines: pa.Table) -> pa.Table:
        found = _totals(lines)
        return pa.table({"chunk": pa.array(found, pa.int32()), "task": pa.array([0] * len(found), pa.int32()), "cells": _binary(list(found.values()))})

    if size > DRIVER_BYTES:
        scanned = scanned.groupBy("chunk").applyInArrow(merge, TASK_SUMS)
    return _totals(scanned.toArrow())

def _borders(values: np.ndarray, limit: int) -> np.ndarray:
    """Up to ``limit - 1`` borders between different values, each with a like share of the rows."""
    seen, counts = np.unique(values, return_counts=True)
    if len(seen) > limit:
        wanted = len(values) * np.arange(1, limit) / limit
        at = np.unique(np.minimum(np.searchsorted(np.cumsum(counts), wanted), len(seen) - 2))
    else:
        at = np.arange(len(seen) - 1)
    middles = np.unique(seen[at] / 2 + seen[at + 1] / 2)
    return middles[~np.isnan(middles)]

class _Rows:
    """Binned rows of some models, with what each model so far leaves of their labels."""

    def __init__(self, rows: DataFrame, inputs: Sequence[str], label: str, models: list[_Growth]):
        self.spark, self.width, self.models = rows.sparkSession, len(inputs), models
        self.base, self.path, self.rounds = None, None, 0
        # a border of one model is one of the table, so its bins are runs of the table's
        every = [np.unique(np.concatenate([m.borders[j] for m in models])) for j in range(self.width)]
        for m in models:
            m.places = [np.searchsorted(all_, own) for all_, own in zip(every, m.borders)]
        self.size = max(map(len, every)) + 1
        self.kind = kind = "u1" if self.size <= 256 else "<u2"
        bits = max(m.rows | m.stop for m in models).bit_length()
        self.marks = marks = "u1" if bits <= 8 else "<u2" if bits <= 16 else "<u4"
        width, starts = self.width, [m.start for m in models]
        step = max(BLOCK_BYTES // max(width * np.dtype(kind).itemsize, 1), 1024)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = [batch.column(j) for j in range(width + 1)]
                values = [c.to_numpy(zero_copy_only=False) for c in columns]
                if any(c.null_count for c in columns) or any(np.isnan(v).any() for v in values):
                    raise ValueError("an input or the label of a row is null or not a number")
                bins = np.empty((width, len(batch)), dtype=kind)
                for j, border in enumerate(every):
                    bins[j] = np.searchsorted(border, values[j], side="left")
                fits = batch.column(width + 1).to_numpy().astype(marks)
                gaps = np.array([values[width] - start for start in starts])
                lows = range(0, len(batch), step)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(width + 2).take(pa.array(lows, pa.int64())),
                        *[_binary([t[..., low : low + step] for low in lows]) for t in (bins, fits, gaps)],
                    ],
                    names=["first", "bins", "fits", "gaps"],
                )

        plain = [F.col(c).cast("double").alias(f"_x{j}") for j, c in enumerate([*inputs, label])]
        # rows of a partition are numbered on end, so the first one's number tells those of a line
        key = F.monotonically_increasing_id().alias("key")
        self._write(rows.select(*plain, F.col(MARK).alias("fits"), key).mapInArrow(cut, TABLE))

    def _write(self, table: DataFrame) -> None:
        path, old = new_table_path(self.spark, "residuals"), self.path
        table.write.parquet(path)
        self._keep(self.spark.read.schema(table.schema).parquet(path))
        self.path = path
        if old:
            drop_table(self.spark, old)

    def _keep(self, table: DataFrame) -> None:
        if self.base is not None:
            self.base.unpersist()
        self.base = table.persist(StorageLevel.MEMORY_AND_DISK)
        self.tasks = table.rdd.getNumPartitions()

    def _reader(self):
        """What tasks need to read a batch: per line the first row's key, bins by input, marks, and residuals by model."""
        width, kind, marks, count = self.width, self.kind, self.marks, len(self.models)

        def read(batch: pa.RecordBatch):
            for i in range(len(batch)):
                cells = [batch.column(j)[i].as_buffer() for j in (1, 2, 3)]
                fits = np.frombuffer(cells[1], marks)
                bins = np.frombuffer(cells[0], kind).reshape(width, len(fits))
                yield batch.column(0)[i].as_py(), bins, fits, np.frombuffer(cells[2], "<f8").reshape(count, len(fits))

        return read

    def sums(self, turns: list[tuple[_Growth, Tree, list[int], int]], share: float) -> list[np.ndarray]:
        """Per model: rows and residuals per node, input and bin; one scan for all of them."""
        read, width, size = self._reader(), self.width, self.size
        parts, first = [], 0
        for m, tree, nodes, seed in turns:
            # where the model's bins begin among those of the table
            begins = [np.concatenate([[0], places + 1]) for places in m.places]
            known = (m.number, m.rows, m.flat(tree), _paths(tree, nodes), list(nodes))
            parts.append((*known, seed, begins, m.size, first))
            first += len(nodes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = [np.zeros((2, width, len(part[4]) * size)) for part in parts]
            for batch in batches:
                for begin, bins, fits, gaps in read(batch):
                    drawn = {seed: _drawn(begin, len(fits), seed, share) for seed in {part[5] for part in parts}}
                    for total, (number, rows, tree, path, nodes, seed, *_) in zip(found, parts):
                        at = np.flatnonzero(((fits & rows) != 0) & drawn[seed])
                        ends = dict(_spread(bins, tree, path, at))
                        at = np.concatenate([ends[node] for node in nodes])
                        start = np.repeat(np.arange(len(nodes)) * size, [len(ends[node]) for node in nodes])
                        left, cells = gaps[number][at], len(nodes) * size
                        for j in range(width):
                            cell = start + bins[j][at]
                            total[0, j] += np.bincount(cell, minlength=cells)
                            total[1, j] += np.bincount(cell, left, cells)
            lines = []
            for total, (*_, nodes, _, begins, most, _) in zip(found, parts):
                own = np.zeros((len(nodes), width, 2, most))
                for j, begin in enumerate(begins):
                    runs = np.add.reduceat(total[:, j].reshape(2, len(nodes), size), begin, axis=2)
                    own[:, j, :, : len(begin)] = runs.transpose(1, 0, 2)
                lines += list(own)
            yield _lines(lines)

        held = sum(len(part[4]) * part[-2] for part in parts) * width * 16
        merged = _merged(self.base.mapInArrow(run, TASK_SUMS), held * self.tasks)
        return [
            np.array([merged[part[-1] + i].reshape(width, 2, part[-2]) for i in range(len(part[4]))]) for part in parts
        ]

    def add(self, turns: list[tuple[_Growth, Tree, float, int]], share: float) -> list[float | None]:
        """Take new trees off the residuals; mean squared residual of each model's monitor rows, if it has any.

        One scan for all of them. It also adds up the squares that the nodes of the trees leave.
        """
        read, parts, lows = self._reader(), [], [0]
        for m, tree, weight, seed in turns:
            m.trees.append((tree, weight))
            values = [weight * s / n if n else 0.0 for n, s, _ in tree.stats]
            parts.append((m.number, m.rows, m.stop, m.flat(tree), values, seed))
            lows.append(lows[-1] + 2 + len(values))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for begin, bins, fits, gaps in read(batch):
                    gaps, facts = gaps.copy(), np.zeros(lows[-1])
                    drawn = {seed: _drawn(begin, len(fits), seed, share) for seed in {part[-1] for part in parts}}
                    for low, (number, rows, stop, tree, values, seed) in zip(lows, parts):
                        left = gaps[number]
                        learned = ((fits & rows) != 0) & drawn[seed]
                        for node, at in _spread(bins, tree, range(len(values)), np.flatnonzero(fits & (rows | stop))):
                            own = left[at]
                            squares = own[learned[at]]
                            facts[low + 2 + node] = squares @ squares
                            left[at] = own - values[node]
                        watched = left[(fits & stop) != 0]
                        facts[low : low + 2] = len(watched), watched @ watched
                    cells = [pa.array([begin], pa.int64()), *[_binary([t]) for t in (bins, fits, gaps, facts)]]
                    yield pa.RecordBatch.from_arrays(cells, names=["first", "bins", "fits", "gaps", "facts"])

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(lows[-1])
            for batch in batches:
                for cell in batch.column(0):
                    total += np.frombuffer(cell.as_buffer(), "<f8")
            yield _lines([total])

        table = self.base.select("first", "bins", "fits", "gaps").mapInArrow(run, TABLE + ", facts binary")
        self.rounds += 1
        if self.rounds % RENEW:
            old, self.base = self.base, table.persist(StorageLevel.MEMORY_AND_DISK)
        else:
            old = None
            self._write(table)
        facts = _merged(self.base.select("facts").mapInArrow(added, TASK_SUMS), lows[-1] * 8 * self.tasks)[0]
        if old is not None:
            old.unpersist()
        out = []
        for low, (m, tree, *_) in zip(lows, turns):
            tree.add_squares(facts[low + 2 : low + 2 + len(tree.feature)])
            rows, squares = facts[low : low + 2]
            if m.stop and not rows:
                raise ValueError("no monitor rows")
            out.append(float(squares / rows) if m.stop else None)
        return out

    def close(self) -> None:
        self.base.unpersist()
        drop_table(self.spark, self.path)

def _subset_size(strategy: str, width: int) -> int:
    """Inputs that a node may use, by the names Spark ML gives to the shares."""
    named = {"auto": width, "all": width, "sqrt": math.ceil(math.sqrt(width)), "onethird": math.ceil(width / 3)}
    named["log2"] = max(1, math.ceil(math.log2(width)))
    if strategy in named:
        return named[strategy]
    whole = strategy.isdigit()
    return min(int(strategy), width) if whole else math.ceil(float(strategy) * width)

def _best(sums: np.ndarray, allowed: np.ndarray, least_rows: float, least_gain: float, blur: float = 0.0):
    """The split of a node that takes most variance away: input, border, gain; None if none does.

    ``blur`` is how far a sum of residuals may be off by rounding.
    """
    n, s = sums[:, 0], sums[:, 1]
    if n.shape[1] < 2:
        return None  # no input varies
    total, whole = n[0].sum(), s[0].sum()
    nl, sl = n.cumsum(axis=1)[:, :-1], s.cumsum(axis=1)[:, :-1]
    nr, sr = total - nl, whole - sl
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (sl * sl / nl + sr * sr / nr - whole * whole / total) / total
    fit = (nl >= least_rows) & (nr >= least_rows) & (gain >= least_gain) & allowed[:, None]
    noise = 1e-14 * (whole / total) ** 2 + blur * (blur + 2 * abs(whole) / total) / total
    gain = np.where(fit & (gain > noise), gain, -1.0)
    j, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return (int(j), int(b), float(gain[j, b])) if gain[j, b] > 0 else None

@dataclass
class _Open:
    """A node that may be split, and where its sums come from."""

    node: int
    sums: np.ndarray | None = None
    blur: float = 0.0
    parent: _Open | None = None
    sibling: _Open | None = None  # the scanned one, where this one is what it leaves of the parent

    def settle(self) -> None:
        if self.sibling is None:
            return
        above = self.parent.sums
        self.sums = above - self.sibling.sums
        self.sums[:, 1][self.sums[:, 0] == 0] = 0.0
        self.blur = self.parent.blur + 1e-15 * float(np.abs(above[:, 1]).sum(axis=1).max())

def _grown(rows: _Rows, models: list[_Growth], p: dict) -> list[Tree]:
    """A regression tree on the residuals of each model, one scan a level."""
    seeds = [p["seed"] + m.rounds for m in models]
    rngs = [np.random.default_rng(seed) for seed in seeds]
    trees, nodes = [Tree() for _ in models], [[_Open(0)] for _ in models]
    least_rows, least_gain = max(p.get("minInstancesPerNode", 1), 1), p.get("minInfoGain", 0.0)
    wanted = _subset_size(str(p["featureSubsetStrategy"]), rows.width)
    for level in range(max(p["maxDepth"], 1)):
        turn = [i for i, open_ in enumerate(nodes) if open_]
        if not turn:
            break
        scanned = [[open_ for open_ in nodes[i] if open_.sibling is None] for i in turn]
        asked = [(models[i], trees[i], [o.node for o in these], seeds[i]) for i, these in zip(turn, scanned)]
        for these, found in zip(scanned, rows.sums(asked, p["subsamplingRate"])):
            for open_, sums in zip(these, found):
                open_.sums = sums
        for i in turn:
            tree, below = trees[i], []
            for open_ in nodes[i]:
                open_.settle()
                node, here = open_.node, open_.sums
                if level == 0:
                    tree.stats[0] = (*here[0].sum(axis=1), 0.0)
                if not p["maxDepth"] or not tree.stats[node][0]:
                    continue
                allowed = np.zeros(rows.width, dtype=bool)
                allowed[rngs[i].choice(rows.width, wanted, replace=False)] = True
                best = _best(here, allowed, least_rows, least_gain, open_.blur)
                if best:
                    j, b, gain = best
                    low, high = ((*part.sum(axis=1), 0.0) for part in (here[j][:, : b + 1], here[j][:, b + 1 :]))
                    pair = [_Open(child, parent=open_) for child in tree.split(node, j, b, gain, low, high)]
                    small = pair[0] if low[0] <= high[0] else pair[1]
                    for open_child in pair:
                        open_child.sibling = None if open_child is small else small
                    below += pair
            for open_ in nodes[i]:
                open_.parent = None  # its sums are not needed again
            nodes[i] = below
            if below:
                tree.depth = level + 1
    return trees

def spark_tree(spark, tree: Tree, borders: Sequence[np.ndarray]):
    """The tree as a Spark ML model."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    kinds = jvm.org.apache.spark.ml.tree

    def made(node: int):
        n, s, q = (float(v) for v in tree.stats[node])
        stats = gateway.new_array(gateway.jvm.double, 3)
        stats[0], stats[1], stats[2] = n, s, q
        value = s / n if n else 0.0
        spread = max(q / n - value * value, 0.0) if n else 0.0
        known = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator(stats, int(n))
        j = tree.feature[node]
        if j < 0:
            return kinds.LeafNode(value, spread, known)
        split = kinds.ContinuousSplit(j, float(borders[j][tree.border[node]]))
        left = tree.left[node]
        return kinds.InternalNode(value, spread, tree.gain[node], made(left), made(left + 1), split, known)

    uid = jvm.org.apache.spark.ml.util.Identifiable.randomUID("dtr")
    return jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel(uid, made(0), len(borders))

def assembled(spark, trees: Sequence[tuple], borders: Sequence[np.ndarray]) -> GBTRegressionModel:
    """A Spark ML model of weighted regression trees."""
    gateway = spark.sparkContext._gateway
    ml = spark.sparkContext._jvm.org.apache.spark.ml.regression
    kinds = gateway.new_array(ml.DecisionTreeRegressionModel, len(trees))
    weights = gateway.new_array(gateway.jvm.double, len(trees))
    for i, (tree, weight) in enumerate(trees):
        kinds[i], weights[i] = spark_tree(spark, tree, borders), float(weight)
    uid = spark.sparkContext._jvm.org.apache.spark.ml.util.Identifiable.randomUID("boosted")
    return GBTRegressionModel(ml.GBTRegressionModel(uid, kinds, weights))

MARK = "_fits"

def _marked(rows: DataFrame, fits: Sequence[Fit]) -> DataFrame:
    """Rows of any fit with their mark: two bits a fit, for its rows and its monitor rows."""
    mark = F.lit(0).cast("long")
    for i, fit in enumerate(fits):
        for bit, chosen in ((1, fit.rows), (2, fit.stop)):
            if chosen is not None:
                mark = mark + F.when(chosen, F.lit(bit << 2 * i).cast("long")).otherwise(F.lit(0).cast("long"))
    return rows.withColumn(MARK, mark).filter(F.col(MARK) != 0)

def _planned(rows: DataFrame, inputs: Sequence[str], label: str, fits: Sequence[Fit], p: dict) -> list[_Growth]:
    """The models that fits need, with their mean labels and borders."""
    models, leaders = [], []
    for i, fit in enumerate(fits):
        leaders.append(_Growth(len(models), 1 << 2 * i, (2 << 2 * i) if fit.stop is not None else 0))
        models.append(leaders[-1])
    for i, (fit, leader) in enumerate(zip(fits, leaders)):
        if fit.refit:
            models.append(_Growth(len(models), 3 << 2 * i, leader=leader))

    y = F.col(label).cast("double")
    facts = []
    for m in models:
        mine = F.col(MARK).bitwiseAND(F.lit(m.rows).cast("long")) != 0
        facts += [F.count(F.when(mine, 1)), F.sum(F.when(mine, y)), F.sum(F.when(mine, y * y))]
    totals = np.array(rows.agg(*facts).first(), dtype=object).reshape(len(models), 3)
    if not all(totals[:, 0]):
        raise ValueError("no rows to fit")
    if any(total is None for total in totals[:, 1]):
        raise ValueError("every label is null")
    limit = p.get("maxBins", 32)
    shares = [min(1.0, 1.2 * max(limit * limit, SPLIT_ROWS) / n) for n in totals[:, 0]]
    names = [f"_x{j}" for j in range(len(inputs))]
    some = rows.select(*[F.col(c).cast("double").alias(n) for n, c in zip(names, inputs)], MARK, F.rand(p["seed"]).alias("_draw"))
    # a bounded number of rows comes back
    drawn = some.filter(F.col("_draw") < max(shares)).dropna(subset=names).toArrow()
    mark, draw = drawn.column(MARK).to_numpy(), drawn.column("_draw").to_numpy()
    for m, (n, total, squares), share in zip(models, totals, shares):
        mine = ((mark & m.rows) != 0) & (draw < share)
        m.borders = [_borders(drawn.column(name).to_numpy()[mine], limit) for name in names]
        m.start = total / n
        m.trees = [(Tree(stats=[(float(n), total, squares)]), 1.0)]
    return models

def boost_many(
    rows: DataFrame,
    inputs: Sequence[str],
    fits: Sequence[Fit],
    params: dict | None = None,
    label: str = "rul",
    patience: int | None = PATIENCE,
) -> list[Boosted]:
    """``boost`` for several fits on one table, from the same scans (``FITS`` of them at a time).

    A refit grows along: it takes a round as soon as the monitor rows have found
    that round worth while, so it never waits for the end and fits none in vain.
    """
    fits, inputs, p = list(fits), list(inputs), {**BOOSTED, **(params or {})}
    if any(fit.refit and fit.stop is None for fit in fits):
        raise ValueError("a refit needs monitor rows")
    if len(fits) > FITS:
        first = boost_many(rows, inputs, fits[:FITS], params, label, patience)
        return first + boost_many(rows, inputs, fits[FITS:], params, label, patience)
    marked = _marked(rows, fits)
    models = _planned(marked, inputs, label, fits, p)
    table = _Rows(marked, inputs, label, models)
    try:
        while turn := [m for m in models if m.goes_on(p["maxIter"], patience)]:
            grown = [(m, tree, p["stepSize"], p["seed"] + m.rounds) for m, tree in zip(turn, _grown(table, turn, p))]
            for m, loss in zip(turn, table.add(grown, p["subsamplingRate"])):
                if loss is None:
                    continue
                m.losses.append(loss)
                if loss < m.losses[m.best]:
                    m.best = m.rounds - 1
    finally:
        table.close()
    refits = {m.leader.number: m for m in models if m.leader is not None}
    out = []
    for leader in models[: len(fits)]:
        best = leader.best if leader.stop else leader.rounds - 1
        m = refits.get(leader.number, leader)
        out.append(Boosted(best, leader.losses, leader.rounds, rows.sparkSession, inputs, m.trees[: best + 2], m.borders))
    return out

def boost(
    rows: DataFrame,
    inputs: Sequence[str],
    params: dict | None = None,
    label: str = "rul",
    stop: DataFrame | Column | None = None,
    patience: int | None = PATIENCE,
) -> Boosted:
    """Fit up to ``maxIter`` rounds on ``rows``.

    The model starts from the mean label. With monitor rows ``stop`` the model
    ends at its best round, and fitting ends ``patience`` rounds after it;
    without, all rounds are fitted and kept. ``stop`` may also tell which of the
    ``rows`` they are, so that both come from the same scans. ``params`` are those of the boosted
    learner; its row and column shares hold per round and per node. The rows are
    read three times before the rounds, so callers write them first.
    """
    names = [*inputs, label]
    kept = rows.select(*names, (stop if isinstance(stop, Column) else F.lit(False)).alias("_stop"))
    if isinstance(stop, DataFrame):
        kept = kept.unionByName(stop.select(*names, F.lit(True).alias("_stop")))
    fit = Fit(~F.col("_stop"), F.col("_stop") if stop is not None else None)
    return boost_many(kept, inputs, [fit], params, label, patience)[0]
