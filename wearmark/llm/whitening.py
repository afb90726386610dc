"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its factor.

Components are read as ``x = floor(256 * c)``, whole numbers, so sums and
deviations are exact. The fit list is every distinct ``x`` once.

1. One pass over the fit list adds up exact sums per dimension.
2. A second pass centres every vector before multiplying and adds up the
   scatter; matrices of tasks are added in two levels, so only one matrix, of
   dimensions squared, reaches the driver.
3. There pivoted Cholesky factors it as ``L L'`` and rotations from the right
   make the columns of ``L`` orthogonal: their squared norms are the eigenvalues
   and the normalised columns the components.
4. A third pass measures the covariance of the whitened fit list, and the rows
   themselves are projected where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from .common import written

COMPONENTS = 4
FOUND = (
    "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
)
SCALE = 256
BLOCK_BYTES = 8 << 20  # of 64-bit numbers that are multiplied at a time
PARTS = 64  # matrices added in one piece
SWEEPS = 60
# Whole numbers beyond this are no longer told apart by doubles.
LARGEST = 1 << 53


@dataclass
class Whitener:
    """What a fit found: counts, exact sums, components by falling eigenvalue, and how good they are."""

    n: int
    sums: list[int]
    largest: int
    eigenvalues: np.ndarray
    components: np.ndarray  # one column each
    trace: float
    identity_error: float = 0.0


def usable(vector: str | Column) -> Column:
    """A vector with components, none of them null or non-finite."""
    c = F.col(vector) if isinstance(vector, str) else vector
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.coalesce((F.size(c) > 0) & ~F.exists(c, bad), F.lit(False))


def scaled(vector: str | Column) -> Column:
    c = F.col(vector) if isinstance(vector, str) else vector
    return F.transform(c, lambda v: F.floor(v.cast("double") * SCALE))


def _blocks(lists: pa.Array) -> Iterator[np.ndarray]:
    """Rows of an array of equally long lists as matrices of bounded size."""
    if not len(lists):
        return
    table = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
    step = max(1, BLOCK_BYTES // (8 * table.shape[1]))
    for low in range(0, len(table), step):
        yield table[low : low + step]


def exact_sums(fit: DataFrame) -> tuple[int, list[int], int]:
    """Rows, exact sum per dimension and largest absolute value of ``x``; one line per dimension and task is shuffled."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, largest = 0, None, None
        for batch in batches:
            for block in _blocks(batch.column("x")):
                peak = np.maximum(block.max(axis=0), -block.min(axis=0))
                if peak.max() >= LARGEST:
                    raise ValueError("vector components are too large to be whitened exactly")
                # whole numbers under 2**53 in two halves, so no sum of a block overflows
                part = (block >> 20).sum(axis=0).astype(object) * (1 << 20) + (block & 0xFFFFF).sum(axis=0)
                sums = part if sums is None else sums + part
                largest = peak if largest is None else np.maximum(largest, peak)
                n += len(block)
        if n:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(len(sums)), pa.int32()),
                    pa.array([n] * len(sums), pa.int64()),
                    pa.array([Decimal(int(s)) for s in sums], pa.decimal128(38, 0)),
                    pa.array(largest, pa.int64()),
                ],
                names=["i", "n", "s", "m"],
            )

    found = fit.select("x").mapInArrow(add, "i int, n long, s decimal(38,0), m long")
    lines = found.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("m").alias("m")).collect()
    lines.sort(key=lambda r: r["i"])
    return (lines[0]["n"], [int(r["s"]) for r in lines], max(r["m"] for r in lines)) if lines else (0, [], 0)


def scatter(fit: DataFrame, centre: np.ndarray) -> np.ndarray:
    """Sum over the fit list of the outer products of ``x - centre``."""
    d = len(centre)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((d, d)), 0
        for batch in batches:
            for block in _blocks(batch.column("x")):
                apart = block - centre
                total += apart.T @ apart
                rows += len(block)
        if rows:
            part = TaskContext.get().partitionId()
            for low in range(0, d, max(1, BLOCK_BYTES // (8 * d))):
                some = total[low : low + max(1, BLOCK_BYTES // (8 * d))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(low, low + len(some)), pa.int32()),
                        pa.array([part] * len(some), pa.int32()),
                        pa.array([line.tobytes() for line in some], pa.binary()),
                    ],
                    names=["i", "part", "line"],
                )

    def add(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")  # one order of adding, so reruns agree
        total = np.sum([np.frombuffer(c) for c in group["line"]], axis=0)
        return pd.DataFrame({"i": [group["i"].iloc[0]], "part": [group["part"].iloc[0]], "line": [total.tobytes()]})

    kind = "i int, part int, line binary"
    parts = fit.select("x").mapInArrow(multiply, kind)
    some = parts.groupBy("i", F.floor(F.col("part") / PARTS).alias("_p")).applyInPandas(add, kind)
    out = np.zeros((d, d))
    for r in some.groupBy("i").applyInPandas(add, kind).collect():
        out[r["i"]] = np.frombuffer(r["line"])
    return (out + out.T) / 2


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """``L`` with ``L L' = a`` for a positive semi-definite ``a``, its rows in the order of ``a``.

    Each step takes the largest remaining diagonal entry; columns end where all
    that is left is rounding, so ``L`` has as many columns as ``a`` has rank.
    """
    left = np.diag(a).astype(float).copy()
    floor = np.finfo(float).eps * len(left) * max(left.max(initial=0.0), 0.0)
    columns: list[np.ndarray] = []
    for _ in range(len(left)):
        pivot = int(left.argmax())
        if not left[pivot] > floor:
            break
        column = a[:, pivot].astype(float)
        for earlier in columns:
            column -= earlier * earlier[pivot]
        column /= np.sqrt(left[pivot])
        left -= column * column
        left[pivot] = 0.0
        columns.append(column)
    return np.stack(columns, axis=1) if columns else np.empty((len(left), 0))


def jacobi(factor: np.ndarray) -> np.ndarray:
    """The columns of ``factor`` rotated among each other until all are orthogonal.

    Disjoint pairs are rotated together, in the rounds of a tournament; a sweep
    lets every two columns meet once.
    """
    u = np.array(factor, float, order="F")
    m = u.shape[1]
    if m < 2:
        return u
    players = list(range(m + m % 2))  # the last one sits out when m is odd
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(len(players) - 1):
            half = len(players) // 2
            pairs = [(min(p), max(p)) for p in zip(players[:half], players[:half - 1 : -1]) if max(p) < m]
            i, j = np.array(pairs).T
            left, right = u[:, i], u[:, j]
            alpha, beta = (left * left).sum(axis=0), (right * right).sum(axis=0)
            gamma = (left * right).sum(axis=0)
            size = np.sqrt(alpha * beta)
            relative = np.where(size > 0, np.abs(gamma) / np.where(size > 0, size, 1.0), 0.0)
            worst = max(worst, float(relative.max()))
            turn = relative > 1e-16
            zeta = (beta - alpha) / np.where(turn, 2 * gamma, 1.0)
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = np.where(turn, 1 / np.hypot(1.0, t), 1.0)
            s = np.where(turn, t * c, 0.0)
            u[:, i], u[:, j] = c * left - s * right, s * left + c * right
            players = [players[0], players[-1], *players[1:-1]]
        if worst < 1e-14:
            return u
    raise ArithmeticError("the columns did not become orthogonal")


def eigen(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns; largest entry positive) above rounding."""
    turned = jacobi(pivoted_cholesky(covariance))
    norms = np.linalg.norm(turned, axis=0)
    order = np.argsort(-norms, kind="stable")
    turned, norms = turned[:, order], norms[order]
    vectors = turned / norms
    top = np.abs(vectors).argmax(axis=0) if vectors.size else np.empty(0, int)
    signs = np.where(vectors[top, np.arange(len(top))] < 0, -1.0, 1.0)
    return norms**2, vectors * signs


def projected(rows: DataFrame, found: Whitener, keep: list[str], components: int) -> DataFrame:
    """``keep``, exact ``deviation`` and an array ``whitened`` of every row's ``x``."""
    n, sums, centre = found.n, found.sums, np.array([s / found.n for s in found.sums])
    k = min(components, len(found.eigenvalues))
    axes = found.components[:, :k] / np.sqrt(found.eigenvalues[:k])
    # the widest deviation fits 64 bits, or whole numbers of any size are used
    wide = len(sums) * (2 * n * max(found.largest, 1)) ** 2 >= 1 << 63
    kind = object if wide else np.int64
    exact = np.array(sums, dtype=kind)
    added = StructType.fromDDL("deviation decimal(38,0), whitened array<double>")
    schema = StructType([*(rows.schema[c] for c in keep), *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            deviations, whitened = [], []
            for block in _blocks(batch.column("x")):
                apart = block.astype(kind) * n - exact
                deviations += [Decimal(int(v)) for v in (apart * apart).sum(axis=1)]
                whitened += list((block - centre) @ axes)
            held = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays(
                [*held, pa.array(deviations, pa.decimal128(38, 0)), pa.array(whitened, pa.list_(pa.float64()))],
                names=[*keep, "deviation", "whitened"],
            )

    return rows.select(*keep, "x").mapInArrow(run, schema)


def fitted(fit: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """Fit on the distinct vectors of a written table ``x``; None when it is empty."""
    n, sums, largest = exact_sums(fit)
    if not n:
        return None
    covariance = scatter(fit, np.array([s / n for s in sums])) / n
    values, vectors = eigen(covariance)
    found = Whitener(n, sums, largest, values, vectors, float(np.trace(covariance)))
    k = min(components, len(values))
    if k:
        seen = projected(fit, found, [], k).select(*[F.col("whitened")[i].alias(f"w{i}") for i in range(k)])
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        line = seen.agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
        found.identity_error = max(abs(line[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    return found


def whitened(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error`` per usable row and component.

    Vectors that are null, empty, or hold null or non-finite components are
    dropped; so are those of another length than most (ties: the shorter). Rows
    that repeat an id or have none are each returned. Components without
    variance do not exist, so a single distinct vector, or an empty table, gives
    no rows. ``deviation`` is a decimal, exact at any size.
    """
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector")).filter(usable("vector"))
    lengths = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    kind = StructType([StructField(key, rows.schema["key"].dataType), *StructType.fromDDL(FOUND)])
    found = None
    if lengths is not None:
        rows = rows.filter(F.size("vector") == lengths["d"]).select("key", scaled("vector").alias("x"))
        found = fitted(written(rows.select("x").distinct(), "whitening_fit"), components)
    if found is None or not len(found.eigenvalues):
        return vectors.sparkSession.createDataFrame([], kind)
    k = min(components, len(found.eigenvalues))
    shares = F.array(*[F.lit(float(e / found.trace)) for e in found.eigenvalues[:k]])
    return (
        projected(rows, found, ["key"], k)
        .select("key", "deviation", F.posexplode("whitened").alias("_i", "whitened"))
        .select(
            F.col("key").alias(key),
            (F.col("_i") + 1).cast("int").alias("component"),
            F.lit(found.n).cast("long").alias("n"),
            "deviation",
            "whitened",
            F.get(shares, F.col("_i")).alias("explained"),
            F.lit(float(found.identity_error)).alias("identity_error"),
        )
    )
