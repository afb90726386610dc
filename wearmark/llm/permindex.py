"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order in which it sees a fixed number of pivots.
The index keeps, block by block, one inverted file per pivot with the position
that the pivot takes for each vector of the block. A query reads the files of
its pivots in its own order and adds up the differences of positions, which is
Spearman's footrule; the vectors with the smallest footrule are compared with
the query by the exact inner product.

Pivots see angles only, while the inner product also grows with the length of a
vector: what the footrule says about the angle is therefore weighed by the
length before vectors are ranked. For vectors of one length that is the order
of the footrule itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import written

PIVOTS = 128
NEIGHBOURS = 20
RERANK_SHARE = 0.15  # part of a block that is compared exactly
RERANK_LEAST = 600
INDEX_BLOCK = 16_384  # vectors whose inverted files are held at once
QUERY_BLOCK = 2_048


def usable(vector: str = "embedding") -> Column:
    """Not null, not empty, without null or non-finite components and not all zero."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def pivots_of(vectors: DataFrame, n: int = PIVOTS) -> np.ndarray:
    """The ``n`` distinct vectors that come first by a hash: a bounded sample."""
    first = (
        vectors.select("embedding")
        .withColumn("_h", F.xxhash64("embedding", F.lit("pivot")))
        .groupBy("_h")
        .agg(F.min("embedding").alias("embedding"))
        .orderBy("_h")
        .limit(n)
    )
    return np.array([r["embedding"] for r in first.collect()], np.float64)


def positions_of(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """For each vector (a row) the position of every pivot in its order, nearest in angle first; ties by pivot."""
    units = pivots / np.linalg.norm(pivots, axis=1, keepdims=True)
    seen = np.argsort(-(vectors @ units.T), axis=1, kind="stable")
    places = np.empty(seen.shape, np.int16)
    np.put_along_axis(places, seen, np.arange(seen.shape[1], dtype=np.int16)[None, :].repeat(len(seen), 0), axis=1)
    return places


def indexed(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``vec_id, vector, places``: raw 64-bit components and 16-bit pivot positions."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("embedding")
            table = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            places = positions_of(table, pivots)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    pa.array([r.tobytes() for r in table], pa.binary()),
                    pa.array([r.tobytes() for r in places], pa.binary()),
                ],
                names=["vec_id", "vector", "places"],
            )

    return vectors.select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, vector binary, places binary")


def best_of_block(
    queries: tuple[np.ndarray, np.ndarray, np.ndarray], block: tuple[np.ndarray, np.ndarray, np.ndarray], k: int
) -> pd.DataFrame:
    """The ``k`` best rows of a block for every query, by footrule and then exact product.

    ``queries`` and ``block`` are (ids, vectors, places); the block is in order
    of its ids, so ties of footrule and of product go to smaller ids.
    """
    ids, vectors, places = block
    files = np.ascontiguousarray(places.T)  # one inverted file per pivot
    n, pivots = len(ids), places.shape[1]
    random = max((pivots * pivots - 1) / 3, 1.0)  # mean footrule of two random orders
    lengths = np.linalg.norm(vectors, axis=1)
    most = min(n, max(RERANK_LEAST, int(np.ceil(n * RERANK_SHARE))))
    out: list[tuple[np.ndarray, ...]] = []
    for q_id, q_vector, q_places in zip(*queries):
        footrule = np.zeros(n, np.int32)
        for pivot, place in enumerate(q_places):
            footrule += np.abs(files[pivot] - place)
        promise = (1 - footrule / random) * lengths
        least = np.partition(promise, n - most)[n - most]
        near, level = np.flatnonzero(promise > least), np.flatnonzero(promise == least)
        near = np.sort(np.concatenate([near, level[: most - len(near)]]))
        near = near[ids[near] != q_id]
        # row by row, so equal vectors get equal sums
        products = (vectors[near] * q_vector).sum(axis=1)
        best = np.lexsort((ids[near], -products))[:k]
        out.append((np.full(len(best), q_id), ids[near[best]], products[best]))
    columns = [np.concatenate(c) if out else np.empty(0) for c in (list(zip(*out)) or [[], [], []])]
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns)))


def _unpacked(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    frame = frame.sort_values("vec_id", kind="stable")
    ids = frame["vec_id"].to_numpy(np.int64)
    vectors = np.frombuffer(b"".join(frame["vector"]), np.float64).reshape(len(ids), -1)
    places = np.frombuffer(b"".join(frame["places"]), np.int16).reshape(len(ids), -1)
    return ids, vectors, places


def neighbours(
    vectors: DataFrame, is_query: Column, k: int = NEIGHBOURS, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score``: up to ``k`` nearest found for every query row.

    Vectors that are not usable, have no id, or have another length than most
    take no part. A row never finds rows of its own id; rows that repeat an id
    and vector count once. Of equal vectors only the ``k + 1`` smallest ids can
    be among the best, so only those are indexed. No usable vectors give an
    empty table.
    """
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("embedding"), is_query.alias("_q"))
    rows = rows.filter(usable() & F.col("vec_id").isNotNull())
    lengths = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, vec_id long, score double"
    if lengths is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = written(rows.filter(F.size("embedding") == lengths["n"]), "vectors")
    pivots = pivots_of(rows)

    plain = rows.select("vec_id", "embedding").distinct()
    copies = Window.partitionBy("embedding").orderBy("vec_id")
    base = plain.withColumn("_n", F.row_number().over(copies)).filter(F.col("_n") <= k + 1).drop("_n")
    index = written(indexed(base, pivots), "index")
    asked = written(indexed(rows.filter("_q").select("vec_id", "embedding").distinct(), pivots), "queries")
    n_blocks = max(1, -(-index.count() // INDEX_BLOCK))
    n_asked = max(1, -(-asked.count() // QUERY_BLOCK))
    all_blocks = F.sequence(F.lit(0), F.lit(n_blocks - 1))
    all_asked = F.sequence(F.lit(0), F.lit(n_asked - 1))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    left = asked.withColumn("qb", deal(n_asked)).withColumn("cb", F.explode(all_blocks))
    right = index.withColumn("cb", deal(n_blocks)).withColumn("qb", F.explode(all_asked))

    def search(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(block):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return best_of_block(_unpacked(queries), _unpacked(block), k)

    found = left.groupBy("cb", "qb").cogroup(right.groupBy("cb", "qb")).applyInPandas(search, schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranks = once.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranks.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
