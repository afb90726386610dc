"""Sharding by vector bin packing: bytes, tokens and rows are balanced together.

Groups of equal texts stay together unless they fill a shard by themselves.
What is placed one by one on the driver has a fixed bound: groups that hold at
least a ``1 / (shards * FINE)`` part of some measure, those over ``WHOLE`` of a
shard's capacity cut into pieces of that part, and bundles of all smaller
groups by a hash of their text. Each goes to
the shard where the dot product of its vector with the residual capacity is
highest among those with room.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import n_words, ranked, small_side, written

SHARDS = 24
FINE = 64  # pieces of a shard's capacity: a piece is small against a shard
WHOLE = 0.9  # part of a shard's capacity up to which a group is placed as one unit
BUNDLES = 128  # bundles of small groups per shard
MEASURES = ("size", "tokens", "rows")


def facts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, tokens, group``; a null text has 8 bytes, no tokens and the crc of nothing."""
    c = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(c) + 8).cast("long").alias("size"),
        F.crc32(c).alias("text_crc32"),
        n_words(c).alias("tokens"),
        F.unhex(F.md5(c)).alias("group"),
    )


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every vector, largest first, by the highest dot product with the residual capacity.

    A shard has room when no residual goes below zero; if none has, all take
    part. Ties go to the smaller shard.
    """
    totals = np.maximum(vectors.sum(axis=0), 1e-12)
    shares = vectors / totals * shards  # a shard's capacity is 1 in every measure
    residual = np.ones((shards, vectors.shape[1]))
    out = np.empty(len(vectors), np.int64)
    for i in np.argsort(-shares.max(axis=1), kind="stable"):
        score = residual @ shares[i]
        room = (residual >= shares[i]).all(axis=1)
        best = int(np.argmax(np.where(room, score, -np.inf))) if room.any() else int(np.argmax(score))
        out[i] = best
        residual[best] -= shares[i]
    return out


def sharded(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, tokens, shard, slot`` of every row; slots are gapless from 0 per shard.

    Repeated rows are placed each. An empty table gives an empty one.
    """
    table = written(facts(docs, key, text), "facts")
    groups = written(
        table.groupBy("group").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")),
        "groups",
    )
    totals = groups.agg(*[F.sum(m).alias(m) for m in MEASURES]).first()
    part = F.greatest(*[F.col(m) * F.lit(shards * FINE / max(float(totals[m] or 0), 1.0)) for m in MEASURES])
    # at most len(MEASURES) * shards * FINE groups can hold such a part
    cuts = F.when(part > WHOLE * FINE, F.ceil(part)).otherwise(1).cast("int")
    large = written(groups.withColumn("cuts", cuts).filter(part >= 1), "large")
    large_side = small_side(large.select("group", "cuts"))
    bundle = F.pmod(F.xxhash64("group"), F.lit(shards * BUNDLES)).cast("int")
    salt = F.pmod(F.xxhash64("doc_id", "size"), F.col("cuts")).cast("int")
    units = table.join(large_side, "group", "left").withColumn(
        "unit",
        F.when(F.col("cuts").isNull(), F.concat(F.lit("b"), bundle)).otherwise(
            F.concat(F.lit("g"), F.hex("group"), F.lit("."), salt)
        ),
    )
    sums = (
        units.groupBy("unit")
        .agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
        .orderBy("unit")
        .collect()
    )
    spark = docs.sparkSession
    placed = place(np.array([[float(r[m]) for m in MEASURES] for r in sums]).reshape(-1, len(MEASURES)), shards)
    where = spark.createDataFrame([(r["unit"], int(s)) for r, s in zip(sums, placed)], "unit string, shard int")
    found = written(units.join(F.broadcast(where), "unit").drop("unit", "cuts"), "placed")
    return ranked(found, ["shard"], ["doc_id", "size", "text_crc32"], ["doc_id", "size"], "slot").drop("group")
