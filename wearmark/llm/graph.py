"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import delete_written, written

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges(u, v)``; the label is the smallest node of the component.

    Minima are pre-aggregated and joined back with skew splitting, so a node may
    have any number of neighbours. Every round is written to the shared folder.
    Loops and repeated edges are allowed; no edges give an empty table.
    """
    pair = [F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")]
    current = written(edges.filter("u != v").select(*pair).distinct(), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        facts = current.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"))
        now = tuple(facts.first())
        if now == before or not now[0]:
            break
        before = now
        after = written(_small_star(_large_star(current)), "edges")
        delete_written(current)
        current = after
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("v").alias("node")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        roots.select("node", F.col("node").alias("label"))
    )
