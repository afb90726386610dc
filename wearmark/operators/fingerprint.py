"""Order-insensitive table fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import general_format
from .segments import UNIT

MODULUS = 1 << 61
# Rows of a leaf of the hash tree, children of a node (one hex digit), and levels at most.
LEAF_ROWS = 10_000
FANOUT = 16
MAX_DEPTH = 12
# Fixed value: sha256 of nothing.
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def _text(df: DataFrame, name: str, digits: int) -> Column:
    kind = df.schema[name].dataType
    c = F.col(name)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        c = general_format(c, digits)
    elif isinstance(kind, T.BooleanType):
        c = F.when(c, "True").otherwise(F.when(~c, "False"))
    else:
        c = c.cast("string")
    return F.coalesce(c, F.lit(""))


def table_fingerprint(df: DataFrame, digits: int = 6) -> DataFrame:
    """Row count plus xor and sum of row hashes; any size, any row order.

    Floats keep ``digits`` significant digits, so 30.0 and 30 agree; NULL and
    NaN are empty text.
    """
    row = F.concat_ws("\x1f", *[_text(df, c, digits) for c in df.columns])
    hashed = F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("long")
    return df.select(hashed.alias("_h")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.bit_xor("_h"), F.lit(0)).alias("row_xor"),
        F.coalesce(
            F.pmod(F.sum(F.col("_h").cast("decimal(38,0)")), F.lit(MODULUS).cast("decimal(38,0)")).cast("long"),
            F.lit(0),
        ).alias("row_sum"),
    )


def row_hash(df: DataFrame, digits: int = 6) -> Column:
    """sha256 of a row's canonical text."""
    return F.sha2(F.concat_ws("\x1f", *[_text(df, c, digits) for c in df.columns]), 256)


def tree_depth(df: DataFrame) -> int:
    """Levels below the root so that a leaf of ``df`` holds about ``LEAF_ROWS`` rows."""
    rows, depth = df.count(), 0
    while rows > LEAF_ROWS * FANOUT**depth and depth < MAX_DEPTH:
        depth += 1
    return depth


def tree_hash(df: DataFrame, depth: int | None = None, by: Sequence[str] | None = None, digits: int = 6) -> DataFrame:
    """``level, node, rows, sha256`` of every node of a hash tree over the rows; level 0 is the root.

    Rows fall into ``16 ** depth`` leaves by a digest of the columns ``by`` (all
    by default), so every leaf is a range of digests and ``node`` its hex prefix.
    A leaf hashes its sorted row hashes, each with how often it occurs; a node
    above hashes its children in order. Neither row order nor partitioning
    matters, there is no bound on rows, and equal rows are counted before they
    are shuffled. Two tables are compared at one ``depth`` by ``tree_changes``.
    An empty table has a root over nothing.
    """
    depth = tree_depth(df) if depth is None else depth
    place = F.sha2(F.concat_ws("\x1f", *[_text(df, c, digits) for c in (by or df.columns)]), 256)
    counted = (
        df.select(F.substring(place, 1, depth).alias("node"), row_hash(df, digits).alias("_row"))
        .groupBy("node", "_row")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    listed = F.array_sort(F.collect_list(F.concat_ws(":", "_row", "_n")))
    level = counted.groupBy("node").agg(F.sum("_n").alias("rows"), F.sha2(F.array_join(listed, ","), 256).alias("sha256"))
    level = level.select(F.lit(depth).alias("level"), "node", "rows", "sha256")
    nodes = level
    for above in range(depth - 1, -1, -1):
        children = F.array_sort(F.collect_list(F.concat_ws(":", "node", "sha256")))
        level = level.groupBy(F.substring("node", 1, above).alias("node")).agg(
            F.sum("rows").alias("rows"), F.sha2(F.array_join(children, ","), 256).alias("sha256")
        )
        level = level.select(F.lit(above).alias("level"), "node", "rows", "sha256")
        nodes = nodes.unionByName(level)
    root = df.sparkSession.createDataFrame([(0, "", 0, EMPTY_SHA256)], "level int, node string, rows long, sha256 string")
    return nodes.unionByName(root).groupBy("level", "node").agg(
        F.max("rows").alias("rows"), F.max_by("sha256", "rows").alias("sha256")
    )


def tree_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``level, node, rows_before, rows_after`` of the nodes whose hashes differ, or that one side lacks.

    Both are trees of one depth; the changed leaves are those of the deepest
    level, and ``rows_under`` picks their rows.
    """
    a = before.select("level", "node", F.col("rows").alias("rows_before"), F.col("sha256").alias("_a"))
    b = after.select("level", "node", F.col("rows").alias("rows_after"), F.col("sha256").alias("_b"))
    changed = a.join(b, ["level", "node"], "full_outer").filter(~F.col("_a").eqNullSafe(F.col("_b")))
    return changed.drop("_a", "_b").fillna(0, ["rows_before", "rows_after"])


def rows_under(df: DataFrame, changes: DataFrame, depth: int, by: Sequence[str] | None = None, digits: int = 6) -> DataFrame:
    """The rows of ``df`` in the changed leaves of a tree of that depth."""
    place = F.sha2(F.concat_ws("\x1f", *[_text(df, c, digits) for c in (by or df.columns)]), 256)
    leaves = changes.filter(F.col("level") == depth).select(F.col("node").alias("_leaf"))
    return df.withColumn("_leaf", F.substring(place, 1, depth)).join(leaves, "_leaf", "left_semi").drop("_leaf")


def canonical_hash(df: DataFrame, digits: int = 6, max_rows: int | None = None) -> DataFrame:
    """sha256 of the sorted rows as CSV text; any size, unless ``max_rows`` makes more rows an error.

    Rows are sorted and joined to blocks of text by all tasks. One digest over
    one text is sequential by definition, so a last task feeds it the blocks in
    order, one Arrow batch at a time, and holds no more than that.
    """

    def field(name: str) -> Column:
        text = _text(df, name, digits)
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(text.rlike('[,"\r\n]'), quoted).otherwise(text)

    keys = []
    for i, name in enumerate(df.columns):
        whole = isinstance(df.schema[name].dataType, T.IntegralType)
        keys.append((F.col(name) if whole else _text(df, name, digits)).alias(f"_k{i}"))
    line = F.concat_ws(",", *[field(c) for c in df.columns])
    ordered = df.select(*keys, line.alias("_line")).orderBy(*[f"_k{i}" for i in range(len(keys))]).select("_line")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # equal rows share a range, so the number of the range and of the block in it give the order
        part = TaskContext.get().partitionId()
        for place, batch in enumerate(batches):
            lines = batch.column(0).to_pylist()
            text = "".join(f"{x}\n" for x in lines).encode()
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "place": [place], "rows": [len(lines)], "text": [text]}
            )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, state = 0, hashlib.sha256()
        for batch in batches:
            for n, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows += n
                state.update(text.as_buffer())
        yield pa.RecordBatch.from_pydict({"rows": [rows], "sha256": [state.hexdigest()]})

    blocks = ordered.mapInArrow(joined, "part int, place long, rows long, text binary")
    header = F.lit(",".join(df.columns) + "\n").cast("binary")
    first = df.sparkSession.range(1).select(
        F.lit(-1).alias("part"), F.col("id").alias("place"), F.lit(0).cast("long").alias("rows"), header.alias("text")
    )
    stream = first.unionByName(blocks).repartition(1).sortWithinPartitions("part", "place")
    hashed = stream.select("rows", "text").mapInArrow(digest, "rows long, sha256 string")
    if max_rows is None:
        return hashed
    problem = F.raise_error(F.lit(f"more than {max_rows} rows: use table_fingerprint")).cast("string")
    return hashed.withColumn("sha256", F.when(F.col("rows") <= max_rows, F.col("sha256")).otherwise(problem))


def id_set_hash(df: DataFrame, u: str = UNIT, max_ids: int = 1_000_000) -> DataFrame:
    """sha256 of the sorted id set as compact JSON; for id sets up to ``max_ids``."""
    ids = df.select(F.col(u).cast("long").alias("_id")).distinct().limit(max_ids + 1)
    listed = F.array_join(F.transform(F.sort_array(F.collect_list("_id")), lambda i: i.cast("string")), ",")
    gathered = ids.agg(F.count(F.lit(1)).alias("ids"), listed.alias("_text"))
    problem = F.raise_error(F.lit(f"more than {max_ids} ids")).cast("string")
    text = F.concat(F.lit("["), F.col("_text"), F.lit("]"))
    return gathered.select(
        "ids", F.when(F.col("ids") <= max_ids, F.sha2(text, 256)).otherwise(problem).alias("sha256")
    )


def verify_fingerprints(recorded: DataFrame, recomputed: DataFrame, key: str = "table") -> DataFrame:
    """Recorded against recomputed fingerprints; a table missing on either side fails."""
    names = [c for c in recorded.columns if c != key]
    joined = recorded.alias("a").join(recomputed.alias("b"), key, "full_outer")
    same = F.lit(True)
    for n in names:
        same = same & F.coalesce(F.col(f"a.{n}") == F.col(f"b.{n}"), F.lit(False))
    return joined.select(key, same.alias("passed"))
