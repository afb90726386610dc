"""Alignment of two tokenizers over a corpus: where their tokens meet, and which ids belong together.

A text is encoded by a byte-level BPE (A) and by a sentence-piece model (B).
Arrow kernels do the alignment of a few documents at a time, all tokens of them
in flat arrays:

1. Lists of ids are flattened with their parent indices; token byte lengths,
   summed up within each document, give every token's end.
2. A hash join of both sides on (document, end) finds the ends. Between two
   neighbouring ends lies exactly one token of A and one of B, so each line of
   the joined table is one link; an end of both sides closes a group.
3. Links are counted per document and id pair, and per id pair in every task;
   Spark adds up the partial counts and joins the totals back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .bytebpe import byte_encoder
from .common import BROADCAST_ROWS, lean, text_or_empty, worker_state, written

TEXT_BYTES = 512 << 10  # of texts aligned at a time; a longer text is aligned alone
PAIRS_HELD = 500_000  # distinct id pairs that a task counts before it hands them on
HOT_SHARE = 1_000  # an id pair with more than this part of all links is joined by broadcast
LINKED = (
    "n_a long, n_b long, n_groups long, n_links long, groups string, "
    "pairs array<struct<a:int,b:int,n:long>>"
)
_PAIR = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])


class Sides:
    """Both encoders of a worker and the bytes behind each of their ids."""

    def __init__(self, byte_path: str, piece_path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.encode_a = byte_encoder(byte_path, plain=True)
        self.pieces = SentencePieceProcessor(model_file=piece_path)
        size = max(self.encode_a.bytes_of) + 1
        self.bytes_a = pa.array([self.encode_a.bytes_of.get(i, b"") for i in range(size)], pa.binary())
        self.bytes_b = pa.array([self._piece(i) for i in range(self.pieces.get_piece_size())], pa.binary())
        self.lengths_a, self.lengths_b = pc.binary_length(self.bytes_a), pc.binary_length(self.bytes_b)

    def _piece(self, i: int) -> bytes:
        piece = self.pieces.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> tuple[pa.ListArray, pa.ListArray]:
        """Ids of A and of B, a list per text."""
        a = [self.encode_a(" " + t) for t in texts]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in a])]).astype(np.int32)
        flat = np.concatenate(a).astype(np.int32) if a else np.empty(0, np.int32)
        b = self.pieces.encode(texts, num_threads=1)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(b, pa.list_(pa.int32()))


def _joined_bytes(ids: pa.ListArray, table: pa.Array) -> pa.Array:
    parts = pc.take(table, ids.flatten())
    return pc.binary_join(pa.ListArray.from_arrays(_offsets(ids), parts), b"")


def _offsets(lists: pa.ListArray) -> pa.Array:
    """Offsets that fit ``flatten()``, also of a sliced or filtered array without nulls."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    return pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))


def _ends(ids: pa.ListArray, lengths: pa.Array, base: np.ndarray) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Flat ids, parent indices, and each token's document-end key: bytes of earlier documents plus its end."""
    flat, parent = ids.flatten(), pc.list_parent_indices(ids)
    running = pc.cumulative_sum(pc.cast(pc.take(lengths, flat), pa.int64())).to_numpy()
    last = _offsets(ids).to_numpy()[:-1]
    before = np.where(last > 0, running[np.maximum(last - 1, 0)], 0)  # running sum where the segment starts
    document = parent.to_numpy()
    return flat, parent, running - before[document] + base[document]


def _strings(ids: pa.Array, ends: np.ndarray) -> pa.Array:
    """Comma-joined decimal ids of each run of tokens; ``ends`` are the runs' exclusive ends."""
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(offsets, pc.cast(ids, pa.string())), ",")


def align(texts: list[str], sides: Sides) -> pa.RecordBatch:
    """``n_a, n_b, n_groups, n_links, groups, pairs`` of every text; zeros where it has no tokens."""
    a, b = sides.encode(texts)
    whole = pa.array([b" " + t.encode() for t in texts], pa.binary())
    same = pc.and_(
        pc.equal(_joined_bytes(a, sides.bytes_a), whole), pc.equal(_joined_bytes(b, sides.bytes_b), whole)
    )
    good = pc.and_(same, pc.greater(pc.binary_length(whole), 1))
    rows = np.flatnonzero(good.to_numpy(zero_copy_only=False))
    counts = np.zeros((4, len(texts)), np.int64)
    place = np.full(len(texts), -1)
    place[rows] = np.arange(len(rows))
    groups, pairs = pa.array([], pa.string()), pa.array([], pa.list_(_PAIR))
    if len(rows):
        a, b = a.filter(good), b.filter(good)
        sizes = pc.binary_length(whole.filter(good)).to_numpy().astype(np.int64)
        base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        ids_a, parent_a, ends_a = _ends(a, sides.lengths_a, base)
        ids_b, _, ends_b = _ends(b, sides.lengths_b, base)
        left = pa.table({"end": ends_a, "a": ids_a})
        right = pa.table({"end": ends_b, "b": ids_b})
        met = left.join(right, "end", join_type="full outer", use_threads=False).sort_by("end")
        has_a = met["a"].is_valid().to_numpy().astype(np.int64)
        has_b = met["b"].is_valid().to_numpy().astype(np.int64)
        # tokens that ended before an end are as many as the index of the token over it
        at_a, at_b = np.cumsum(has_a) - has_a, np.cumsum(has_b) - has_b
        document = parent_a.to_numpy()[at_a]
        links = pa.table({"d": document, "a": ids_a.take(pa.array(at_a)), "b": ids_b.take(pa.array(at_b))})
        found = links.group_by(["d", "a", "b"], use_threads=False).aggregate([([], "count_all")])
        found = found.sort_by("d").combine_chunks()
        per = np.bincount(found["d"].to_numpy(), minlength=len(rows))
        cells = pa.StructArray.from_arrays(
            [found[c].combine_chunks() for c in ("a", "b", "count_all")], fields=list(_PAIR)
        )
        pairs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), cells)
        both = np.flatnonzero(has_a & has_b)
        shown = pc.binary_join_element_wise(
            _strings(ids_a, at_a[both] + 1), _strings(ids_b, at_b[both] + 1), "|"
        )
        n_groups = np.bincount(document[both], minlength=len(rows))
        groups = pc.binary_join(
            pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_groups)]).astype(np.int32)), shown), ";"
        )
        counts[0, rows] = a.value_lengths().to_numpy()
        counts[1, rows] = b.value_lengths().to_numpy()
        counts[2, rows], counts[3, rows] = n_groups, np.bincount(document, minlength=len(rows))
    place = pa.array(place, mask=place < 0)
    return pa.RecordBatch.from_arrays(
        [*[pa.array(c) for c in counts], pc.fill_null(groups.take(place), ""), pairs.take(place)],
        names=["n_a", "n_b", "n_groups", "n_links", "groups", "pairs"],
    )


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``TEXT_BYTES`` each."""
    low, held = 0, 0
    for i, size in enumerate(sizes):
        if i > low and held + size > TEXT_BYTES:
            yield low, i
            low, held = i, 0
        held += size
    if low < len(sizes):
        yield low, len(sizes)


def linked(docs: DataFrame, byte_path: str, piece_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: token counts, ``groups`` as text, and ``pairs``, how many links hold each id pair (null: none).

    The paths name files that every worker can open. Texts that are null,
    empty, or that a tokenizer does not give back byte for byte have no tokens.
    """
    source = docs.select(F.col(key).alias("doc_id"), text_or_empty(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = worker_state("token_sides", dict)
        sides = held.get((byte_path, piece_path)) or held.setdefault((byte_path, piece_path), Sides(byte_path, piece_path))
        for batch in batches:
            column = batch.column("text")
            for low, high in _slices(pc.binary_length(column).to_pylist()):
                found = align(column.slice(low, high - low).to_pylist(), sides)
                keys = batch.column("doc_id").slice(low, high - low)
                yield pa.RecordBatch.from_arrays([keys, *found.columns], names=["doc_id", *found.schema.names])

    return source.mapInArrow(lean(run), f"doc_id {kind}, {LINKED}")


def pair_counts(lines: DataFrame) -> DataFrame:
    """``a, b, count, best``: links of an id pair over all lines, and whether no pair of its B id has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def added() -> pa.Table:
            whole = pa.concat_tables(held).group_by(["a", "b"], use_threads=False).aggregate([("n", "sum")])
            return whole.rename_columns({"n_sum": "n"}).select(["a", "b", "n"])

        for batch in batches:
            cells = batch.column("pairs").flatten()
            held.append(pa.table({f: cells.field(f) for f in ("a", "b", "n")}))
            if sum(t.num_rows for t in held) > 4 * PAIRS_HELD:
                held = [added()]
                if held[0].num_rows > PAIRS_HELD:
                    yield from held.pop().to_batches()
        if held:
            yield from added().to_batches()

    parts = lines.select("pairs").mapInArrow(lean(run), "a int, b int, n long")
    totals = parts.groupBy("a", "b").agg(F.sum("n").alias("count"))
    # a B id meets at most as many A ids as its vocabulary has
    most = F.max("count").over(Window.partitionBy("b"))
    return totals.withColumn("best", F.col("count") == most)


def with_counts(lines: DataFrame, totals: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``lines`` with ``n_best`` and ``count_sum`` over their pairs; both tables written ones.

    ``lines`` needs a column ``row`` that tells its rows apart. Totals of up to
    ``rows`` pairs are broadcast. Beyond that only pairs with over a thousandth
    of all links are, fewer than a thousand, and the others, none of them hot,
    meet their total in a shuffle.
    """
    names = [c for c in lines.columns if c != "pairs"]
    pairs = lines.select("row", F.explode("pairs").alias("_p")).select("row", "_p.a", "_p.b", "_p.n")
    if totals.count() <= rows:
        met = pairs.join(F.broadcast(totals), ["a", "b"])
    else:
        links = totals.agg(F.sum("count")).first()[0]
        hot = F.col("count") > links / HOT_SHARE
        frequent = F.broadcast(totals.filter(hot))
        rare = pairs.join(frequent.select("a", "b"), ["a", "b"], "left_anti").join(totals.filter(~hot), ["a", "b"])
        met = pairs.join(frequent, ["a", "b"]).unionByName(rare)
    sums = met.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"),
        F.sum(F.col("n") * F.col("count")).alias("count_sum"),
    )
    return lines.select(names).join(sums, "row", "left").fillna(0, ["n_best", "count_sum"]).drop("row")


def aligned(docs: DataFrame, byte_path: str, piece_path: str, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """Every row of ``docs``: counts, its ``groups`` (their SHA-256 with ``digest``), ``n_best`` and ``count_sum``.

    Repeated rows each count and each return a line, rows without id too; other
    columns of ``docs`` are not read. An empty table gives an empty table.
    """
    lines = linked(docs, byte_path, piece_path, key, text)
    if digest:
        shown = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
        lines = lines.withColumn("groups_sha256", shown).drop("groups")
    lines = written(lines.withColumn("row", F.monotonically_increasing_id()), "token_links")
    totals = written(pair_counts(lines), "token_pairs")
    return with_counts(lines, totals)
