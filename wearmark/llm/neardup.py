"""Near duplicates: consistent weighted sampling over TF-IDF shingles, banded and verified.

1. Whole texts become sorted 32-bit hashes of their five-word shingles, repeats
   kept, written once to the shared folder.
2. Document frequencies are counted over all documents in hashed features (as
   feature-hashing TF-IDF does): a fixed-size table whose relative error
   depends on the length of documents, not on their number.
3. Improved consistent weighted sampling draws ``BANDS * ROWS`` samples per
   text; a band of ``ROWS`` samples is a bucket key.
4. Within a bucket texts are compared by their samples; a pair is a candidate if
   it lies on the maximum spanning forest or among the nearest of one of its
   texts, so a group of copies gives a number of pairs linear in its size. Large
   buckets are cut into chunks, and every text meets the leaders of the others.
5. Candidate pairs are verified by the weighted Jaccard similarity of the whole
   shingle sets (TF-IDF or unit weights), and links are joined into classes.
6. Texts of one bucket that are still in different classes are all compared by
   their whole shingle sets, so no link between texts that share a bucket is missed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import delete_written, lean, small_side, text_or_empty, written
from .graph import components

WORDS = 5
SIMILAR = 0.8
BANDS = 12
ROWS = 4
FEATURE_BITS = 18
TABLE_BITS = 16
CHUNK = 1_000  # texts of one bucket compared in one piece
LIKELY = 0.6  # sampled similarity from which a pair is verified: over three deviations below SIMILAR
NEAREST = 8  # partners that each text is paired with in any case
LEADERS = 8  # texts of a group that meet the other chunks of their bucket
LEADER_BLOCK = 4_000
REST_BLOCK = 250  # texts of a bucket of several classes compared exactly in one piece, and their bytes
REST_BYTES = 2 << 20
SEED = 20_11
HOT_CLASSES = 1_000  # a class with more than this part of all rows is joined by broadcast
WORD_CACHE = 200_000
ELEMENTS = 1 << 16  # shingles sketched at a time

_BLOCK = 4096


class _WordHashes(dict):
    """64-bit hashes of words, kept while few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: str | None, hashes: dict) -> np.ndarray:
    """Sorted shingle hashes of a whole text, repeats kept.

    A text of one to four words is one shingle; an empty or null text has none.
    """
    words = (text or "").encode().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint32)
    codes = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    width = min(WORDS, n)
    mixed = codes[: n - width + 1].copy()
    for shift in range(1, width):
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed += codes[shift : n - width + 1 + shift]
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return np.sort((mixed >> np.uint64(32)).astype(np.uint32))


def shingled(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, text_key, node, shingles``: the node is the digest of the shingle multiset, equal for equal texts."""
    source = docs.select(F.col(key).alias("doc_id"), text_key(text).alias("text_key"), text_or_empty(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            found = [shingles(t.as_py(), hashes).tobytes() for t in batch.column("text")]
            nodes = [xxhash.xxh128_digest(f) for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(nodes, pa.binary()), pa.array(found, pa.binary())],
                names=["doc_id", "text_key", "node", "shingles"],
            )

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(lean(run), f"doc_id {kind}, text_key string, node binary, shingles binary")


def _distinct(values: np.ndarray) -> np.ndarray:
    """First positions of the distinct values of a sorted array."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.empty(0, int)


def feature_weights(table: DataFrame) -> np.ndarray:
    """Inverse document frequency of every hashed feature, between 1 and 2, over all documents.

    ``1 + ln((N + 1) / (df + 1)) / ln(N + 1)``: shared boilerplate weighs half
    of what is unique, and never nothing, so copies in a huge group stay
    similar. Counts leave a task as blocks of a fixed table and are added in two
    levels; only the fixed table comes to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << FEATURE_BITS, np.int64)
        rows = 0
        for batch in batches:
            for cell in batch.column("shingles"):
                features = np.frombuffer(cell.as_py(), np.uint32) >> np.uint32(32 - FEATURE_BITS)
                table[features[_distinct(features)]] += 1
                rows += 1
        if rows:
            blocks = table.reshape(-1, _BLOCK)
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(len(blocks)), pa.int32()),
                    pa.array([part // 64] * len(blocks), pa.int32()),
                    pa.array([zlib.compress(b.tobytes(), 1) for b in blocks], pa.binary()),
                ],
                names=["block", "part", "counts"],
            )

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(c), np.int64) for c in group["counts"])
        return pd.DataFrame(
            {"block": [group["block"].iloc[0]], "part": [0], "counts": [zlib.compress(total.tobytes(), 1)]}
        )

    kind = "block int, part int, counts binary"
    counted = table.select("shingles").mapInArrow(lean(count), kind)
    summed = counted.groupBy("block", "part").applyInPandas(add, kind).groupBy("block").applyInPandas(add, kind)
    df = np.zeros(1 << FEATURE_BITS, np.float64)
    for row in summed.collect():
        df[row["block"] * _BLOCK : (row["block"] + 1) * _BLOCK] = np.frombuffer(zlib.decompress(row["counts"]), np.int64)
    n = table.count()
    return (1 + np.log((n + 1) / (df + 1)) / np.log(n + 2)).astype(np.float32)


def weighted(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a sorted multiset and their TF-IDF weights, ``(1 + ln tf) * idf``.

    The logarithm keeps a line repeated a thousand times from being the whole text.
    """
    first = _distinct(values)
    repeats = np.diff(np.append(first, len(values)))
    kept = values[first]
    return kept, (1 + np.log(repeats.astype(np.float32))) * weights[kept >> np.uint32(32 - FEATURE_BITS)]


def jaccard(a: np.ndarray, b: np.ndarray, weights: np.ndarray) -> float:
    """Weighted Jaccard similarity of two shingle multisets, by TF-IDF or by unit weights, whichever is larger.

    In a very large group of near copies what is shared is frequent and so
    weighs less than what differs; unit weights keep its links. 1 for two empty
    multisets.
    """
    (ka, wa), (kb, wb) = weighted(a, weights), weighted(b, weights)
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    low = np.minimum(wa[ia], wb[ib]).sum(dtype=np.float64)
    whole = wa.sum(dtype=np.float64) + wb.sum(dtype=np.float64) - low
    either = len(ka) + len(kb) - len(ia)
    return max(float(low / whole), len(ia) / either) if either else 1.0


class Sampler:
    """Improved consistent weighted sampling with tabulated random variables."""

    def __init__(self) -> None:
        n = 1 << TABLE_BITS
        rng = np.random.default_rng(SEED)
        self.tables = []
        for _ in range(BANDS * ROWS):
            u = 1.0 - rng.random((5, n))
            r = -np.log(u[0] * u[1])
            self.tables.append(
                (
                    r.astype(np.float32),
                    (1 / r).astype(np.float32),
                    u[4].astype(np.float32),
                    (-np.log(u[2] * u[3])).astype(np.float32),
                )
            )
        self.tables = [(r, i, b, np.log(c) + np.float32(64)) for r, i, b, c in self.tables]
        self.odd = (rng.integers(1, 1 << 31, BANDS * ROWS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)

    def draw(self, keys: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One row of ``BANDS * ROWS`` sample codes per segment of ``keys`` (no segment is empty)."""
        log_weight = np.log(weights)
        place = np.arange(len(keys), dtype=np.uint64)
        codes = np.empty((len(starts), BANDS * ROWS), np.uint32)
        for k, (r, inverse, beta, log_c) in enumerate(self.tables):
            at = ((keys * self.odd[k]) >> np.uint32(32 - TABLE_BITS)).astype(np.intp)
            b = beta[at]
            t = np.floor(log_weight * inverse[at] + b)
            log_a = log_c[at] - r[at] * (t - b + np.float32(1))
            order = (np.maximum(log_a, np.float32(0)).view(np.uint32).astype(np.uint64) << np.uint64(32)) | place
            best = (np.minimum.reduceat(order, starts) & np.uint64(0xFFFFFFFF)).astype(np.intp)
            codes[:, k] = keys[best] * np.uint32(0x85EBCA6B) + t[best].astype(np.int32).view(np.uint32)
        return codes


def band_keys(codes: np.ndarray) -> np.ndarray:
    """A 64-bit key per band of a row of sample codes."""
    mixed = np.zeros((len(codes), BANDS), np.uint64)
    for row in range(ROWS):
        mixed = (mixed ^ codes[:, row::ROWS][:, :BANDS].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed.view(np.int64)


def sketched(table: DataFrame, weights: np.ndarray) -> DataFrame:
    """``node, bands, codes`` of every row with shingles; rows of equal nodes are equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        for batch in batches:
            nodes, cells = batch.column("node").to_pylist(), batch.column("shingles").to_pylist()
            at = 0
            while at < len(nodes):
                keys, masses, starts, names, size = [], [], [], [], 0
                while at < len(nodes) and (not names or size < ELEMENTS):
                    k, w = weighted(np.frombuffer(cells[at], np.uint32), weights)
                    if len(k):
                        keys.append(k), masses.append(w), starts.append(size), names.append(nodes[at])
                        size += len(k)
                    at += 1
                if not names:
                    continue
                codes = sampler.draw(np.concatenate(keys), np.concatenate(masses), np.array(starts))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names, pa.binary()),
                        pa.array(list(band_keys(codes)), pa.list_(pa.int64())),
                        pa.array([c.tobytes() for c in codes], pa.binary()),
                    ],
                    names=["node", "bands", "codes"],
                )

    return table.select("node", "shingles").mapInArrow(lean(run), "node binary, bands array<bigint>, codes binary")


def candidates_of(table: np.ndarray) -> tuple[list[tuple[int, int]], list[int]]:
    """Candidate pairs of rows of sample codes, and rows that stand for their group.

    A row is paired with its ``NEAREST`` most similar ones, and the edges of the
    maximum spanning forest join what is similar at all, so pairs grow with the
    rows. Leaders are the ``LEADERS`` rows with most pairs in each tree.
    """
    n = len(table)
    if n == 2:
        return ([(0, 1)] if (table[0] == table[1]).mean() >= LIKELY else []), [0, 1]
    alike = np.empty((n, n), np.float32)
    for i in range(n):
        alike[i] = (table == table[i]).mean(axis=1)
    alike[alike < LIKELY] = 0
    np.fill_diagonal(alike, 0)
    near = np.argsort(-alike, axis=1, kind="stable")[:, :NEAREST]
    pairs = {(min(i, j), max(i, j)) for i in range(n) for j in near[i].tolist() if alike[i, j]}
    # Prim: the row most similar to the tree so far joins it; none similar starts a new tree
    left = np.ones(n, bool)
    best, parent = np.zeros(n, np.float32), np.full(n, -1)
    tree = np.empty(n, int)
    for _ in range(n):
        i = int(np.argmax(np.where(left, best, -1)))
        left[i] = False
        tree[i] = tree[parent[i]] if best[i] else i
        if best[i]:
            pairs.add((min(i, int(parent[i])), max(i, int(parent[i]))))
        closer = left & (alike[i] > best)
        best[closer], parent[closer] = alike[i][closer], i
    degree = np.bincount(np.array(list(pairs), int).reshape(-1), minlength=n)
    leaders: list[int] = []
    for root in np.unique(tree):
        rows = np.flatnonzero(tree == root)
        leaders += rows[np.argsort(-degree[rows], kind="stable")[:LEADERS]].tolist()
    return sorted(pairs), leaders


def _samples(members: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Nodes, sample codes and list ends of a column of member lists."""
    inner = members.flatten()
    nodes = inner.field("node").to_pylist()
    table = np.frombuffer(b"".join(inner.field("codes").to_pylist()), np.uint32).reshape(len(nodes), BANDS * ROWS)
    return nodes, table, np.cumsum(members.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))


def _compared(groups: DataFrame) -> DataFrame:
    """Pairs (``leader`` false) and, of cut buckets, leaders (true) of every ``band, key, many, members`` line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, table, ends = _samples(batch.column("members"))
            out: list[tuple] = []
            columns = (batch.column(c).to_pylist() for c in ("band", "key", "many"))
            for end, start, band, key, many in zip(ends, np.concatenate(([0], ends[:-1])), *columns):
                pairs, leaders = candidates_of(table[start:end])
                own = nodes[start:end]
                out += [(False, 0, 0, min(own[i], own[j]), max(own[i], own[j])) for i, j in pairs]
                if many:
                    out += [(True, band, key, own[i], table[start + i].tobytes()) for i in leaders]
            columns = list(zip(*out)) or [()] * 5
            kinds = [pa.bool_(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["leader", "band", "key", "a", "b"]
            )

    schema = "leader boolean, band int, key bigint, a binary, b binary"
    return groups.select("band", "key", "many", "members").mapInArrow(lean(run), schema)


def _crossed(meetings: DataFrame) -> DataFrame:
    """Pairs of every member with the ``NEAREST`` most similar of the ``leaders`` in its line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, table, ends = _samples(batch.column("members"))
            heads, codes, stops = _samples(batch.column("leaders"))
            pairs: set[tuple[bytes, bytes]] = set()
            at = stop_before = 0
            for end, stop in zip(ends, stops):
                there = codes[stop_before:stop]
                for i in range(at, end):
                    alike = (there == table[i]).mean(axis=1)
                    for j in np.argsort(-alike, kind="stable")[: NEAREST + 1]:
                        a, b = nodes[i], heads[stop_before + j]
                        if alike[j] >= LIKELY and a != b:
                            pairs.add((min(a, b), max(a, b)))
                at, stop_before = end, stop
            columns = list(zip(*sorted(pairs))) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()) for c in columns], names=["a", "b"])

    return meetings.select("members", "leaders").mapInArrow(lean(run), "a binary, b binary")


def candidate_pairs(sketches: DataFrame) -> DataFrame:
    """Distinct pairs ``a < b`` of nodes whose samples look similar in some shared bucket.

    ``sketches`` has one line per node. Buckets of one text vanish before any
    samples move. A bucket above ``CHUNK`` texts is cut by a hash, and all its
    texts meet the leaders of all its chunks, a block of leaders at a time.
    """
    rows = sketches.select("node", F.posexplode("bands").alias("band", "key"))
    sizes = rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    member = F.struct("node", "codes")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    # the codes join only the rows of shared buckets
    shared = rows.join(sizes, ["band", "key"]).select(
        "node",
        "band",
        "key",
        (F.col("n") > CHUNK).alias("many"),
        F.pmod(F.xxhash64("node"), chunks).alias("chunk"),
    )
    salted = shared.join(sketches.select("node", "codes"), "node")
    listed = lambda frame, *more: frame.groupBy("band", "key", *more).agg(F.collect_list(member).alias("members"))
    first = written(_compared(listed(salted, "many", "chunk")), "candidates")
    pairs = first.filter("not leader").select("a", "b")
    leaders = first.filter("leader").select("band", "key", F.col("a").alias("node"), F.col("b").alias("codes"))
    if leaders.isEmpty():
        return pairs.distinct()
    blocks = leaders.groupBy("band", "key").agg(F.ceil(F.count(F.lit(1)) / LEADER_BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block")
    heads = listed(leaders.join(blocks, ["band", "key"]).select("*", block), "block").withColumnRenamed("members", "leaders")
    cut = listed(salted.filter("many"), "chunk")
    return pairs.unionByName(_crossed(cut.join(heads, ["band", "key"]))).distinct()


def _sets(table: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, shingles`` of the distinct ``nodes``, one row each."""
    nodes = written(nodes, "nodes")
    # one row per node: the copies of a text share its node, so the smallest id stands for them
    picked = (
        table.select("node", "doc_id")
        .join(small_side(nodes), "node", "left_semi")
        .groupBy("node")
        .agg(F.min("doc_id").alias("doc_id"))
    )
    picked = written(picked, "picked")
    same = table["doc_id"].eqNullSafe(picked["doc_id"])
    sets = table.join(small_side(picked), (table["node"] == picked["node"]) & same, "left_semi")
    return sets.select("node", "shingles").dropDuplicates(["node"])


def verified(pairs: DataFrame, table: DataFrame, weights: np.ndarray, similar: float = SIMILAR) -> DataFrame:
    """``u, v, similarity`` of the pairs whose whole shingle sets are similar enough."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = _sets(table, nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                jaccard(np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32), weights)
                for x, y in zip(batch.column("x"), batch.column("y"))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], names=["u", "v", "similarity"]
            )

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b"
    )
    return both.select("a", "b", "x", "y").mapInArrow(lean(run), "u binary, v binary, similarity double").filter(
        F.col("similarity") >= similar
    )


def _links_between(
    sets: list[tuple[np.ndarray, np.ndarray]],
    labels: list[bytes],
    bands: np.ndarray,
    band: int,
    left: list[int],
    right: list[int],
    similar: float,
) -> Iterator[tuple[int, int, float]]:
    """Links between ``left`` and ``right`` rows of different classes, until they are in one.

    A pair is compared in the first bucket it shares. The only pairs passed over
    without a comparison are those whose sizes alone keep both similarities under
    ``similar``, and those that links found here have joined already.
    """
    count = np.array([len(k) for k, _ in sets])
    mass = np.array([w.sum(dtype=np.float64) for _, w in sets])
    ids = np.split(np.unique(np.concatenate([k for k, _ in sets]), return_inverse=True)[1], np.cumsum(count)[:-1])
    shares = np.zeros(max(int(i[-1]) for i in ids) + 1, np.float32)
    numbers = {label: n for n, label in enumerate(dict.fromkeys(labels))}
    joined = np.array([numbers[label] for label in labels])
    others = np.array(right)
    floor = similar - 1e-6  # sums in another order may differ in their last digits
    for i in left:
        low, high = np.minimum(count[i], count[others]), np.maximum(count[i], count[others])
        near = low >= floor * high
        near |= np.minimum(mass[i], mass[others]) >= floor * np.maximum(mass[i], mass[others])
        near &= joined[others] != joined[i]
        near &= (bands[others] == bands[i]).argmax(axis=1) == band
        if not near.any():
            continue
        shares[ids[i]] = sets[i][1]
        for j in others[near].tolist():
            if joined[i] == joined[j]:
                continue
            there = shares[ids[j]]
            low = float(np.minimum(there, sets[j][1]).sum(dtype=np.float64))
            both = int(np.count_nonzero(there))
            found = max(low / (mass[i] + mass[j] - low), both / (count[i] + count[j] - both))
            if found >= similar:
                joined[joined == joined[j]] = joined[i]
                yield i, j, float(found)
        shares[ids[i]] = 0


def missed_links(
    sketches: DataFrame, table: DataFrame, labels: DataFrame, weights: np.ndarray, similar: float = SIMILAR
) -> DataFrame:
    """``u, v, similarity`` of links between texts that share a bucket but not a class of ``labels``.

    Whole shingle sets are compared, whatever the samples say. In a bucket of
    several classes the texts of its largest class meet all others, and the
    others meet each other, a block by a block; texts of one class do not meet.
    """
    named = sketches.select("node", "bands").join(labels, "node", "left")
    rows = named.select("node", F.coalesce("label", "node").alias("label"), F.posexplode("bands").alias("band", "key"))
    parts = rows.groupBy("band", "key", "label").agg(F.count(F.lit(1)).alias("n"))
    buckets = parts.groupBy("band", "key").agg(
        F.count(F.lit(1)).alias("classes"), F.max(F.struct("n", "label"))["label"].alias("main")
    )
    mixed = buckets.filter("classes > 1").drop("classes")
    shared = rows.join(mixed, ["band", "key"]).withColumn("main", F.col("label") == F.col("main"))
    shared = written(shared.select("node", "label", "band", "key", "main"), "shared")
    sets = _sets(table, shared.select("node").distinct()).join(sketches.select("node", "bands"), "node")
    sets = written(sets, "sets")
    sized = shared.join(sets.select("node", F.octet_length("shingles").alias("size")), "node")
    cuts = lambda of: F.ceil(
        F.greatest(F.count_if(of) / REST_BLOCK, F.sum(F.when(of, F.col("size")).otherwise(0)) / REST_BYTES)
    ).cast("int")
    blocks = sized.groupBy("band", "key").agg(cuts(F.col("main")).alias("heads"), cuts(~F.col("main")).alias("rest"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("main"), F.col("heads")).otherwise(F.col("rest"))).cast("int")
    placed = shared.join(blocks, ["band", "key"]).withColumn("own", own)
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    cell = lambda heads, i, j: F.struct(F.lit(heads).alias("heads"), i.alias("i"), j.alias("j"))
    me = F.col("own")
    with_heads = F.transform(upto(F.col("heads")), lambda i: cell(True, i, me))
    with_rest = F.transform(upto(F.col("rest")), lambda j: cell(False, F.least(me, j), F.greatest(me, j)))
    cells = F.when(F.col("main"), F.transform(upto(F.col("rest")), lambda j: cell(True, me, j))).otherwise(
        F.concat(with_heads, with_rest)
    )
    dealt = placed.select("node", "label", "band", "key", "main", "own", F.explode(cells).alias("cell")).join(sets, "node")
    member = F.struct("node", "label", "main", "own", "bands", "shingles")
    lists = dealt.groupBy("band", "key", "cell").agg(F.collect_list(member).alias("members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for at, (band, cell) in enumerate(zip(batch.column("band").to_pylist(), batch.column("cell").to_pylist())):
                members = sorted(batch.column("members")[at].as_py(), key=lambda m: m["node"])
                bands = np.array([m["bands"] for m in members], np.int64)
                found = [weighted(np.frombuffer(m["shingles"], np.uint32), weights) for m in members]
                if cell["heads"]:
                    left = [k for k, m in enumerate(members) if not m["main"]]
                    right = [k for k, m in enumerate(members) if m["main"]]
                else:
                    left = [k for k, m in enumerate(members) if m["own"] == cell["i"]]
                    right = [k for k, m in enumerate(members) if m["own"] == cell["j"]]
                if left and right:
                    names = [m["label"] for m in members]
                    for i, j, s in _links_between(found, names, bands, band, left, right, similar):
                        a, b = members[i]["node"], members[j]["node"]
                        out.append((min(a, b), max(a, b), s))
            columns = list(zip(*out)) or [()] * 3
            kinds = [pa.binary(), pa.binary(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["u", "v", "similarity"]
            )

    return lists.mapInArrow(lean(run), "u binary, v binary, similarity double")


def text_key(text: str) -> Column:
    """Digest that tells whole texts apart; null counts as empty."""
    return F.md5(F.encode(text_or_empty(text), "UTF-8"))


def with_class_line(rows: DataFrame, lines: DataFrame, size: str) -> DataFrame:
    """``rows`` joined to ``lines`` on ``label``; both are written tables.

    ``lines`` has one line per class with its ``size``. A class with over a
    thousandth of all rows would be one hot key: such lines, fewer than a
    thousand, are broadcast, and only the rows of other classes are shuffled.
    """
    total = lines.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) * HOT_CLASSES > total
    large = F.broadcast(lines.filter(hot))
    small = rows.join(large.select("label"), "label", "left_anti").join(lines.filter(~hot), "label")
    return rows.join(large, "label").unionByName(small)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, class_id, class_size, n_links`` for every row of ``docs``.

    The class is named by its smallest id; ``n_links`` counts the verified links
    of the row's distinct text. Equal texts (repeated rows, empty and null
    texts among each other) share a class. Rows without an id get the class of
    their text. An empty table gives an empty one; other columns play no part.
    """
    rows = classes(docs, key, text).select("doc_id", "label", "n_links")
    rows = written(rows, "classes")
    lines = rows.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    found = with_class_line(rows, written(lines, "class_lines"), "class_size")
    return found.select("doc_id", "class_id", "class_size", "n_links")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text_key, label, n_links`` for every row: equal labels are one near-duplicate class."""
    table = written(shingled(docs, key, text), "shingles")
    weights = feature_weights(table)
    sketches = written(sketched(table, weights).dropDuplicates(["node"]), "sketches")
    pairs = written(candidate_pairs(sketches), "pairs")
    links = written(verified(pairs, table, weights), "links")
    labels = written(components(links.select("u", "v")), "labels")
    # every class is a star now, so the links of the second pass join classes in few rounds
    missed = written(missed_links(sketches, table, labels, weights), "missed")
    delete_written(sketches)
    if not missed.isEmpty():
        stars = labels.select(F.col("node").alias("u"), F.col("label").alias("v"))
        labels = written(components(stars.unionByName(missed.select("u", "v"))), "labels")
        links = links.unionByName(missed)
    ends = links.select(F.explode(F.array("u", "v")).alias("node"))
    degree = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    rows = table.select("doc_id", "text_key", "node").join(labels.join(degree, "node", "left"), "node", "left")
    return rows.select(
        "doc_id",
        "text_key",
        F.coalesce("label", "node").alias("label"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row per class: the smallest id, rows without an id last, ties by a digest of the text.

    Rows are told apart by id and whole text, so a repeated id drops no unique
    text, and of rows equal in both one stays.
    """
    rows = written(classes(docs, key, text).select("doc_id", "text_key", "label"), "classes")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_key").alias("text"))
    lines = rows.groupBy("label").agg(F.min(order).alias("kept"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = with_class_line(rows, written(lines, "class_lines"), "n")
    is_kept = F.col("doc_id").eqNullSafe(F.col("kept.id")) & (F.col("text_key") == F.col("kept.text"))
    marked = met.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"), F.max(is_kept).alias("kept"))
    # ids and texts to drop, and those of which one of several equal rows stays
    named = lambda df: df.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__text"))
    extra = named(written(marked.filter("not kept"), "extra"))
    twice = named(written(marked.filter("kept and n > 1"), "twice"))
    own = docs.withColumns({"__own_id": F.col(key), "__own_text": text_key(text)})
    same = lambda side: F.col("__own_id").eqNullSafe(side["__id"]) & (F.col("__own_text") == side["__text"])
    drop = small_side(extra)
    left = own.join(drop, same(drop), "left_anti")
    if not twice.isEmpty():
        side = small_side(twice)
        again = left.join(side, same(side), "left_semi").dropDuplicates(["__own_id", "__own_text"])
        left = left.join(side, same(side), "left_anti").unionByName(again)
    return left.select(*docs.columns)
