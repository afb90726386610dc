"""Packing token sequences by minimum bin slack over the multiset of piece lengths.

Documents are tokenised and cut into full windows and one remainder. Only the
histogram of remainder lengths (at most ``WINDOW`` numbers) reaches the driver;
there a bitset subset-sum programme picks, for the longest remaining length,
the companions that fill the window closest to its capacity, and applies the
pattern as often as the counts allow. Pieces then find their place by their
rank among pieces of the same length, so no piece visits the driver.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from .common import byte_letters, lean, ranked, text_or_empty, worker_state, written

WINDOW = 4096
END_ID = 2
CACHE_BYTES = 56 << 20  # of chunks and ids that a worker keeps, about 300,000 entries
ENTRY_BYTES = 160  # of one entry besides its text
ENCODE_ROWS = 200  # texts whose new chunks are looked up together
# Spaces of str.split that the tokenizer does not treat as white space.
_ODD_SPACE = "\x1c\x1d\x1e\x1f"
PIECE = "doc_id {kind}, start long, length int, ids_crc32 long, doc_tokens long"


class ChunkEncoder:
    """Ids of whole texts as little-endian 32-bit bytes, with a cache of white-space chunks.

    The tokenizer drops white space and never joins across it, so the ids of a
    text are those of its chunks in order. A chunk of letters only is one word
    to it and goes to its model at once, as does a word before a comma or full
    stop; all other chunks take the whole way.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.cache: dict[str, bytes] = {}
        self.held = 0
        self.marks = {mark: self._whole([mark])[0] for mark in ".,"}

    def _whole(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks by the whole tokenizer."""
        found = self.tokenizer.encode(chunks, is_pretokenized=True, add_special_tokens=False)
        if None in found.word_ids:  # a special token belongs to no word
            each = (self.tokenizer.encode(c, add_special_tokens=False) for c in chunks)
            return [np.array(e.ids, "<u4").tobytes() for e in each]
        ids, owner = np.array(found.ids, "<u4"), np.array(found.word_ids, float)
        ends = np.searchsorted(owner, np.arange(len(chunks)), side="right")
        return [part.tobytes() for part in np.split(ids, ends[:-1])]

    def _word(self, word: str) -> bytes:
        shown = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
        return np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()

    def _learn(self, fresh: set[str]) -> None:
        cache = self.cache
        other = []
        for chunk in fresh:
            if chunk.isalpha():
                cache[chunk] = self._word(chunk)
            elif chunk[-1] in self.marks and chunk[:-1].isalpha():
                word = chunk[:-1]
                if word not in cache:
                    cache[word] = self._word(word)
                cache[chunk] = cache[word] + self.marks[chunk[-1]]
            else:
                other.append(chunk)
        if other:
            cache.update(zip(other, self._whole(other)))
        self.held += sum(ENTRY_BYTES + 2 * len(chunk) + len(cache[chunk]) for chunk in fresh)

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        chunks: dict[int, list[str]] = {}
        for i, text in enumerate(texts):
            lower = text.lower()
            # lower-casing first is the tokenizer's own order only for composed texts
            composed = unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", lower)
            # Python lower-cases a final capital sigma by its place, the tokenizer does not
            if composed and "Σ" not in text and not any(c in text for c in _ODD_SPACE):
                chunks[i] = lower.split()
            else:
                found = self.tokenizer.encode(text, add_special_tokens=False)
                out[i] = np.array(found.ids, "<u4").tobytes()
        if self.held > CACHE_BYTES:
            self.cache.clear()
            self.held = 0
        self._learn(set().union(*chunks.values()).difference(self.cache))
        look = self.cache.__getitem__
        for i, parts in chunks.items():
            out[i] = b"".join(map(look, parts))
        return out


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per piece: full windows of a document's ids and its remainder.

    Every document ends with ``END_ID``, so an empty or null text is one piece
    of one id. ``tokenizer`` is a path that every worker can open.
    """
    source = docs.select(F.col(key).alias("doc_id"), text_or_empty(text).alias("text"))
    end = END_ID.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the cache outlives a task when Spark reuses the worker
        encoders = worker_state("chunk_encoders", dict)
        encode = encoders.get(tokenizer) or encoders.setdefault(tokenizer, ChunkEncoder(tokenizer))
        for batch in batches:
            at, starts, lengths, sums, totals = [], [], [], [], []
            for low in range(0, batch.num_rows, ENCODE_ROWS):
                texts = batch.column("text").slice(low, ENCODE_ROWS).to_pylist()
                for i, found in enumerate(encode(texts), low):
                    ids = memoryview(found + end)
                    total = len(ids) // 4
                    for start in range(0, total, window):
                        part = ids[start * 4 : (start + window) * 4]
                        at.append(i), starts.append(start), lengths.append(len(part) // 4)
                        sums.append(zlib.crc32(part)), totals.append(total)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(at, pa.int64())),
                    pa.array(starts, pa.int64()),
                    pa.array(lengths, pa.int32()),
                    pa.array(sums, pa.int64()),
                    pa.array(totals, pa.int64()),
                ],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return source.mapInArrow(lean(run), PIECE.format(kind=source.schema["doc_id"].dataType.simpleString()))


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of available lengths whose sum is closest below ``capacity``, longest lengths first.

    Bitset subset-sum: bit ``s`` of a mask is set when ``s`` is reachable. Each
    length enters in binary parts of its count, and a mask is kept per part to
    walk back from the best sum to the number taken of each length.
    """
    whole = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        left = min(counts[length], capacity // length)
        part = 1
        while left > 0:
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & whole
            left -= take
            part *= 2
        if reach >> capacity & 1:
            break
    total = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if before >> total & 1:
            continue
        chosen[length] = chosen.get(length, 0) + take
        total -= length * take
    return chosen


def patterns(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """Window contents as ``({length: count}, times)``, together exactly the histogram."""
    left = {length: n for length, n in histogram.items() if n > 0}
    found = []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        content = fill({x: n for x, n in rest.items() if n}, window - longest)
        content[longest] = content.get(longest, 0) + 1
        times = min(left[x] // n for x, n in content.items())
        found.append((content, times))
        for x, n in content.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
    return found


def places(found: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length, by first rank: arrays ``first_rank, per_window, first_sequence, offset`` of its patterns."""
    taken: dict[int, int] = {}
    lines: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for content, times in found:
        offset = 0
        for length in sorted(content, reverse=True):
            n = content[length]
            lines.setdefault(length, []).append((taken.get(length, 0), n, sequence, offset))
            taken[length] = taken.get(length, 0) + n * times
            offset += n * length
        sequence += times
    return {length: tuple(np.array(c, np.int64) for c in zip(*rows)) for length, rows in lines.items()}


def histogram_of(cut: DataFrame) -> dict[int, int]:
    """How many pieces there are of each length; at most one line per token of a window."""
    return {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}


def packed(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """The pieces with ``sequence_id, offset``: where each starts in its window.

    ``cut`` should be a written table of ``pieces``. Ties between pieces of one
    length are broken by document and start, so reruns agree; equal rows are
    interchangeable. No pieces give an empty table.
    """
    return placed(cut, patterns(histogram_of(cut), window))


def placed(cut: DataFrame, found: list[tuple[dict[int, int], int]]) -> DataFrame:
    """The pieces of a written table laid into the windows ``found``, which hold exactly their histogram."""
    table = places(found)
    numbered = ranked(cut, ["length"], ["doc_id", "start", "ids_crc32"], ["doc_id", "start"], "_rank")
    names = cut.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            ranks = batch.column("_rank").to_numpy()
            sequences, offsets = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                first, per, sequence, offset = table[int(length)]
                line = np.searchsorted(first, ranks[rows], side="right") - 1
                inside = ranks[rows] - first[line]
                sequences[rows] = sequence[line] + inside // per[line]
                offsets[rows] = offset[line] + inside % per[line] * length
            held = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*held, pa.array(sequences), pa.array(offsets)], names=[*names, "sequence_id", "offset"]
            )

    schema = StructType([*cut.schema, *StructType.fromDDL("sequence_id long, offset long")])
    return numbered.select(*names, "_rank").mapInArrow(lean(run), schema)


def packed_documents(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = WINDOW
) -> DataFrame:
    """Tokenise, cut and pack ``docs``; one row per piece. Repeated rows are packed each."""
    return packed(written(pieces(docs, tokenizer, key, text, window), "pieces"), window)
