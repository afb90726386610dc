"""Packing whole documents by patterns whose repeat counts solve a non-negative least squares problem.

Documents are tokenised; only those longer than a window are cut. The histogram
of piece lengths (at most ``WINDOW`` numbers) is all that the driver sees:

1. Patterns of a few documents that fill a window almost fully are enumerated
   over the lengths that occur.
2. Repeat counts ``x >= 0`` with the pattern matrix times ``x`` close to the
   histogram are found by accelerated projected gradients.
3. Counts are rounded, largest first, as far as pieces are left.
4. What remains is packed by best fit decreasing, by groups of equal windows,
   into the slack of the patterns and into new windows.

Pieces find their place by their rank among pieces of the same length, in Spark.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bytebpe import byte_encoder
from .common import lean, text_or_empty, written
from .packing import histogram_of, placed

WINDOW = 2048
END_ID = 0
FEW = 8  # documents in a pattern at most
PER_LENGTH = 12  # patterns whose longest document has a given length
SLACK = 1 / 256  # part of a window that a pattern may leave open
STEPS = 400  # of the least squares
PIECE = "doc_id {kind}, piece int, start long, length int, ids_crc32 long"

Windows = list[tuple[dict[int, int], int]]


def cuts(total: int, window: int = WINDOW) -> Iterator[tuple[int, int]]:
    """Start and length of the pieces of ``total`` ids: full windows, after a first piece of the rest."""
    start, length = 0, (total - 1) % window + 1
    while start < total:
        yield start, length
        start, length = start + length, window


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per piece of each document's ids, which end with ``END_ID``; a null or empty text is one id."""
    source = docs.select(F.col(key).alias("doc_id"), text_or_empty(text).alias("text"))
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_encoder(tokenizer)
        for batch in batches:
            at, numbers, starts, lengths, sums = [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                ids = memoryview(encode(text.as_py()).astype("<u4").tobytes() + end)
                for number, (start, length) in enumerate(cuts(len(ids) // 4, window)):
                    at.append(i), numbers.append(number), starts.append(start), lengths.append(length)
                    sums.append(zlib.crc32(ids[start * 4 : (start + length) * 4]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(at, pa.int64())),
                    pa.array(numbers, pa.int32()),
                    pa.array(starts, pa.int64()),
                    pa.array(lengths, pa.int32()),
                    pa.array(sums, pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return source.mapInArrow(lean(run), PIECE.format(kind=source.schema["doc_id"].dataType.simpleString()))


def enumerated(lengths: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Patterns as rows of indices into the sorted ``lengths``, padded with -1.

    The longest document is followed by every second one that fits, and the rest
    is filled with the longest that fits, again and again. Of the patterns with
    least slack each longest length keeps some, spread over second lengths.
    """
    if not len(lengths):
        return np.empty((0, FEW), np.int64)
    # index of the longest length up to each size, -1 below the shortest
    fits = np.searchsorted(lengths, np.arange(window + 1), side="right") - 1
    kept = [np.empty((0, FEW), np.int64)]
    open_tokens = int(window * SLACK)
    for first in range(len(lengths)):
        second = np.arange(first + 1)
        second = second[lengths[second] <= window - lengths[first]]
        rows = np.full((len(second) + 1, FEW), -1)
        rows[:, 0] = first
        rows[1:, 1] = second
        left = window - lengths[first] - np.concatenate([[0], lengths[second]])
        left[0] = 0 if lengths[first] >= window - open_tokens else window  # alone only when it nearly fills a window
        for place in range(2, FEW):
            # the smaller of what fits and the one before, so that each multiset appears once
            follow = np.minimum(fits[left], rows[:, place - 1])
            follow[0] = -1
            rows[:, place] = follow
            left = left - np.where(follow >= 0, lengths[follow], 0)
        good = np.flatnonzero(left <= open_tokens)
        if len(good) > PER_LENGTH:  # those that fill best
            good = good[left[good] <= np.partition(left[good], PER_LENGTH - 1)[PER_LENGTH - 1]]
            good = good[np.linspace(0, len(good) - 1, PER_LENGTH).astype(int)]
        kept.append(rows[good])
    return np.unique(np.concatenate(kept), axis=0)


def least_squares(patterns: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """``x >= 0`` that brings ``patterns`` times ``x`` close to ``histogram``.

    Accelerated projected gradients with restarts, the columns and rows scaled
    so that rare lengths count as much as frequent ones.
    """
    m, n = len(patterns), len(histogram)
    if not m:
        return np.empty(0)
    used = patterns >= 0
    where = np.where(used, patterns, 0)
    weight = 1 / np.sqrt(np.maximum(histogram, 1))

    def times(x: np.ndarray) -> np.ndarray:
        each = np.repeat(x, FEW).reshape(m, FEW) * used
        return np.bincount(where.ravel(), each.ravel(), n)

    def turned(r: np.ndarray) -> np.ndarray:
        return (r[where] * used).sum(axis=1)

    # rows times columns bound the squared norm; dividing by both makes each step safe
    per_row = np.maximum(times(np.ones(m)), 1)
    scale = 1 / np.maximum(turned(weight**2 * per_row), 1e-300)
    x = np.zeros(m)
    ahead, momentum, before = x, 1.0, np.inf
    for _ in range(STEPS):
        gap = times(ahead) - histogram
        new = np.maximum(ahead - scale * turned(weight**2 * gap), 0)
        loss = float(((weight * gap) ** 2).sum())
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        if loss > before:
            following, ahead = 1.0, new
        else:
            ahead = new + (momentum - 1) / following * (new - x)
        x, momentum, before = new, following, loss
    return x


def rounded(patterns: np.ndarray, counts: np.ndarray, lengths: np.ndarray, left: np.ndarray) -> Windows:
    """Each pattern as often as its rounded count and the pieces ``left`` allow, largest counts first; takes them out."""
    found: Windows = []
    for i in np.argsort(-counts, kind="stable"):
        wanted = int(np.rint(counts[i]))
        if wanted < 1:
            break
        members, each = np.unique(patterns[i][patterns[i] >= 0], return_counts=True)
        times = min(wanted, int((left[members] // each).min()))
        if times > 0:
            left[members] -= each * times
            found.append(({int(lengths[m]): int(n) for m, n in zip(members, each)}, times))
    return found


def best_fit(windows: Windows, histogram: dict[int, int], window: int = WINDOW) -> Windows:
    """``windows`` with the pieces of ``histogram`` added, longest first, each where it leaves least room.

    Windows of one content are one entry with a count, and pieces of one length
    are placed together, so the work depends on lengths and contents alone.
    """
    rooms: dict[int, Windows] = {}
    mask = 0  # bit r is set when some window has r tokens of room
    for content, times in windows:
        room = window - sum(x * n for x, n in content.items())
        rooms.setdefault(room, []).append((content, times))
        mask |= 1 << room
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            fitting = mask >> length
            room = length + (fitting & -fitting).bit_length() - 1 if fitting else window
            if fitting:
                content, times = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    mask ^= 1 << room
            else:
                content, times = {}, -(-left // (window // length))
            each = min(room // length, left)
            filled = min(times, left // each)
            new = [({**content, length: content.get(length, 0) + each}, filled, room - each * length)]
            left -= filled * each
            if filled < times and 0 < left < each:  # one more window takes what is left of this length
                new.append(({**content, length: content.get(length, 0) + left}, 1, room - left * length))
                filled, left = filled + 1, 0
            if filled < times and content:
                new.append((content, times - filled, room))
            for what, how_often, rest in new:
                rooms.setdefault(rest, []).append((what, how_often))
                mask |= 1 << rest
    return [entry for room in sorted(rooms) for entry in rooms[room]]


def patterns(histogram: dict[int, int], window: int = WINDOW) -> Windows:
    """Windows as ``({length: count}, times)``, together exactly the histogram."""
    lengths = np.array(sorted(length for length, n in histogram.items() if n > 0), np.int64)
    left = np.array([histogram[int(length)] for length in lengths], np.int64)
    rows = enumerated(lengths, window)
    found = rounded(rows, least_squares(rows, left), lengths, left)
    return best_fit(found, {int(x): int(n) for x, n in zip(lengths, left) if n}, window)


def packed_documents(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = WINDOW
) -> DataFrame:
    """Tokenise and pack ``docs``; one row per piece with ``sequence_id, offset``.

    Ties between pieces of one length are broken by document and start, so
    reruns agree. Repeated rows, and rows without id, are each packed; other
    columns are not read; an empty table gives an empty table. ``tokenizer`` is
    a path that every worker can open.
    """
    cut = written(pieces(docs, tokenizer, key, text, window), "whole_pieces")
    return placed(cut, patterns(histogram_of(cut), window))
