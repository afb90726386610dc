from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from llm_texts import words
from wearmark.llm import patternpack

PATH = public_tokenizers.path("byte_bpe_50k.json")
HISTOGRAMS = st.dictionaries(st.integers(1, 64), st.integers(1, 400), max_size=16)


def total(windows, window):
    found = Counter()
    for content, times in windows:
        assert times > 0 and 0 < sum(x * n for x, n in content.items()) <= window
        for x, n in content.items():
            found[x] += n * times
    return found


@given(HISTOGRAMS)
@settings(max_examples=80, deadline=None)
def test_windows_hold_exactly_the_histogram(histogram):
    assert total(patternpack.patterns(histogram, 64), 64) == Counter(histogram)
    assert total(patternpack.best_fit([], histogram, 64), 64) == Counter(histogram)


def plain_best_fit(histogram, window):
    """Windows used by best fit decreasing, piece by piece."""
    rooms = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fitting = [r for r in rooms if r >= length]
            if fitting:
                rooms.remove(min(fitting))
            rooms.append((min(fitting) if fitting else window) - length)
    return len(rooms)


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 12), max_size=10))
@settings(max_examples=80, deadline=None)
def test_best_fit_in_groups_equals_piece_by_piece(histogram):
    assert sum(n for _, n in patternpack.best_fit([], histogram, 64)) == plain_best_fit(histogram, 64)


def test_patterns_fill_windows():
    lengths = np.array([3, 10, 31, 32, 33, 64])
    rows = patternpack.enumerated(lengths, 64)
    contents = {tuple(sorted(int(lengths[i]) for i in row if i >= 0)) for row in rows}
    assert {(64,), (32, 32), (31, 33)} <= contents
    assert all(64 - 64 * patternpack.SLACK <= sum(c) <= 64 and len(c) <= patternpack.FEW for c in contents)
    assert len(contents) == len(rows)


def test_least_squares_meets_its_optimum():
    rng = np.random.default_rng(2)
    lengths = np.arange(1, 65)
    rows = patternpack.enumerated(lengths, 64)
    histogram = np.zeros(64, np.int64)
    for i in rng.integers(0, len(rows), 60):
        for j in rows[i][rows[i] >= 0]:
            histogram[j] += 100
    x = patternpack.least_squares(rows, histogram)
    assert (x >= 0).all()
    made = np.zeros(64)
    for row, count in zip(rows, x):
        np.add.at(made, row[row >= 0], count)
    # an exact answer exists, so little of the histogram may be left over
    assert np.abs(made - histogram).sum() < 0.02 * histogram.sum()
    left = histogram.copy()
    found = patternpack.rounded(rows, x, lengths, left)
    assert (left >= 0).all() and sum(t for _, t in found) * 64 > 0.9 * (lengths * histogram).sum()


def test_few_windows():
    rng = np.random.default_rng(4)
    sizes, n = np.unique(np.clip(np.exp(rng.normal(5.7, 1, 20_000)).astype(int), 1, 2048), return_counts=True)
    histogram = dict(zip(sizes.tolist(), n.tolist()))
    used = sum(n for _, n in patternpack.patterns(histogram))
    least = -(-sum(x * n for x, n in histogram.items()) // 2048)
    assert used <= least * 1.001 + 1
    assert used <= sum(n for _, n in patternpack.best_fit([], histogram)) + 1


@pytest.mark.parametrize("ids", [1, 2047, 2048, 2049, 4096, 4097, 10_000])
def test_cuts(ids):
    parts = list(patternpack.cuts(ids))
    assert [s for s, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
    assert sum(n for _, n in parts) == ids and all(n == 2048 for _, n in parts[1:]) and 0 < parts[0][1] <= 2048


def test_round_trip(spark, odd_docs):
    extra = [
        (200, "It's <|endoftext|> they'll go x\x1cy z"),
        *[(300 + i, words(1 + i * 37 % 700, i)) for i in range(150)],
        *[(None, words(90, 5))] * 40,
        (500, words(9000, 77)),
    ]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    docs = docs.selectExpr("*", "1 AS piece", "'x' AS length")
    tokenizer = Tokenizer.from_file(PATH)
    want = Counter()
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        for number, (start, n) in enumerate(patternpack.cuts(len(ids))):
            want[r.doc_id, number, start, n, zlib.crc32(ids[start : start + n].tobytes())] += 1
    found = patternpack.packed_documents(docs, PATH).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    windows = defaultdict(list)
    for r in found:
        windows[r.sequence_id].append((r.offset, r.length))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(windows) <= -(-sum(r.length for r in found) // 2048) + 1
    again = patternpack.packed_documents(docs.repartition(5), PATH).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, found), key=str)


def test_empty_table(no_docs):
    assert patternpack.packed_documents(no_docs, PATH).count() == 0
