from __future__ import annotations

import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from llm_texts import words
from wearmark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@given(st.dictionaries(st.integers(1, 12), st.integers(1, 4), max_size=5), st.integers(0, 40))
@settings(max_examples=150, deadline=None)
def test_fill_is_the_closest_sum(counts, capacity):
    got = packing.fill(counts, capacity)
    assert all(0 < n <= counts[x] for x, n in got.items())
    names = list(counts)
    sums = (sum(x * k for x, k in zip(names, ks)) for ks in itertools.product(*[range(counts[x] + 1) for x in names]))
    assert sum(x * n for x, n in got.items()) == max(s for s in sums if s <= capacity)


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=12))
@settings(max_examples=60, deadline=None)
def test_patterns_cover_the_histogram(histogram):
    total = Counter()
    for content, times in packing.patterns(histogram, 64):
        assert times > 0 and sum(x * n for x, n in content.items()) <= 64
        for x, n in content.items():
            total[x] += n * times
    assert total == Counter(histogram)


def test_round_trip(spark, odd_docs):
    extra = [
        (200, "It's <|endoftext|> they'll go x\x1cy z"),
        (201, "ÉCOLE ﬁ Ⅷ café " + "don't " * 50),
        *[(300 + i, words(1 + i * 37 % 900, i)) for i in range(120)],
        (500, words(9000, 77)),
    ]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    tokenizer = Tokenizer.from_file(PATH)
    want = Counter()
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        for start in range(0, len(ids), 4096):
            part = ids[start : start + 4096]
            want[r.doc_id, start, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    found = packing.packed_documents(docs, PATH).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found) == want
    windows = defaultdict(list)
    for r in found:
        windows[r.sequence_id].append((r.offset, r.length))
    assert set(windows) == set(range(len(windows)))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    short = [w for w in windows.values() if sum(n for _, n in w) < 4096]
    assert len(short) <= 1  # this many short texts leave one open window
    assert sorted(map(tuple, packing.packed_documents(docs.repartition(5), PATH).collect()), key=str) == sorted(
        map(tuple, found), key=str
    )


def test_ids_of_odd_cases_equal_the_tokenizer():
    tokenizer = Tokenizer.from_file(PATH)
    encode = packing.ChunkEncoder(PATH)
    texts = ["ΟΔΟΣ ΣΟΦΟΣ Σ", "ΛΌΓΟΣ, τέλος.", "İstanbul ǅ ẞ", "a\u0301 e\u0301", "ÅNGSTRÖM \u212b", "x\x1fy"]
    assert [np.frombuffer(b, "<u4").tolist() for b in encode(texts)] == [
        tokenizer.encode(t, add_special_tokens=False).ids for t in texts
    ]


def test_cache_is_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_BYTES", 20_000)
    encode = packing.ChunkEncoder(PATH)
    for seed in range(40):
        encode([words(60, seed)])
        assert encode.held < 20_000 + 60 * 400


def test_empty_table(no_docs):
    assert packing.packed_documents(no_docs, PATH).count() == 0


def test_missing_tokenizer_fails(odd_docs):
    with pytest.raises(Exception):
        packing.packed_documents(odd_docs, "/nowhere.json").count()
