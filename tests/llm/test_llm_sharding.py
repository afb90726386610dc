from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np

from llm_texts import words
from wearmark.llm import sharding


def test_balance_slots_and_groups(spark):
    texts = [words(5 + i % 60, i) for i in range(2000)]
    rows = [(i, texts[i]) for i in range(2000)] + [(5000 + i, "the hot text " * 20) for i in range(1000)]
    rows += [(9000 + i, texts[i % 50]) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = sharding.sharded(docs, shards=6).collect()
    assert len(found) == len(rows)
    by_text = dict(rows)
    bytes_, slots, homes = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in found:
        assert r["size"] == len(by_text[r.doc_id].encode()) + 8
        assert r.text_crc32 == zlib.crc32(by_text[r.doc_id].encode())
        bytes_[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        homes[by_text[r.doc_id]].add(r.shard)
    assert len(bytes_) == 6
    assert max(bytes_.values()) <= 1.03 * min(bytes_.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(homes[t]) == 1 for t in texts)  # small groups stay together
    assert len(homes["the hot text " * 20]) > 1  # a group of a third of all rows is split


def test_groups_that_fit_stay_together(spark):
    texts = [words(20 + i % 40, i) for i in range(300)]
    rows = list(enumerate(texts)) + [(1000 + i, texts[i]) for i in range(40)] + [(2000 + i, texts[50]) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bytes_, homes = defaultdict(int), defaultdict(set)
    by_text = dict(rows)
    for r in sharding.sharded(docs, shards=6).collect():
        bytes_[r.shard] += r["size"]
        homes[by_text[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in homes.values())  # pairs, and a group of half a shard
    assert max(bytes_.values()) <= 1.05 * min(bytes_.values())


def test_place_uses_all_measures():
    found = sharding.place(np.array([[10.0, 0, 1], [10, 0, 1], [0, 10, 1], [0, 10, 1]]), 2)
    assert found[0] != found[1] and found[2] != found[3]
    assert len(sharding.place(np.empty((0, 3)), 4)) == 0


def test_odd_documents(odd_docs, no_docs):
    found = sharding.sharded(odd_docs, shards=3).collect()
    assert len(found) == odd_docs.count()
    assert [(r["size"], r.text_crc32, r.tokens) for r in found if r.doc_id == 3] == [(8, 0, 0)]
    for shard in {r.shard for r in found}:
        slots = sorted(r.slot for r in found if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert sharding.sharded(no_docs).count() == 0
