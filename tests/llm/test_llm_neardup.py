from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from llm_texts import words
from wearmark.llm import graph, neardup


def edited(text: str, n: int, seed: int) -> str:
    rng = random.Random(seed)
    parts = text.split()
    for at in rng.sample(range(len(parts)), n):
        parts[at] = f"edit{seed}{at}"
    return " ".join(parts)


def brute_similarity(a: str, b: str, weights: np.ndarray) -> float:
    sets = []
    for text in (a, b):
        codes = neardup.shingles(text, neardup._WordHashes())
        idf = {int(c): float(weights[int(c) >> (32 - neardup.FEATURE_BITS)]) for c in codes}
        sets.append({int(c): (1 + math.log(n)) * idf[int(c)] for c, n in Counter(codes.tolist()).items()})
    low = sum(min(w, sets[1].get(c, 0.0)) for c, w in sets[0].items())
    high = sum(sets[0].values()) + sum(sets[1].values()) - low
    plain = len(sets[0].keys() & sets[1].keys()) / max(len(sets[0].keys() | sets[1].keys()), 1)
    return max(low / high, plain) if high else 1.0


def classes(links: list[tuple], items: list) -> dict:
    root = {i: i for i in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in items}


def test_classes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CHUNK", 30)  # the hot group needs several chunks
    passage = words(60, 999)
    rows, n = [], 0
    for i in range(40):  # a passage that many otherwise different documents share
        rows.append((n := n + 1, words(120, i) + " " + passage))
    base = words(300, 5000)
    for i in range(90):  # a hot group of near copies
        rows.append((n := n + 1, edited(base, i % 4, i)))
    for i in range(12):  # pairs from close to far
        text = words(200, 7000 + i)
        rows += [(n := n + 1, text), (n := n + 1, edited(text, 1 + i, i))]
    rows += [(n := n + 1, rows[3][1]), (n := n + 1, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = {r.doc_id: r for r in neardup.near_duplicates(docs).collect()}
    weights = neardup.feature_weights(neardup.shingled(docs))
    links = [
        (a, b)
        for k, (a, x) in enumerate(rows)
        for b, y in rows[:k]
        if abs(len(x) - len(y)) < 600 and brute_similarity(x, y, weights) >= neardup.SIMILAR
    ]
    want = classes(links, [i for i, _ in rows])
    assert {i: r.class_id for i, r in found.items()} == want
    sizes = Counter(want.values())
    assert all(r.class_size == sizes[r.class_id] for r in found.values())


def test_links_outside_the_capped_pass_are_found(spark, monkeypatch):
    # as in a bucket far above CHUNK: the one true partner is neither near by samples nor a leader
    monkeypatch.setattr(neardup, "CHUNK", 6)
    monkeypatch.setattr(neardup, "NEAREST", 1)
    monkeypatch.setattr(neardup, "LEADERS", 1)
    monkeypatch.setattr(neardup, "REST_BLOCK", 7)
    base = words(200, 1)
    rows = [(i, edited(base, 3 + i % 4, i)) for i in range(60)]  # similarities from 0.6 to 0.9
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    table = neardup.shingled(docs)
    weights = neardup.feature_weights(table)
    node = {r.doc_id: r.node for r in table.collect()}
    bands = {r.node: r.bands for r in neardup.sketched(table, weights).collect()}
    links = [
        (a, b)
        for k, (a, x) in enumerate(rows)
        for b, y in rows[:k]
        if any(p == q for p, q in zip(bands[node[a]], bands[node[b]]))
        and brute_similarity(x, y, weights) >= neardup.SIMILAR
    ]
    assert found == classes(links, [i for i, _ in rows])


def test_odd_documents(odd_docs, no_docs):
    found = neardup.near_duplicates(odd_docs).collect()
    assert len(found) == odd_docs.count()
    by_id = defaultdict(set)
    for r in found:
        by_id[r.doc_id].add(r.class_id)
    assert by_id[1] == by_id[2] == {1}
    assert by_id[3] == by_id[4] == by_id[5] == {3}
    kept = neardup.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 6, 7, 8, 9]
    assert neardup.near_duplicates(no_docs).count() == 0 and neardup.deduplicated(no_docs).count() == 0


def test_repeated_row_leaves_one(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")] * 3 + [(2, "g h i j k l m")], "doc_id long, text string")
    assert sorted(r.doc_id for r in neardup.deduplicated(docs).collect()) == [1, 2]


def test_repeated_id_loses_no_unique_text(spark):
    same, near, other = words(80, 1), words(80, 1).replace(" ", "  ", 1), words(70, 2)
    rows = [(1, same), (2, same), (2, other), (3, near), (None, same), (None, words(60, 3)), (None, words(60, 3)), (4, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS label", "2 AS __id", "3 AS kept")
    kept = neardup.deduplicated(docs.repartition(3))
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id or 0), r.text) for r in kept.collect()) == sorted([(0, words(60, 3)), (1, same), (2, other)])


def test_large_classes_are_joined_apart(spark):
    docs = [(i, "a b c d e f g h") for i in range(40)] + [(100 + i, words(40, i)) for i in range(30)]
    docs += [(200 + i, words(40, i)) for i in range(30)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for share in (1, 3, 1000):  # no class is hot, one is, all are
        neardup_hot, neardup.HOT_CLASSES = neardup.HOT_CLASSES, share
        try:
            found = {r.doc_id: (r.class_id, r.class_size) for r in neardup.near_duplicates(frame).collect()}
        finally:
            neardup.HOT_CLASSES = neardup_hot
        assert found == {i: (0, 40) if i < 40 else (i if i < 200 else i - 100, 2) for i, _ in docs}


def test_sampling_estimates_weighted_jaccard():
    sampler, weights = neardup.Sampler(), np.ones(1 << neardup.FEATURE_BITS, np.float32)
    errors = []
    for seed in range(12):
        text = words(400, seed)
        other = edited(text, 5 + 3 * seed, seed)
        sets = [neardup.weighted(neardup.shingles(t, neardup._WordHashes()), weights) for t in (text, other)]
        codes = [sampler.draw(k, w, np.array([0]))[0] for k, w in sets]
        errors.append((codes[0] == codes[1]).mean() - brute_similarity(text, other, weights))
    assert abs(np.mean(errors)) < 0.06 and np.abs(errors).max() < 0.3


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    edges += [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(1, 200)] + [(5, 5)]
    frame = spark.createDataFrame(edges, "u long, v long")
    found = {r.node: r.label for r in graph.components(frame).collect()}
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    assert found == classes([e for e in edges if e[0] != e[1]], nodes)
    assert graph.components(frame.filter(F.lit(False))).count() == 0
