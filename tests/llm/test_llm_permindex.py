from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from wearmark.llm import permindex

SCHEMA = "vec_id long, embedding array<float>, rank int, score string"


def brute(ids, table, query, k):
    q = table[np.flatnonzero(ids == query)[0]]
    scores = (table * q).sum(axis=1)
    order = [i for i in np.lexsort((ids, -scores)) if ids[i] != query][:k]
    return [(int(ids[i]), float(scores[i])) for i in order]


def test_recall_scores_and_ties(spark, monkeypatch):
    monkeypatch.setattr(permindex, "INDEX_BLOCK", 1500)
    monkeypatch.setattr(permindex, "QUERY_BLOCK", 60)
    rng = np.random.default_rng(5)
    table = rng.normal(size=(3000, 24)).astype(np.float32) * rng.uniform(0.5, 2, (3000, 1)).astype(np.float32)
    table[100:400] = table[100]  # one vector in many copies
    ids = np.arange(3000)
    rows = [(int(i), [float(x) for x in v], 0, "a") for i, v in zip(ids, table)]
    rows += [(9001, None, 0, "a"), (9020, [0.0] * 24, 0, "a"), (9040, [float("nan")] * 24, 0, "a"), (9060, [1.0], 0, "a")]
    rows += [(9080, [None] + [1.0] * 23, 0, "a"), (None, [1.0] * 24, 0, "a"), rows[40], rows[40]]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = permindex.neighbours(frame, F.pmod("vec_id", F.lit(20)) == 0).collect()
    by_query = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        by_query.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(by_query) == list(range(0, 3000, 20))
    table = table.astype(np.float64)
    hits = 0
    for query, got in by_query.items():
        want = brute(ids, table, query, 20)
        assert len(got) == 20 and got == sorted(got, key=lambda x: (-x[1], x[0]))
        hits += len({i for i, _ in got} & {i for i, _ in want})
        for i, score in got:
            assert abs(score - float(table[i] @ table[query])) < 1e-9
    assert hits / (20 * len(by_query)) >= 0.95
    # of a query's own copies the smallest ids come first
    assert [i for i, _ in by_query[200]][:20] == list(range(100, 120)) or brute(ids, table, 200, 20) == by_query[200]


def test_few_and_no_vectors(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0], 0, ""), (1, [0.5, 0.5], 0, ""), (2, [1.0, 0.0], 0, "")], SCHEMA)
    found = permindex.neighbours(frame, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in found] == [(0, 1, 2, 1.0), (0, 2, 1, 0.5)]
    assert permindex.neighbours(frame.limit(0), F.lit(True)).count() == 0
    assert permindex.neighbours(frame, F.lit(False)).count() == 0
