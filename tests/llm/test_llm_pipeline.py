from __future__ import annotations

from collections import Counter, defaultdict

import corpus_pipeline
from wearmark.llm import mixing, neardup, packing, quality, queries, secrets
from wearmark.llm.common import read, written

SF = "/root/testdata/sf0.001"


def test_stages_follow_from_their_operators(spark):
    docs = read(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, before, SF), "stage")
        if name != "packing":
            assert docs.columns == columns
        rows, earlier = docs.collect(), before.collect()
        if name == "quality rules":
            kept = {r.doc_id for r in quality.judged(before, keep=["doc_id"]).filter("kept").collect()}
            assert {r.doc_id for r in rows} == kept and 0 < len(rows) < len(earlier)
        if name == "near dedup":
            found = neardup.near_duplicates(before).collect()
            assert {r.doc_id for r in rows} == {r.class_id for r in found} and len(rows) == len({r.class_id for r in found})
        if name == "secret scan":
            spans = secrets.scanned(docs, secrets.train(before))
            assert spans.filter("size(secrets.base) > 0").count() == 0
            assert len(rows) == len(earlier) and all(r.n_chars == len(r.text) for r in rows)
        if name == "source mix":
            want = Counter({r.doc_id: r.copies for r in mixing.copies(before).collect()})
            assert Counter(r.doc_id for r in rows) == +want
        if name == "packing":
            pieces = defaultdict(int)
            for r in rows:
                pieces[r.doc_id] += r.length
            tokens = {r.doc_id: r.doc_tokens for r in rows}
            times = Counter(r.doc_id for r in earlier)
            assert {i: tokens[i] * n for i, n in times.items()} == dict(pieces)


def test_run_equals_stages(spark):
    first = corpus_pipeline.run(spark, SF)
    assert first.columns[-2:] == ["sequence_id", "offset"]
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, queries.QUERIES["pipeline"](spark, SF).collect()))


def test_odd_and_empty_documents(spark, odd_docs, no_docs):
    for start in (odd_docs.select(no_docs.columns), no_docs):
        docs = start
        for _, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, SF), "stage")
        assert docs.count() >= 0


def test_tokens_are_whole(spark):
    assert packing.WINDOW == 4096 and packing.END_ID == 2
    assert set(queries.ORACLES) <= set(queries.QUERIES)
    numbers = {n.split("_")[0] for n in queries.QUERIES}
    assert {f"op{i}" for i in range(1, 11)} <= numbers
