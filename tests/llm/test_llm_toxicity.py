from __future__ import annotations

import zlib

from llm_texts import words
from wearmark.llm import toxicity


def test_fold_sees_through_disguises():
    fold = toxicity.Fold()
    assert toxicity.folded_words("ІDІ0T! stüp1d $cum", fold) == ["idiot", "stupid", "scum"]
    assert toxicity.folded_words(None, fold) == []


def test_exceptions_and_length():
    fold = toxicity.Fold()
    machine = toxicity.automaton_of({" trash ": 4.0, " idio": 5.0}, ("trash can",), fold)
    assert toxicity.density("the trash can is full", machine, fold) == (0.0, 0)
    short, long_ = (toxicity.density("idiot " + "calm " * n, machine, fold)[0] for n in (5, 5000))
    assert short > long_ > 0
    assert toxicity.density("", machine, fold) == (0.0, 0)


def test_learned_scores_hold_out(spark, odd_docs, no_docs):
    rows, labels = [], []
    for i in range(400):
        bad = i % 8 == 0
        rows.append((i, words(40 + i % 30, i) + (" you b0zo nitwits" if bad else ""), "x"))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels + [(0, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    found = toxicity.scored(docs, marks).collect()
    assert len(found) == 400
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) == int(r.doc_id % 8 == 0)
    odd = toxicity.scored(odd_docs, marks).collect()
    assert len(odd) == odd_docs.count() and not any(r.predicted for r in odd)
    assert toxicity.scored(no_docs, marks).count() == 0
    nothing = toxicity.scored(docs, marks.limit(0)).collect()
    assert len(nothing) == 400 and len({r.score for r in nothing}) == 1
