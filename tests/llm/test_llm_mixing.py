from __future__ import annotations

import re
from collections import defaultdict

from llm_texts import words
from wearmark.llm import mixing


def filled(sizes, weights=(5, 2, 1), ceiling=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > ceiling * sizes[s]}
        if not full:
            target.update(share)
            break
        target.update({s: ceiling * sizes[s] for s in full})
        open_ -= full
    return target


def test_targets_taken_and_reruns(spark, odd_docs, no_docs):
    rows = [(i, words(1 + i * 7 % 90, i), ["big", "big", "big", "b", "é", None, "tiny"][i % 7] if i != 6 else "tiny") for i in range(3000)]
    rows = [r for r in rows if r[2] != "tiny" or r[0] < 40]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.copies(docs).collect()
    assert len(found) == len(rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in found:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert r.taken == r["size"] * r.copies and 0 <= r.copies <= 3
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    want = filled(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * max(want[s], 1)
        assert abs(taken[s] - target[s]) <= max(0.01 * target[s], 90)
    again = mixing.copies(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.copies) for r in again) == sorted((r.doc_id, r.copies) for r in found)
    mix = mixing.mixed(docs)
    assert mix.columns == docs.columns and mix.count() == sum(r.copies for r in found)


def test_texts_without_words_and_rows_without_id(spark):
    rows = [(i, words(20, i), "big") for i in range(400)] + [(1000 + i, words(10, i), "small") for i in range(9)]
    rows += [(2000 + i, ["", None, " \n"][i % 3], ["big", "small"][i % 2]) for i in range(60)]
    rows += [(None, words(15, i), "none") for i in range(300)]
    found = mixing.copies(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert all(0 <= r.copies <= (1 if r["size"] == 0 else 3) for r in found)
    ceiling = [r for r in found if r.source == "small" and r["size"]]
    assert {r.copies for r in ceiling} == {3}  # a source at its ceiling
    # rows without an id are not all on one side
    assert len({r.copies for r in found if r.doc_id is None}) == 2


def test_odd_documents(odd_docs, no_docs):
    found = mixing.copies(odd_docs).collect()
    assert len(found) == odd_docs.count()
    assert all(r.taken <= 3 * r["size"] for r in found)
    assert [r["size"] for r in found if r.doc_id == 3] == [0]
    assert mixing.mixed(odd_docs).columns == odd_docs.columns
    assert mixing.copies(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0
