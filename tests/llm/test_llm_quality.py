from __future__ import annotations

from collections import Counter

from wearmark.llm import quality


def brute(text):
    ws = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    covered = set()
    for i in range(len(ws) - 2):
        if windows[tuple(ws[i : i + 3])] >= 2:
            covered |= {i, i + 1, i + 2}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if line.strip(" \t\n\r\x0b\x0c"):
            dup += line in seen
            seen.add(line)
    return (
        len(ws),
        sum(map(len, ws)),
        sum(c in "#*$%&|<>" for c in text or ""),
        dup,
        len(covered),
    )


def test_base_columns_equal_brute_force(spark, odd_docs):
    texts = {(r.doc_id, r.text) for r in odd_docs.collect()}
    extra = ["a b c a b c d", "x\nx\n y \nx\n\n\n", "#*$% <>&| a", "a b a b a b", " a b c"]
    docs = spark.createDataFrame([(100 + i, t) for i, t in enumerate(extra)], "doc_id long, text string").unionByName(
        odd_docs.select("doc_id", "text")
    )
    texts |= {(100 + i, t) for i, t in enumerate(extra)}
    want = {i: brute(t) for i, t in texts}
    rows = quality.judged(docs, keep=["doc_id"]).collect()
    assert len(rows) == docs.count()
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == want[r.doc_id], r.doc_id
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def plain_em(patterns):
    """The same estimates by loops over patterns, classes and rules, a second implementation."""
    rules = range(len(patterns[0][0]))
    pairs = [(i, j) for i in rules for j in rules if i < j]
    names = ["good", *pairs]
    start = {c: [0.01 if c == "good" else 0.99 if r in c else 0.1 for r in rules] for c in names}
    floor = {c: [0.9 if c != "good" and r in c else 1e-6 for r in rules] for c in names}
    first = {c: 0.85 if c == "good" else 0.15 / len(pairs) for c in names}
    rates, shares, total = {c: list(v) for c, v in start.items()}, dict(first), sum(n for _, n in patterns)
    found = {}
    for _ in range(quality.EM_ROUNDS):
        belongs = {}
        for p, _ in patterns:
            odds = dict(shares)
            for c in names:
                for r in rules:
                    odds[c] *= {"b": rates[c][r], "g": 1 - rates[c][r], "-": 1.0}[p[r]]
            belongs[p] = {c: o / sum(odds.values()) for c, o in odds.items()}
        found = {p: belongs[p]["good"] for p, _ in patterns}
        for c in names:
            weight = 20 if c == "good" else 2
            mass = {p: n * belongs[p][c] for p, n in patterns}
            for r in rules:
                hit = sum(m for p, m in mass.items() if p[r] == "b")
                seen = sum(m for p, m in mass.items() if p[r] != "-")
                rates[c][r] = min(max((hit + weight * start[c][r]) / (seen + weight), floor[c][r]), 1 - 1e-6)
            shares[c] = (sum(mass.values()) + 20 * first[c]) / (total + 20)
    return found


def corpus(junk):
    """Pattern counts of 100,000 texts: junk of three kinds, each odd in two or three measures, and lone odd measures."""
    bad = int(100_000 * junk)
    lone = [("bggggggg", 300), ("gbgggggg", 200), ("ggggggbg", 250), ("gggbgggg", 150)]
    kinds = [("bgggggbg", bad // 3), ("gbbbgg-g", bad // 3), ("bggggggb", bad - 2 * (bad // 3))]
    rest = 100_000 - bad - sum(n for _, n in lone)
    return [("gggggggg", rest - 500), ("-ggggggg", 500), *lone, *kinds]


def test_lone_odd_measure_stays_at_any_share_of_junk():
    for junk in (0.002, 0.01, 0.05, 0.15, 0.3):
        patterns = corpus(junk)
        found = quality.fit_posteriors(patterns)
        for p, _ in patterns:
            assert (found[p] >= quality.KEEP_AT) == (p.count("b") < 2), (junk, p, found[p])


def test_em_equals_second_implementation():
    for junk in (0.05,):
        patterns = corpus(junk)
        found, want = quality.fit_posteriors(patterns), plain_em(patterns)
        assert max(abs(found[p] - want[p]) for p, _ in patterns) < 1e-6
    assert quality.fit_posteriors([]) == {}


def test_verdict_is_not_all_must_pass(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = quality.judged(docs, keep=["doc_id"]).select("votes", "posterior").collect()
    assert any("b" in r.votes and r.posterior >= quality.KEEP_AT for r in rows)
    assert any("b" in r.votes and r.posterior < quality.KEEP_AT for r in rows)


def test_quality_agrees_with_labels(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = quality.judged(docs, keep=["doc_id"]).filter("not base_failed").join(labels, "doc_id")
    counts = {(r.quality, r.kept): r["count"] for r in rows.groupBy("quality", "kept").count().collect()}
    right = counts.get((1, True), 0) + counts.get((0, False), 0)
    assert right >= 0.98 * sum(counts.values())


def test_marks_on_letters_are_not_odd():
    tables = quality._letter_tables()
    names = list(quality.MEASURES)
    for text in ("हिन्दी में लिखा हुआ पाठ", "ภาษาไทยที่เขียนถูกต้อง"):
        assert quality.measure(text, tables)[names.index("odd_rate")] < 0.05
    assert quality.measure("a | b || c", tables)[names.index("bare_rate")] == 0.4


def test_accepted_keeps_columns_and_rows(odd_docs, no_docs):
    kept = quality.accepted(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 2, 6, 7]
    assert quality.accepted(no_docs).count() == 0
