from __future__ import annotations

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from llm_texts import words
from wearmark.llm import alignment, bytebpe, common

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

ODD = [
    "▁ a mark of its own",
    "names <|endoftext|> and <s> are plain </s> text <unk> <0x41>",
    "tab\tand\r\nline\n\n\n  many   spaces   ",
    " leading, 1234567 and 12,345.67; ünïcödé ſ ﬁ Ⅷ 漢字仮名 한국어 ไทย हिन्दी",
    "\x00\x01\x7f​ ﻿ é 👩‍👩‍👧 \U0010ffff",
    "a",
    " ",
    "\n",
    "don't we'll they've",
]


@pytest.fixture(scope="module")
def docs(spark, odd_docs):
    extra = [(100 + i, t) for i, t in enumerate(ODD)] + [(200 + i, words(1 + 13 * i, i)) for i in range(40)]
    return odd_docs.select("doc_id", "text", "votes").unionByName(
        spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True
    )


def brute(texts):
    """Per text: token counts, links as id pairs in order, groups; token by token."""
    byte, piece = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    byte.encode_special_tokens = True
    back = {letter: i for i, letter in enumerate(common.byte_letters())}
    out = []
    for text in texts:
        whole = b" " + (text or "").encode()
        a = [(i, bytes(back[c] for c in byte.id_to_token(i))) for i in byte.encode(" " + (text or ""), add_special_tokens=False).ids]
        b = []
        for i in piece.encode(text or ""):
            shown = piece.id_to_piece(i)
            b.append((i, bytes([int(shown[3:5], 16)]) if piece.is_byte(i) else shown.replace("▁", " ").encode()))
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            out.append((0, 0, [], ""))
            continue
        spans = []
        for side in (a, b):
            at, found = 0, []
            for i, x in side:
                found.append((at, at + len(x), i))
                at += len(x)
            spans.append(found)
        if len(whole) < 3000:
            links = [(i, j) for s, e, i in spans[0] for t, f, j in spans[1] if s < f and t < e]
        else:  # the same by walking both sides
            links, x, y = [], 0, 0
            while x < len(spans[0]):
                links.append((spans[0][x][2], spans[1][y][2]))
                e, f = spans[0][x][1], spans[1][y][1]
                x, y = x + (e <= f), y + (f <= e)
        cuts = {e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]}
        runs = []
        for side in spans:
            found = [[]]
            for _, e, i in side:
                found[-1].append(str(i))
                if e in cuts:
                    found.append([])
            runs.append([",".join(run) for run in found[:-1]])
        groups = ["|".join(pair) for pair in zip(*runs)]
        out.append((len(a), len(b), links, ";".join(groups)))
    return out


def expected(rows):
    found = brute([r.text for r in rows])
    counts = Counter(pair for _, _, links, _ in found for pair in links)
    top = Counter()
    for (_, j), n in counts.items():
        top[j] = max(top[j], n)
    return Counter(
        (
            r.doc_id,
            n_a,
            n_b,
            groups.count(";") + 1 if groups else 0,
            len(links),
            sum(counts[p] == top[p[1]] for p in links),
            sum(counts[p] for p in links),
            hashlib.sha256(groups.encode()).hexdigest() if groups else "",
        )
        for r, (n_a, n_b, links, groups) in zip(rows, found)
    )


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_equals_brute_force(docs):
    want = expected(docs.collect())
    found = alignment.aligned(docs.repartition(4), A, B, digest=True)
    assert Counter(map(tuple, found.select(COLUMNS).collect())) == want
    # the odd texts are not all without tokens
    assert sum(n for line, n in want.items() if line[0] and 100 <= line[0] < 200 and line[1]) >= 6


def test_many_pairs_are_not_broadcast(docs):
    lines = alignment.linked(docs, A, B).selectExpr("*", "monotonically_increasing_id() AS row")
    lines = common.written(lines, "lines")
    totals = common.written(alignment.pair_counts(lines), "totals")
    few, many = (alignment.with_counts(lines, totals, rows) for rows in (10**6, 10))
    assert Counter(map(tuple, few.drop("groups").collect())) == Counter(map(tuple, many.drop("groups").collect()))
    assert totals.filter("count > 20").count() > 10


def test_groups_are_given_as_text(docs):
    rows = docs.filter("doc_id between 100 and 210").collect()
    found = {r.doc_id: r.groups for r in alignment.aligned(docs.filter("doc_id between 100 and 210"), A, B).collect()}
    assert found == {r.doc_id: groups for r, (_, _, _, groups) in zip(rows, brute([r.text for r in rows]))}


def test_counts_in_pieces(docs, monkeypatch):
    lines = common.written(alignment.linked(docs, A, B).select("pairs"), "lines")
    whole = Counter(map(tuple, alignment.pair_counts(lines).collect()))
    monkeypatch.setattr(alignment, "PAIRS_HELD", 5)
    assert Counter(map(tuple, alignment.pair_counts(lines).collect())) == whole


def test_empty_table(no_docs):
    assert alignment.aligned(no_docs, A, B, digest=True).count() == 0


def test_slices_cover_all_rows():
    size = alignment.TEXT_BYTES
    for sizes in ([], [0], [size + 1, 0, 5], [size // 2] * 5, [3] * 10, [size * 3, size * 3]):
        parts = list(alignment._slices(sizes))
        assert [i for low, high in parts for i in range(low, high)] == list(range(len(sizes)))


def test_byte_encoder_equals_the_tokenizer():
    texts = [*ODD, *(words(50, i) for i in range(20)), "x" * 5000, "<|endoftext|>" * 3]
    whole, plain = Tokenizer.from_file(A), Tokenizer.from_file(A)
    plain.encode_special_tokens = True
    for text in texts:
        assert bytebpe.byte_encoder(A)(text).tolist() == whole.encode(text, add_special_tokens=False).ids
        assert bytebpe.byte_encoder(A, plain=True)(text).tolist() == plain.encode(text, add_special_tokens=False).ids
