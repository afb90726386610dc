from __future__ import annotations

import datetime
import hashlib
import re

from pyspark.sql import functions as F

from wearmark.llm import pseudonyms


def one(spark, *texts, key="k"):
    frame = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, n_replaced string")
    rows = pseudonyms.pseudonymised(frame, key).orderBy("doc_id").collect()
    assert len(rows) == len(texts)
    return [(r.text, r.n_replaced) for r in rows]


def luhn(text):
    digits = [int(c) for c in re.sub(r"\D", "", text)][::-1]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def iban_valid(text):
    t = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


SHAPES = {
    "4539 1488 0343 6467": r"\d{4} \d{4} \d{4} \d{4}",
    "4485275742308327": r"\d{16}",
    "GB82 WEST 1234 5698 7654 32": r"GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d{2}",
    "jane.Doe77@mail.example.org": r"[a-z]{4}\.[A-Z][a-z]{2}\d\d@mail\.example\.org",
    "+1 (459) 555-7415": r"\+1 \(\d{3}\) \d{3}-\d{4}",
    "192.168.10.250": r"\d+\.\d+\.\d+\.\d+",
    "2024-02-29": r"\d{4}-\d\d-\d\d",
    "31/12/1999": r"\d\d/\d\d/\d{4}",
    "123-45-6789": r"\d{3}-\d{2}-\d{4}",
}


def test_formats_stay_and_values_link(spark):
    texts = [f"before {v} after; again {v}." for v in SHAPES]
    for (text, n), (value, shape) in zip(one(spark, *texts), SHAPES.items()):
        m = re.fullmatch(rf"before ({shape}) after; again ({shape})\.", text)
        assert m, (value, text)
        assert n == 2 and m[1] == m[2] != value
        if value[:2] in ("44", "45"):
            assert luhn(m[1])
        if value.startswith("GB"):
            assert iban_valid(m[1])
        if value == "2024-02-29":
            datetime.date.fromisoformat(m[1])
        if value == "192.168.10.250":
            assert all(int(x) < 256 for x in m[1].split("."))
    other = one(spark, *texts, key="other")
    assert all(a != b for a, b in zip(other, one(spark, *texts)))


def test_invalid_and_plain_texts_stay(spark):
    texts = ["4539148803436468 no card", "999.1.1.1", "2023-02-30 and 1899-12-31", "000-12-3456", "v1.2.3 at 12:30, $5", "", None, "é 😀"]
    assert one(spark, *texts) == [(t, 0) for t in texts]


def test_permutations_are_one_to_one(spark):
    days = spark.range(pseudonyms.DAYS).select(
        F.date_format(F.date_add(F.lit(pseudonyms.FIRST_DAY).cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("v")
    )
    assert days.select(pseudonyms.date(F.col("v"), "k").alias("p")).distinct().count() == pseudonyms.DAYS
    numbers = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("v"))
    moved = numbers.select(pseudonyms.permuted(F.col("v"), F.lit("ddd"), "k", "x").alias("p"))
    assert moved.distinct().count() == 1000
    ips = spark.range(5000).select(F.concat_ws(".", F.lit("10.7"), F.floor(F.col("id") / 256).cast("string"), F.pmod("id", F.lit(256)).cast("string")).alias("v"))
    assert ips.select(pseudonyms.ip(F.col("v"), "k").alias("p")).distinct().count() == 5000


SPELLINGS = [
    ["4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111"],
    ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000"],
    ["415-555-2671", "(415) 555-2671", "+1 415.555.2671", "+14155552671"],
    ["31/12/1999", "12/31/1999", "1999-12-31", "31.12.1999"],
]


def test_spellings_of_one_value_stay_linked(spark):
    for spellings in SPELLINGS[:3]:
        found = [re.sub(r"[^0-9A-Z]", "", t) for t, n in one(spark, *spellings) if n == 1]
        assert len(found) == len(spellings)
        assert len({f[-10:] for f in found}) == 1 and found[0] != re.sub(r"\W", "", spellings[0])
    days = [t for t, n in one(spark, *SPELLINGS[3])]
    forms = ["%d/%m/%Y", "%m/%d/%Y", "%Y-%m-%d", "%d.%m.%Y"]
    assert len({datetime.datetime.strptime(t, f) for t, f in zip(days, forms)}) == 1
    abroad = one(spark, "+442071838750", "+332071838750")
    assert abroad[0][0][:3] == "+44" and abroad[1][0][:3] == "+33" and abroad[0][0][3:] != abroad[1][0][3:]


def test_numbers_followed_by_others_are_found(spark):
    texts = {
        "4111 1111 1111 1111 12/27": r"(?!4111)\d{4} \d{4} \d{4} \d{4} 12/27",
        "4111 1111 1111 1111 123": r"(?!4111)\d{4} \d{4} \d{4} \d{4} 123",
        "DE89 3704 0044 0532 0130 00 BIC COBADEFF": r"DE(?!89 3704)\d\d \d{4} \d{4} \d{4} \d{4} \d\d BIC COBADEFF",
        "GB29 NWBK 6016 1331 9268 19 EUR 500": r"GB(?!29 NWBK)\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d EUR 500",
    }
    for (text, n), shape in zip(one(spark, *texts), texts.values()):
        assert n == 1 and re.fullmatch(shape, text), text


def test_hostile_texts_end(spark):
    """Texts of up to a megabyte that repeat what a pattern repeats neither crash nor stay unanswered."""
    many = ["a@b" + ".c" * 500_000, "1 " * 5_000, "AB12 " * 5_000, "a." * 500_000, "1." * 500_000, "+" * 1_000_000]
    found = one(spark, *many)
    assert [len(t) for t, _ in found] == [len(t) for t in many]


def test_ssn_stays_valid_and_one_to_one(spark):
    numbers = spark.range(3000).select(F.concat(F.lit("12"), (F.col("id") % 10).cast("string"), F.lit("-"), F.lpad((F.col("id") / 10 % 99 + 1).cast("int").cast("string"), 2, "0"), F.lit("-"), F.lpad((F.col("id") + 1).cast("string"), 4, "0")).alias("v")).distinct()
    rows = numbers.select("v", pseudonyms.ssn(F.col("v"), "k").alias("p")).collect()
    assert len({r.p for r in rows}) == len(rows)
    assert not [r.p for r in rows if re.search(r"^(?:000|666|9)|-00-|-0000$", r.p)]


def plain_permuted(text, template, key, kind):
    """The network in plain Python, a second implementation."""
    sets = {"d": "0123456789", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "a": "abcdefghijklmnopqrstuvwxyz"}
    for r in range(pseudonyms.ROUNDS):
        others = "".join(c for i, c in enumerate(text, 1) if (i + r) % 2 == 0)
        stream = hashlib.sha512("|".join([key, kind, str(r), template, others]).encode()).hexdigest()
        out = []
        for i, (c, t) in enumerate(zip(text, template), 1):
            if (i + r) % 2 == 1 and t in sets:
                at = i * 6 % 120
                c = sets[t][(sets[t].index(c) + int(stream[at : at + 6], 16)) % len(sets[t])]
            out.append(c)
        text = "".join(out)
    return text


def plain_inverse(text, template, key, kind):
    sets = {"d": "0123456789", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "a": "abcdefghijklmnopqrstuvwxyz"}
    for r in reversed(range(pseudonyms.ROUNDS)):
        others = "".join(c for i, c in enumerate(text, 1) if (i + r) % 2 == 0)
        stream = hashlib.sha512("|".join([key, kind, str(r), template, others]).encode()).hexdigest()
        out = []
        for i, (c, t) in enumerate(zip(text, template), 1):
            if (i + r) % 2 == 1 and t in sets:
                at = i * 6 % 120
                c = sets[t][(sets[t].index(c) - int(stream[at : at + 6], 16)) % len(sets[t])]
            out.append(c)
        text = "".join(out)
    return text


def test_network_equals_plain_python_and_is_undone(spark):
    values = [("4111111111111110", "d" * 15 + "x"), ("WEST12345698765432", "AAAA" + "d" * 14), ("jane.Doe77", "aaaa.Aaadd"), ("7", "d")]
    frame = spark.createDataFrame(values, "v string, t string")
    for r in frame.select("v", "t", pseudonyms.permuted(F.col("v"), F.col("t"), "k", "x").alias("p")).collect():
        assert r.p == plain_permuted(r.v, r.t, "k", "x")
        assert plain_inverse(r.p, r.t, "k", "x") == r.v


def test_odd_documents(odd_docs, no_docs):
    out = pseudonyms.pseudonymised(odd_docs, "k")
    assert out.count() == odd_docs.count() and set(odd_docs.columns) < set(out.columns)
    assert pseudonyms.pseudonymised(no_docs, "k").count() == 0
