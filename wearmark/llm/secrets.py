"""Secret scanning with DataFrame functions only: fixed patterns plus two character Markov models.

Base patterns find secrets that carry a mark (an assignment, an access-key
prefix, a long hexadecimal run). Unmarked ones are found by likelihood: one
first-order Markov model describes random strings, another ordinary
identifiers, and a token is a secret when the log-likelihood ratio favours the
random one clearly. Both are trained from labelled samples: base matches and
keyed random strings in common alphabets are random, the words and identifiers
of a bounded sample of documents are ordinary.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# The patterns of the base kinds, in listed order, with the least length that counts.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_VALUE = 12

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN = r"[A-Za-z0-9+/_=-]"
MIN_TOKEN = 20  # shortest token the models judge
MIN_TRAIN_TOKEN = 6
TRAIN_ROWS = 5_000  # documents in the training sample, about
RANDOM_STRINGS = 2_000
BACKOFF = 20.0  # weight of single-character frequencies in a pair's probability
MIN_RATIO = 12.0  # log-likelihood ratio of the whole token
MIN_RATE = 0.6  # and per character
MASK = "<secret>"

_STATES = len(ALPHABET) + 1  # state 0 stands for any other character


def _positions(text: Column, pattern: str, kind: str, order: int) -> Column:
    """Spans of all leftmost non-overlapping matches, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    span = "struct<start:int,ord:int,kind:string,end:int,hit:string>"

    def step(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.length(F.get(pieces, i))
        hit = F.get(found, i)
        end = start + F.length(hit)
        one = F.struct(
            start.alias("start"),
            F.lit(order).alias("ord"),
            F.lit(kind).alias("kind"),
            end.alias("end"),
            hit.alias("hit"),
        ).cast(span)
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(one)).alias("spans"))

    none = F.array().cast(f"array<{span}>")
    walked = F.aggregate(
        F.sequence(F.lit(0), F.size(found) - 1),
        F.struct(F.lit(0).alias("at"), none.alias("spans")),
        step,
        lambda acc: acc["spans"],
    )
    return F.when(F.size(found) > 0, walked).otherwise(none)


def base_spans(text: Column) -> Column:
    """Spans of the three base kinds by start, then kind as listed."""
    value = lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 2)) >= ASSIGN_VALUE
    return F.array_sort(
        F.concat(
            F.filter(_positions(text, ASSIGN, "assign", 0), value),
            _positions(text, ACCESS, "access", 1),
            _positions(text, HEX, "hex", 2),
        )
    )


def _pairs(token: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(token) - 1), lambda i: F.substring(token, i, F.lit(2)))


def _pair_counts(tokens: DataFrame, label: str) -> DataFrame:
    """Counts of adjacent character pairs: at most the square of the alphabet."""
    long_enough = tokens.filter(F.length("token") >= 2)
    pairs = long_enough.select(F.explode(_pairs(F.col("token"))).alias("pair"))
    return pairs.groupBy("pair").count().withColumn("label", F.lit(label))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> list[float]:
    """Log-likelihood ratios random : ordinary of all character pairs, in row-major order.

    The sample is bounded: about ``rows`` documents by a hash of their key (all
    of a smaller table). Only pair counts come to the driver, at most
    ``2 * len(ALPHABET) ** 2``. An empty table leaves the keyed random strings
    against a uniform model of ordinary text.
    """
    total = docs.count()
    parts = 1 << 30
    limit = parts if total <= rows else max(1, parts * rows // total)
    sample = docs.filter(F.pmod(F.xxhash64(F.col(key)), F.lit(parts)) < limit).select(
        F.coalesce(F.col(text), F.lit("")).alias("t")
    )
    secrets = sample.select(
        F.explode(
            F.concat(
                F.transform(F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(2)), lambda x: x),
                F.regexp_extract_all("t", F.lit(ACCESS), F.lit(0)),
                F.regexp_extract_all("t", F.lit(HEX), F.lit(0)),
            )
        ).alias("token")
    ).filter(F.length("token") >= ASSIGN_VALUE)
    # lit() would be folded per row; ids make every string another one
    digest = F.sha2(F.concat(F.lit("random string "), F.col("id").cast("string")), 256)
    keyed = (
        docs.sparkSession.range(0, RANDOM_STRINGS, 1, 1)
        .select(
            F.explode(
                F.array(
                    F.substring(digest, 1, 40),
                    F.base64(F.unhex(digest)),
                    F.translate(F.base64(F.unhex(digest)), "+/=", "xQ7"),
                    F.upper(F.translate(F.base64(F.unhex(digest)), "+/=", "xQ7")),
                )
            ).alias("token")
        )
    )
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("t", ASSIGN, " "), ACCESS, " "), HEX, " ")
    ordinary = sample.select(
        F.explode(F.regexp_extract_all(plain, F.lit(TOKEN + "{%d,}" % MIN_TRAIN_TOKEN), F.lit(0))).alias("token")
    ).filter(F.length("token") < MIN_TOKEN)  # longer ones are what the models are to judge
    counted = _pair_counts(secrets.unionByName(keyed), "random").unionByName(_pair_counts(ordinary, "ordinary"))
    seen: dict[str, dict[tuple[int, int], int]] = {"random": {}, "ordinary": {}}
    for row in counted.collect():
        a, b = (ALPHABET.find(c) + 1 for c in row["pair"])
        cell = seen[row["label"]]
        cell[a, b] = cell.get((a, b), 0) + row["count"]
    logs = {}
    for label, cell in seen.items():
        # a pair not seen backs off to how frequent its second character is at all
        after, single = [0.0] * _STATES, [1.0] * _STATES
        for (a, b), n in cell.items():
            after[a] += n
            single[b] += n
        whole = sum(single)
        logs[label] = [
            math.log((cell.get((a, b), 0) + BACKOFF * single[b] / whole) / (after[a] + BACKOFF))
            for a in range(_STATES)
            for b in range(_STATES)
        ]
    return [round(r - o, 5) for r, o in zip(logs["random"], logs["ordinary"])]


def log_ratio(token: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a token; positive favours a random string."""
    # a literal text that constant folding turns into one array
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    state = lambda i: F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1)))
    return F.aggregate(
        F.sequence(F.lit(1), F.length(token) - 1),
        F.lit(0.0),
        lambda acc, i: acc + F.get(table, state(i) * _STATES + state(i + 1)),
    )


def scanned(docs: DataFrame, model: list[float], text: str = "text", out: str = "secrets") -> DataFrame:
    """``docs`` with ``out``: struct of arrays ``base`` and ``markov`` (start, ord, kind, end, hit).

    Positions count code points, the end is exclusive. A null text counts as
    empty and has no spans. Spans of the models that lie inside a base span are
    left out, base spans always stay. Repeated rows get equal spans; an input column
    named ``out`` is replaced.
    """
    kept = [c for c in docs.columns if c != out]
    whole = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    found = whole.withColumn("__base", base_spans(F.col("__text"))).withColumn(
        "__token", _positions(F.col("__text"), TOKEN + "{%d,}" % MIN_TOKEN, "markov", 3)
    )

    def random_like(s: Column) -> Column:
        ratio = log_ratio(s["hit"], model)
        return ratio >= F.greatest(F.lit(MIN_RATIO), F.length(s["hit"]) * MIN_RATE)

    def outside(s: Column) -> Column:
        return ~F.exists("__base", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"]))

    extra = F.filter(F.filter("__token", outside), random_like)
    return found.withColumn(out, F.struct(F.col("__base").alias("base"), extra.alias("markov"))).drop(
        "__text", "__base", "__token"
    )


def joined(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def masked(text: Column, spans: Column, mask: str = MASK) -> Column:
    """``text`` with every span, overlaps merged, replaced by ``mask``."""

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        fresh = s["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], before, F.lit(mask))).otherwise(acc["out"]).alias("out"),
        )

    return F.when(F.size(spans) == 0, text).otherwise(
        F.aggregate(
            spans,
            F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
            step,
            lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
        )
    )


def redacted(docs: DataFrame, text: str = "text", chars: str | None = "n_chars", key: str = "doc_id") -> DataFrame:
    """``docs`` with all secrets masked in ``text`` and ``chars`` (if present) counted anew; a null text stays null."""
    found = scanned(docs, train(docs, key, text), text, "__secrets")
    spans = F.array_sort(F.concat("__secrets.base", "__secrets.markov"))
    clean = F.when(F.size(spans) == 0, F.col(text)).otherwise(masked(F.col(text), spans))
    out = found.withColumn(text, clean)
    if chars in docs.columns:
        kind = docs.schema[chars].dataType
        dirty = F.size("__secrets.base") + F.size("__secrets.markov") > 0
        out = out.withColumn(chars, F.when(dirty, F.length(text)).otherwise(F.col(chars)).cast(kind))
    return out.select(*docs.columns)
