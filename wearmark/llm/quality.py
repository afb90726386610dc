"""Quality by weak supervision: rules vote or abstain, EM learns how far to trust each of them.

Every rule looks at one measure of a text and votes good (1), bad (-1) or
abstains (0). Rules overlap on purpose: what is junk is odd in more than one
measure, so the rules can be held against each other. Texts are reduced to counts of vote patterns, of which there are
at most ``3 ** len(RULES)`` whatever the corpus size, and
expectation-maximisation over those counts estimates each rule's behaviour on
good and on bad texts. A text is kept when its posterior of being good reaches
the threshold, so one odd measure does not reject it as an all-must-pass filter
would.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from .common import lean, worker_state

# name -> (measure, good up to, bad from); a measure in between abstains
RULES: dict[str, tuple[str, float, float]] = {
    "symbols": ("symbol_rate", 0.10, 0.40),
    "shouting": ("upper_rate", 0.25, 0.60),
    "exclaiming": ("exclaim_rate", 0.10, 0.50),
    "repeated_words": ("repeat_rate", 0.20, 0.40),
    "repeated_lines": ("dup_line_rate", 0.30, 0.60),
    "long_words": ("word_length", 9.0, 14.0),
    "odd_characters": ("odd_rate", 0.15, 0.35),
    "bare_symbols": ("bare_rate", 0.08, 0.25),
}
MIN_WORDS = 50
REPEAT_PERCENT = 50
KEEP_AT = 0.5
EM_ROUNDS = 500
PRIOR_GOOD = 0.85
# Pseudo-counts of the prior belief in a rule; they keep rarely voting rules near it.
PRIOR_WEIGHT = 20.0
# Where EM starts: how often a rule that votes is right on good texts, and how often it votes bad on a
# kind of junk that it is named for and on other kinds.
START_GOOD, START_KIND, START_OTHER = 0.99, 0.99, 0.1
# A kind of junk is odd in both measures that it is named for, nearly always; what stands alone is no kind.
LEAST_KIND = 0.9
KIND_WEIGHT = 2.0  # pseudo-counts of a kind
LEAST = 1e-6  # no estimate is quite 0 or 1

# A word of ASCII marks alone.
_BARE = re.compile(rb"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0DA-Za-z0-9\x80-\xFF]+(?![^\x20\x09-\x0D])")
_SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\r\x0b\x0c"
MEASURES = {
    "n_words": pa.int64(),
    "word_chars": pa.int64(),
    "n_symbols": pa.int64(),
    "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(),
    "symbol_rate": pa.float64(),
    "upper_rate": pa.float64(),
    "exclaim_rate": pa.float64(),
    "repeat_rate": pa.float64(),
    "dup_line_rate": pa.float64(),
    "word_length": pa.float64(),
    "odd_rate": pa.float64(),
    "bare_rate": pa.float64(),
}


def _repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice in the text."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    v = len(seen)
    if v == n:
        return 0
    if v < 2_000_000:
        code = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
    else:  # the product would overflow: number the pairs first
        pair = np.unique(ids[:-1] * v + ids[1:], return_inverse=True)[1]
        code = pair[:-1] * v + ids[2:]
    order = np.sort(code)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    again = np.isin(code, np.unique(twice))
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= again
    return int(covered.sum())


def _letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: is it a letter or a mark on one, is it an upper-case letter."""
    points = 0x110000
    letters = np.fromiter((unicodedata.category(chr(i))[0] in "LM" for i in range(points)), bool, points)
    upper = np.fromiter((chr(i).isupper() for i in range(points)), bool, points)
    return letters, upper


def measure(text: str | None, tables: tuple[np.ndarray, np.ndarray]) -> tuple:
    """All measures of one whole text; null counts as empty and every rate over nothing is 0."""
    text = text or ""
    raw = text.encode()
    words = raw.split()  # on bytes: exactly the six ASCII white-space characters
    n = len(words)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    chars = len(points) - (len(raw) - len(raw.translate(None, _SPACE)))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip(_SPACE)]
    dup_lines = len(lines) - len(set(lines))
    repeats = _repeated_words(words)
    letters = int(tables[0][points].sum())
    upper = int(tables[1][points].sum())
    per_word = max(n, 1)
    return (
        n,
        chars,
        symbols,
        dup_lines,
        repeats,
        symbols / per_word,
        upper / max(letters, 1),
        raw.count(b"!") / per_word,
        repeats / per_word,
        dup_lines / max(len(lines), 1),
        chars / per_word,
        (chars - letters) / max(chars, 1),
        len(_BARE.findall(raw)) / per_word,
    )


def votes_of(measures: dict[str, float]) -> str:
    """One letter per rule: g votes good, b votes bad, - abstains."""
    found = []
    for name, good, bad in RULES.values():
        value = measures[name]
        found.append("g" if value <= good else "b" if value >= bad else "-")
    return "".join(found)


def measured(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with every measure and the vote pattern ``votes`` of each whole text.

    ``keep`` names the input columns to hand on (all by default). A null text
    counts as empty. An input column named like a measure or ``votes`` is replaced.
    """
    added = [*MEASURES, "votes"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    source = docs.select(*keep, F.col(text).alias("__text"))
    fields = StructType([f for f in source.schema.fields if f.name != "__text"])
    for name, kind in MEASURES.items():
        fields.add(name, "long" if kind == pa.int64() else "double")
    fields.add("votes", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = worker_state("letter_tables", _letter_tables)
        for batch in batches:
            rows = [measure(t.as_py(), tables) for t in batch.column("__text")]
            columns = [pa.array(list(c), kind) for c, kind in zip(zip(*rows), MEASURES.values())]
            if not rows:
                columns = [pa.array([], kind) for kind in MEASURES.values()]
            votes = pa.array([votes_of(dict(zip(MEASURES, row))) for row in rows], pa.string())
            held = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*held, *columns, votes], names=[*keep, *MEASURES, "votes"])

    return source.mapInArrow(lean(run), fields)


def fit_posteriors(patterns: list[tuple[str, int]]) -> dict[str, float]:
    """Posterior of being good for every vote pattern, from the patterns' counts.

    EM over one class of good texts and, for every two rules, one kind of junk
    that both tend to see; a kind's share, and how often each rule that votes
    votes bad in each class, are estimated (an abstention says nothing). A rule
    that often stands alone is found to err on good texts, so its lone bad vote
    does not reject; two rules that keep agreeing are a kind of junk. Pseudo-
    counts hold rarely voting rules near the start. No patterns give an empty
    answer.
    """
    if not patterns:
        return {}
    counts = np.array([n for _, n in patterns], float)
    good = np.array([[c == "g" for c in p] for p, _ in patterns], float)
    bad = np.array([[c == "b" for c in p] for p, _ in patterns], float)
    start, floor, weight, share = start_of(good.shape[1])
    rates, shares, posterior = start.copy(), share.copy(), np.zeros(len(counts))
    for _ in range(EM_ROUNDS):
        log = np.log(shares) + bad @ np.log(rates.T) + good @ np.log(1 - rates.T)
        odds = np.exp(log - log.max(axis=1, keepdims=True))
        belongs = odds / odds.sum(axis=1, keepdims=True)
        done = np.abs(belongs[:, 0] - posterior).max() < 1e-9
        posterior = belongs[:, 0]
        if done:
            break
        mass = counts[:, None] * belongs
        rates = (mass.T @ bad + weight[:, None] * start) / (mass.T @ (good + bad) + weight[:, None])
        rates = np.clip(rates, floor, 1 - LEAST)
        shares = (mass.sum(axis=0) + PRIOR_WEIGHT * share) / (counts.sum() + PRIOR_WEIGHT)
    return {p: float(x) for (p, _), x in zip(patterns, posterior)}


def start_of(rules: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, floors, pseudo-counts and shares of the classes: row 0 is good, the others kinds of junk.

    Rates are of bad votes among a rule's votes.
    """
    kinds = list(combinations(range(rules), 2)) or [(0, 0)]
    start = np.full((1 + len(kinds), rules), START_OTHER)
    floor = np.full(start.shape, LEAST)
    start[0] = 1 - START_GOOD
    for k, pair in enumerate(kinds, 1):
        start[k, list(pair)], floor[k, list(pair)] = START_KIND, LEAST_KIND
    weight = np.array([PRIOR_WEIGHT] + [KIND_WEIGHT] * len(kinds))
    share = np.array([PRIOR_GOOD] + [(1 - PRIOR_GOOD) / len(kinds)] * len(kinds))
    return start, floor, weight, share


def judged(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``measured`` with ``posterior``, ``base_failed`` and ``kept``.

    The texts are read twice: once for the counts of vote patterns, once for
    the verdicts. Only the pattern counts reach the driver, at most
    ``3 ** len(RULES)`` lines. Repeated rows each count and each get the same
    verdict; an empty table gives an empty table; texts under 50 words
    (empty and null ones too) fail the base rule.
    """
    counts = measured(docs, text, []).groupBy("votes").count()
    posteriors = fit_posteriors([(r["votes"], r["count"]) for r in counts.orderBy("votes").collect()])
    spark = docs.sparkSession
    table = spark.createDataFrame(list(posteriors.items()), "votes string, posterior double")
    base = (F.col("n_words") < MIN_WORDS) | (
        F.lit(100) * F.col("n_repeat_words") > F.lit(REPEAT_PERCENT) * F.col("n_words")
    )
    found = measured(docs, text, keep)
    found = found.drop(*[c for c in ("posterior", "base_failed", "kept") if c in found.columns])
    return (
        found.join(F.broadcast(table), "votes", "left")
        .withColumn("base_failed", base)
        .withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("posterior"), F.lit(0.0)) >= KEEP_AT))
    )


def accepted(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is kept, with the columns of ``docs``."""
    marked = docs.select(F.struct(*docs.columns).alias("__row"), F.col(text).alias("__judged"))
    return judged(marked, "__judged", ["__row"]).filter("kept").select("__row.*")
