"""Toxicity by a weighted lexicon, matched after folding disguises.

The lexicon is learned from labelled documents: folded words and word stems get
the log odds of standing in a toxic against a clean document. All entries are
matched in one Aho-Corasick pass per text, exception phrases cancel the entries
inside them, and the summed weight, normalised by the length of the text, is
calibrated to a probability.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import text_or_empty, written

TRAIN_ROWS = 20_000  # labelled documents that the lexicon and the calibration are fitted on, at most about
LEXICON = 20_000  # entries at most
MIN_TOXIC = 3  # toxic training documents an entry stands in
MIN_WEIGHTS = (5.0, 4.0, 3.0)  # least log odds of an entry; the best for the sample is chosen on a part kept apart
STEMS = range(4, 8)  # lengths of word stems
HELD_OUT = 5  # one label in so many is never learned from
NORM_WORDS = 100
RIDGE = 1e-3

# Look-alike letters and digit substitutions, folded to one Latin letter each.
LOOK_ALIKES = dict(
    zip(
        "аеорсухіјѕԁһӏґвнкмтαεοριυνκτβηχγ" + "013457@$l",
        "aeopcyxijsdhirbhkmtaeopiuvktbnxy" + "oieastasi",
        strict=True,
    )
)
# Phrases in which a lexicon word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "circus clown")


class Fold(dict):
    """Translation of code points for ``str.translate``, filled on demand.

    A letter loses case and marks and look-alikes become one letter; everything
    that is no letter becomes a space.
    """

    def __missing__(self, point: int) -> str:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(point)) if not unicodedata.combining(c))
        plain = "".join(LOOK_ALIKES.get(c, c) for c in plain.casefold())
        out = plain if plain.isalpha() else ("" if not plain else " ")
        self[point] = out
        return out


def folded_words(text: str | None, fold: Fold) -> list[str]:
    return (text or "").translate(fold).split()


def entries_of(words: set[str]) -> set[str]:
    """Lexicon entries in a set of words: `` word `` for a whole word, `` stem`` for its beginnings."""
    found = set()
    for word in words:
        found.add(f" {word} ")
        found.update(f" {word[:n]}" for n in STEMS if n < len(word))
    return found


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``text, toxic, apart`` of the training documents: labelled, not held out, a bounded hash sample.

    ``apart`` marks a quarter that chooses the least weight and the calibration.

    Labels that are null are no labels. The sample keeps about ``rows`` labels, all of a smaller table.
    """
    own = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).filter(
        F.col("toxic").isin(0, 1) & F.col("_id").isNotNull()
    )
    own = own.filter(~held_out(F.col("_id")))
    total, parts = own.count(), 1 << 30
    limit = parts if total <= rows else max(1, parts * rows // total)
    # about `rows` lines by construction, so the broadcast is bounded
    kept = own.filter(F.pmod(F.xxhash64("_id"), F.lit(parts)) < limit)
    apart = (F.pmod(F.crc32(F.col("_id").cast("string")), F.lit(HELD_OUT)) == 1).alias("apart")
    return docs.join(F.broadcast(kept), F.col("doc_id") == F.col("_id")).select(
        text_or_empty().alias("text"), "toxic", apart
    )


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(HELD_OUT)) == 0, F.lit(False))


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Entry -> log odds of toxic against clean documents; empty when a class is missing."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = Fold()
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column("text"), batch.column("toxic")):
                for entry in entries_of(set(folded_words(text.as_py(), fold))):
                    seen.setdefault(entry, [0, 0])[toxic.as_py()] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(seen), pa.string()),
                    pa.array([n[0] for n in seen.values()], pa.int64()),
                    pa.array([n[1] for n in seen.values()], pa.int64()),
                ],
                names=["entry", "clean", "toxic"],
            )

    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return {}
    counts = sample.select("text", "toxic").mapInArrow(count, "entry string, clean bigint, toxic bigint")
    odds = F.log((F.col("toxic") + 0.5) / (sizes[1] + 1.0)) - F.log((F.col("clean") + 0.5) / (sizes[0] + 1.0))
    summed = written(
        counts.groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "lexicon_counts"
    )
    # by chance one entry of all would stand in toxic documents this often (the binomial tail's exponent)
    base = sizes[1] / (sizes[0] + sizes[1])
    n, share = F.col("clean") + F.col("toxic"), F.col("toxic") / (F.col("clean") + F.col("toxic"))
    rest = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    surprise = n * (share * F.log(share / base) + rest)
    tried = max(summed.count(), 1)
    top = (
        summed.filter(F.col("toxic") >= MIN_TOXIC)
        .withColumn("weight", odds)
        .filter((F.col("weight") >= min(MIN_WEIGHTS)) & (surprise >= math.log(tried)))
        .orderBy(F.desc(F.col("weight") * F.col("toxic")), "entry")
        .limit(LEXICON)
    )
    return {r["entry"]: r["weight"] for r in top.collect()}


def automaton_of(lexicon: dict[str, float], exceptions: Sequence[str], fold: Fold) -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for entry, weight in lexicon.items():
        machine.add_word(entry, (entry, weight))
    for phrase in exceptions:
        entry = f" {' '.join(folded_words(phrase, fold))} "
        machine.add_word(entry, (entry, None))
    if len(machine):
        machine.make_automaton()
    return machine


def density(text: str | None, machine: ahocorasick.Automaton, fold: Fold) -> tuple[float, int]:
    """Summed weight over the log-normalised length, and the number of entries that count.

    At each word the heaviest entry counts, and an entry counts once per text, so
    repeating a word adds nothing; words inside an exception phrase do not
    count. An empty text has density 0.
    """
    words = folded_words(text, fold)
    if not words or not len(machine):
        return 0.0, 0
    best: dict[int, tuple[float, str]] = {}
    spared: list[tuple[int, int]] = []
    for end, (entry, weight) in machine.iter(f" {' '.join(words)} "):
        start = end - len(entry) + 1
        if weight is None:
            spared.append((start, end))
        elif start not in best or weight > best[start][0]:
            best[start] = (weight, entry)
    for low, high in spared:
        for start in [s for s in best if low <= s < high]:
            del best[start]
    found = set(best.values())
    return sum(weight for weight, _ in sorted(found)) / (1 + math.log1p(len(words) / NORM_WORDS)), len(found)


def calibrated(pairs: list[tuple[float, int]]) -> tuple[float, float]:
    """Slope and offset of a ridge logistic regression of the label on the density, by Newton steps."""
    if not pairs:
        return 1.0, -1.0
    x, y = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs], float)
    design = np.stack([x, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    penalty = np.diag([RIDGE, RIDGE]) * len(x)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + penalty
        step = np.linalg.solve(hessian, design.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def densities(docs: DataFrame, lexicon: dict[str, float], keep: list[str], exceptions: Sequence[str] = EXCEPTIONS) -> DataFrame:
    """``keep`` columns with ``density`` and ``n_hits`` of ``text``."""
    source = docs.select(*keep, text_or_empty().alias("__text"))
    schema = source.select(*keep).schema.add("density", "double").add("n_hits", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = Fold()
        machine = automaton_of(lexicon, exceptions, fold)
        for batch in batches:
            found = [density(t.as_py(), machine, fold) for t in batch.column("__text")]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in keep],
                    pa.array([f[0] for f in found], pa.float64()),
                    pa.array([f[1] for f in found], pa.int64()),
                ],
                names=[*keep, "density", "n_hits"],
            )

    return source.mapInArrow(run, schema)


def _loss(pairs: list[tuple[float, int]], slope: float, offset: float) -> float:
    """Mean logistic loss."""
    x, y = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs], float)
    z = np.clip(slope * x + offset, -30, 30)
    return float(np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y)))


def fitted(sample: DataFrame, exceptions: Sequence[str] = EXCEPTIONS) -> tuple[dict[str, float], float, float]:
    """Lexicon, slope and offset from ``labelled_sample``.

    A lexicon of the larger part is judged on the part kept apart, which gives
    the least weight and the calibration; the final lexicon then learns from
    both parts. The densities collected for that are a bounded sample's.
    """
    trial = learn_lexicon(sample.filter("not apart"))
    best = None
    for least in MIN_WEIGHTS:
        part = {e: w for e, w in trial.items() if w >= least}
        found = densities(sample.filter("apart"), part, ["toxic"], exceptions).collect()
        pairs = [(r["density"], r["toxic"]) for r in found]
        if len({y for _, y in pairs}) < 2:
            break
        slope, offset = calibrated(pairs)
        loss = _loss(pairs, slope, offset)
        if best is None or loss < best[0]:
            best = (loss, least, slope, offset)
    lexicon = learn_lexicon(sample)
    if best is None:  # one class only in the part kept apart, or nothing learned
        pairs = [(r["density"], r["toxic"]) for r in densities(sample, lexicon, ["toxic"], exceptions).collect()]
        return (lexicon, *calibrated(pairs if lexicon else []))
    _, least, slope, offset = best
    return {e: w for e, w in lexicon.items() if w >= least}, slope, offset


def scored(docs: DataFrame, labels: DataFrame, exceptions: Sequence[str] = EXCEPTIONS) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_hits`` of every row of ``docs(doc_id, text, ...)``.

    Labels join only the training sample; a score depends on the text alone. A
    null text counts as empty and scores as a text without hits. Without labels
    of both classes nothing is learned and every score is the same low one.
    """
    sample = written(labelled_sample(docs, labels), "toxic_sample")
    lexicon, slope, offset = fitted(sample, exceptions)
    score = 1 / (1 + F.exp(-(F.col("density") * slope + offset)))
    found = densities(docs.select("doc_id", "text"), lexicon, ["doc_id"], exceptions).withColumn("score", score)
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_hits",
    )
