"""Registered queries of the corpus operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    alignment,
    mixing,
    neardup,
    packing,
    patternpack,
    permindex,
    pseudonyms,
    quality,
    secrets,
    sharding,
    toxicity,
    urlfilter,
    whitening,
)
from .common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The registered query has no secret to keep; a user passes a key of their own.
DEMO_KEY = "demonstration key"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op7_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weakly supervised quality verdict of every document."""
    judged = quality.judged(read(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "posterior",
        "votes",
    )


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: base patterns and Markov models."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scanned(docs, secrets.train(docs))
    count = lambda kind: F.size(F.filter("secrets.base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(secrets.joined(F.col("secrets.base")), 256).alias("base_sha256"),
        secrets.joined(F.array_sort(F.concat("secrets.base", "secrets.markov"))).alias("spans"),
    )


@query
def op9_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


@query
def op8_minimum_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into pieces and packed into windows of 4096 tokens."""
    found = packing.packed_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.withColumn("length", F.col("length").cast("long"))


@query
def op4_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often every document is taken by the mix of sources."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.copies(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


@query
def op6_vector_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, balanced in bytes, tokens and rows."""
    found = sharding.sharded(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "tokens",
    )


@query
def op3_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over the documents."""
    return corpus_pipeline.run(spark, sf_dir)


@query
def op5_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every twentieth vector."""
    return permindex.neighbours(read(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(20)) == 0)


@query
def op10_trust_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    return urlfilter.judged(read(spark, sf_dir, "pages"))


@query
def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by keyed pseudonyms."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymised(docs, DEMO_KEY)


@query
def op11_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of 2048 tokens, cut only where it is longer."""
    docs = read(spark, sf_dir, "documents")
    found = patternpack.packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return found.withColumn("length", F.col("length").cast("long"))


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two tokenizers meet in every document."""
    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    found = alignment.aligned(read(spark, sf_dir, "documents"), *paths, digest=True)
    return found.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


@query
def op13_cholesky_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the four leading whitened components."""
    found = whitening.whitened(read(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))
