"""Manifest and split files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

MANIFEST_SCHEMA = (
    "unit_id long, full_lifetime int, cutoff_cycle int, true_raw_rul int, fraction double"
)
SPLIT_ROLES = ("train", "validation", "calibration", "development")


def write_manifest(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    df.select("unit_id", "full_lifetime", "cutoff_cycle", "true_raw_rul", "fraction").write.mode(mode).csv(
        path, header=True
    )
    return path


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).csv(path, header=True)


def write_split(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Assignment table ``(unit_id, role[, fold])`` as Parquet, one folder per role."""
    df.write.mode(mode).partitionBy("role").parquet(path)
    return path


def _require_disjoint(assignments: DataFrame, unit: str = "unit_id") -> DataFrame:
    keys = [unit, "fold"] if "fold" in assignments.columns else [unit]
    twice = assignments.groupBy(*keys).agg(F.count_distinct("role").alias("_r")).filter("_r > 1")
    if not twice.isEmpty():
        raise ValueError("a unit holds more than one role")
    return assignments


def read_split(spark: SparkSession, path: str) -> DataFrame:
    return _require_disjoint(spark.read.parquet(path))


def read_split_json(spark: SparkSession, path: str) -> DataFrame:
    """Import a split document with ``<role>_engine_ids`` arrays."""
    doc = spark.read.option("multiLine", True).json(path)
    out = None
    for role in SPLIT_ROLES:
        name = f"{role}_engine_ids"
        if name in doc.columns:
            part = doc.select(F.explode(name).alias("unit_id"), F.lit(role).alias("role"))
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no id arrays found")
    return _require_disjoint(out)


def read_folds_json(spark: SparkSession, path: str) -> DataFrame:
    """Import a cross-validation document: one line per fold, unit and outer role."""
    doc = spark.read.option("multiLine", True).json(path)
    folds = doc.select(F.explode("folds").alias("f"))
    train = folds.select(
        F.explode("f.training_engine_ids").alias("unit_id"),
        F.col("f.fold").cast("int").alias("fold"),
        F.lit("outer_train").alias("role"),
    )
    held = folds.select(
        F.explode("f.validation_engine_ids").alias("unit_id"),
        F.col("f.fold").cast("int").alias("fold"),
        F.lit("outer_eval").alias("role"),
    )
    return _require_disjoint(train.unionByName(held))


def split_document(assignments: DataFrame, max_units: int = 1_000_000, **attributes) -> DataFrame:
    """One-row document with sorted id arrays per role, for export as JSON.

    A document is one row by nature, so it is refused above ``max_units`` units;
    larger splits stay in the Parquet form.
    """
    if assignments.limit(max_units + 1).count() > max_units:
        raise ValueError(f"more than {max_units} units: use write_split")
    roles = ("train", "validation", "calibration")
    aggs = []
    for role in roles:
        ids = F.collect_set(F.when(F.col("role") == role, F.col("unit_id")))
        aggs.append(F.sort_array(ids).alias(f"{role}_engine_ids"))
    doc = assignments.agg(*aggs)
    for role in roles:
        doc = doc.withColumn(f"n_{role}", F.size(f"{role}_engine_ids"))
    return doc.withColumns({k: F.lit(v) for k, v in attributes.items()}) if attributes else doc


def write_folds(assignments: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Cross-validation assignments ``(unit_id, fold, role)``, one folder per fold: no document holds all ids."""
    _require_disjoint(assignments).write.mode(mode).partitionBy("fold", "role").parquet(path)
    return path


def read_folds(spark: SparkSession, path: str) -> DataFrame:
    stored = spark.read.parquet(path).select("unit_id", F.col("fold").cast("int").alias("fold"), "role")
    return _require_disjoint(stored)
