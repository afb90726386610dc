"""Result sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.errors import AnalysisException


def _existing(df: DataFrame, path: str) -> DataFrame | None:
    try:
        return df.sparkSession.read.schema(df.schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def append_new(
    df: DataFrame, path: str, keys: Sequence[str], on_duplicate: str = "skip"
) -> DataFrame:
    """Append rows whose key is not stored yet; returns the table afterwards.

    ``fail`` rejects the whole batch when a key is already stored or repeated.
    Running the same append again changes nothing.
    """
    if on_duplicate not in ("skip", "fail"):
        raise ValueError("on_duplicate must be 'skip' or 'fail'")
    stored = _existing(df, path)
    fresh = df
    if on_duplicate == "fail":
        twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        if not twice.isEmpty():
            raise ValueError("the batch repeats a key")
        if stored is not None and not df.join(stored.select(*keys), list(keys), "left_semi").isEmpty():
            raise ValueError("a key is already stored")
    else:
        fresh = df.dropDuplicates(list(keys))
        if stored is not None:
            fresh = fresh.join(stored.select(*keys), list(keys), "left_anti")
    fresh.select(df.columns).write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_sequences(df: DataFrame, path: str, partition: str | None = None, mode: str = "errorifexists") -> str:
    """Window dataset with nested arrays; one folder per variant, split by role if asked."""
    writer = df.write.mode(mode)
    if partition:
        writer = writer.partitionBy(partition)
    writer.parquet(path)
    return path


def variant_path(root: str, window: int, cap: int | None, sensors: str) -> str:
    """Folder name of one sequence variant."""
    return f"{root}/w{window}_c{cap if cap is not None else 'none'}_{sensors}"


def project_columns(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Curated text projection; unknown columns and NULLs become empty text."""
    return df.select(
        *[
            (F.coalesce(F.col(k).cast("string"), F.lit("")) if k in df.columns else F.lit("")).alias(k)
            for k in keys
        ]
    )
