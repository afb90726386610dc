"""Whitespace-delimited trajectory and label files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.segments import number_rows

# The canonical trajectory layout.
SENSORS = [f"sensor_{i}" for i in range(1, 22)]
SETTINGS = [f"setting_{i}" for i in range(1, 4)]
COLUMNS = ["unit_id", "cycle", *SETTINGS, *SENSORS]


def read_trajectories(
    spark: SparkSession, path: str, dataset: str | None = None, kind: str = "train", width: int = len(COLUMNS)
) -> DataFrame:
    """Read blank-separated rows; repeated blanks count as one separator.

    With ``dataset`` the path is a folder holding ``<kind>_<dataset>.txt``.
    ``row_idx`` grows along each file (it follows the order of file splits), so
    file order survives; it is not gapless.
    """
    if dataset is not None:
        path = f"{path}/{kind}_{dataset}.txt"
    parts = F.split(F.trim("value"), r"\s+")
    names = COLUMNS[:width]
    fields = [
        F.get(F.col("_p"), F.lit(i)).cast("long" if name in ("unit_id", "cycle") else "double").alias(name)
        for i, name in enumerate(names)
    ]
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return (
        lines.select(parts.alias("_p"), F.monotonically_increasing_id().alias("row_idx"))
        .select(*fields, "row_idx")
    )


def read_labels(spark: SparkSession, path: str, dataset: str | None = None) -> DataFrame:
    """Positional label file: line i belongs to unit i (from 1).

    A folder counts as its files in order of their names, whatever order and
    splits Spark reads them in.
    """
    if dataset is not None:
        path = f"{path}/RUL_{dataset}.txt"
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )
    values = lines.filter(F.trim("value") != "").select(
        F.split(F.trim("value"), r"\s+")[0].cast("int").alias("true_rul"), "_file", "_block", "_line"
    )
    numbered = number_rows(
        values, [], ["_file", "_block", "_line"], [F.col("_file"), F.col("_block")], "unit_id"
    )
    return numbered.select("unit_id", "true_rul")


def canonical_columns(df: DataFrame) -> DataFrame:
    """Rename a positional frame to the canonical names, up to its own width."""
    if len(df.columns) > len(COLUMNS):
        raise ValueError(f"expected at most {len(COLUMNS)} columns, got {len(df.columns)}")
    return df.toDF(*COLUMNS[: len(df.columns)])
