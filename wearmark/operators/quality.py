"""Data-quality report: one line per check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F, types as T

from .segments import ORDER, SEGMENT_ROWS, UNIT

# Unit counts of the public turbofan datasets.
EXPECTED_UNITS = {
    ("FD001", "train"): 100,
    ("FD001", "test"): 100,
    ("FD002", "train"): 260,
    ("FD002", "test"): 259,
    ("FD003", "train"): 100,
    ("FD003", "test"): 100,
    ("FD004", "train"): 249,
    ("FD004", "test"): 248,
}


def expected_units(spark, dataset: str | None = None) -> DataFrame:
    rows = [(d, k, n) for (d, k), n in EXPECTED_UNITS.items() if dataset in (None, d)]
    return spark.createDataFrame(rows, "dataset string, kind string, expected_units int")


def _numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def _is_float(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing, infinite, distinct-bounds facts of every numeric column, in one scan.

    A column is constant when its smallest and largest value agree; that needs no
    distinct count. One line per column.
    """
    numeric = list(columns) if columns else _numeric_columns(df)
    facts = []
    for name in numeric:
        c = F.col(name).cast("double")
        present = F.when(~F.isnan(c), c)
        facts.append(
            F.struct(
                F.lit(name).alias("column"),
                F.count(present).alias("present"),
                F.coalesce(F.sum((c.isNull() | F.isnan(c)).cast("long")), F.lit(0)).alias("missing"),
                F.coalesce(F.sum((F.abs(present) == float("inf")).cast("long")), F.lit(0)).alias("infinite"),
                F.min(present).alias("low"),
                F.max(present).alias("high"),
            )
        )
    return (
        df.agg(F.array(*facts).alias("_facts"))
        .select(F.explode("_facts").alias("_f"))
        .select("_f.*")
        .withColumn("is_constant", F.col("low").eqNullSafe(F.col("high")))
        .withColumn("is_empty", F.col("present") == 0)
    )


def constant_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns with at most one distinct value: reported, never failed or removed."""
    return column_profile(df, columns).filter("is_constant").select("column", "low")


def duplicate_rows(df: DataFrame, keys: Sequence[str] = (UNIT, ORDER)) -> DataFrame:
    """Keys held by several rows, with the occurrences beyond the first."""
    return (
        df.groupBy(*keys)
        .agg((F.count(F.lit(1)) - 1).alias("extra_rows"))
        .filter(F.col("extra_rows") > 0)
    )


def order_breaks(
    df: DataFrame,
    u: str = UNIT,
    o: str = ORDER,
    row_idx: str = "row_idx",
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Per unit, how often the cycle fails to grow from one ingested row to the next.

    Neighbours are compared inside runs of ``segment_rows`` consecutive row
    numbers, and the run ends are compared on a table with one line per run.
    """
    runs = df.select(u, o, row_idx, F.floor(F.col(row_idx) / segment_rows).alias("_run"))
    inside = Window.partitionBy(u, "_run").orderBy(row_idx)
    steps = runs.withColumn("_step", F.col(o) - F.lag(o).over(inside))
    ends = steps.groupBy(u, "_run").agg(
        F.sum((F.col("_step") < 1).cast("long")).alias("_inside"),
        F.min_by(o, row_idx).alias("_first"),
        F.max_by(o, row_idx).alias("_final"),
    )
    between = Window.partitionBy(u).orderBy("_run")
    joints = ends.withColumn("_joint", F.col("_first") - F.lag("_final").over(between))
    return joints.groupBy(u).agg(
        (
            F.coalesce(F.sum("_inside"), F.lit(0))
            + F.coalesce(F.sum((F.col("_joint") < 1).cast("long")), F.lit(0))
        ).alias("breaks")
    )


def _check(name: str, passed, observed):
    return F.struct(
        F.lit(name).alias("check"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
        observed.cast("string").alias("observed"),
    )


def validate_trajectories(
    df: DataFrame,
    expected: int | None = None,
    columns: int | None = None,
    u: str = UNIT,
    o: str = ORDER,
    row_idx: str = "row_idx",
) -> DataFrame:
    """Long report ``(check, passed, observed)`` over the whole trajectory table."""
    data = [c for c in df.columns if c != row_idx]
    numeric = [c for c in data if c in _numeric_columns(df)]
    wanted = columns if columns is not None else len(data)

    missing = sum(
        (
            (F.col(c).isNull() | F.isnan(c) if _is_float(df, c) else F.col(c).isNull()).cast("long")
            for c in data
        ),
        F.lit(0).cast("long"),
    )
    infinite = sum(
        (
            F.coalesce((F.abs(F.col(c)) == float("inf")).cast("long"), F.lit(0))
            for c in numeric
            if _is_float(df, c)
        ),
        F.lit(0).cast("long"),
    )
    empty = sum(
        (
            (F.count(F.when(~F.isnan(c), F.col(c)) if _is_float(df, c) else F.col(c)) == 0).cast("int")
            for c in numeric
        ),
        F.lit(0),
    )
    scan = df.agg(
        F.coalesce(F.sum(missing), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(infinite), F.lit(0)).alias("infinite"),
        empty.alias("empty"),
    )
    twice = duplicate_rows(df, [u, o]).agg(F.coalesce(F.sum("extra_rows"), F.lit(0)).alias("extra"))
    order = order_breaks(df, u, o, row_idx).agg(F.coalesce(F.sum("breaks"), F.lit(0)).alias("breaks"))
    units = (
        df.groupBy(u).agg(F.lit(1).alias("_one"))
        .agg(F.count(u).alias("units"), F.min(u).alias("first"), F.max(u).alias("final"))
    )
    # four one-row tables side by side
    facts = scan.crossJoin(twice).crossJoin(order).crossJoin(units)
    checks = [
        _check("column_count", F.lit(len(data) == wanted), F.lit(len(data))),
        _check("all_numeric", F.lit(len(numeric) == len(data)), F.lit(len(data) - len(numeric))),
        _check("no_missing", F.col("missing") == 0, F.col("missing")),
        _check("no_infinite", F.col("infinite") == 0, F.col("infinite")),
        _check("no_empty_column", F.col("empty") == 0, F.col("empty")),
        _check("no_duplicate_cycle", F.col("extra") == 0, F.col("extra")),
        _check("cycles_increase", F.col("breaks") == 0, F.col("breaks")),
        _check("ids_start_at_one", F.col("first") == 1, F.col("first")),
        _check("ids_contiguous", F.col("units") == F.col("final"), F.col("units")),
    ]
    if expected is not None:
        checks.append(_check("unit_count", F.col("units") == expected, F.col("units")))
    return facts.select(F.explode(F.array(*checks)).alias("_c")).select("_c.*")


def report_passed(report: DataFrame) -> DataFrame:
    """Overall verdict: every check passed."""
    return report.agg(F.bool_and("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


def validate_labels(df: DataFrame, expected: int, label: str = "true_rul") -> DataFrame:
    """Label file: one positive integer per expected unit."""
    integral = isinstance(df.schema[label].dataType, T.IntegralType)
    facts = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.bool_and(F.coalesce(F.col(label) > 0, F.lit(False))), F.lit(True)).alias("positive"),
    )
    checks = [
        _check("label_count", F.col("n") == expected, F.col("n")),
        _check("labels_positive_integers", F.lit(integral) & F.col("positive"), F.col("positive")),
    ]
    return facts.select(F.explode(F.array(*checks)).alias("_c")).select("_c.*")
