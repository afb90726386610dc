"""Remaining-useful-life targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .profile import lifetimes
from .segments import ORDER, SEGMENT_ROWS, UNIT, attach_units

TARGET_MODES = ("raw", "capped")


def add_target(
    df: DataFrame,
    mode: str = "raw",
    cap: int | None = None,
    u: str = UNIT,
    o: str = ORDER,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """``rul`` = last cycle of the unit minus the cycle, optionally capped.

    The mode is always explicit: ``raw`` ignores ``cap``, ``capped`` needs it.
    Last cycles come from a pre-aggregated unit table, not from a per-unit window.
    """
    if mode not in TARGET_MODES:
        raise ValueError(f"mode must be one of {TARGET_MODES}")
    if mode == "capped" and cap is None:
        raise ValueError("mode 'capped' needs a cap")
    ends = lifetimes(df, u, o)
    joined = attach_units(df, ends, u, o, segment_rows=segment_rows, last="lifetime")
    rul = F.col("lifetime") - F.col(o)
    if mode == "capped":
        rul = F.least(rul, F.lit(cap))
    return joined.withColumn("rul", rul.cast("long")).select(*df.columns, "rul")


def observed_history(df: DataFrame, u: str = UNIT, o: str = ORDER) -> DataFrame:
    """Observed cycles per unit. For truncated units this is not a lifetime."""
    return lifetimes(df, u, o).withColumnRenamed("lifetime", "observed_cycles")


def implied_failure_cycle(observed: DataFrame, labels: DataFrame, u: str = UNIT) -> DataFrame:
    """Observed cycles plus true remaining life; it always lies after the last observed cycle."""
    joined = observed.join(labels, u).withColumn(
        "implied_failure_cycle", F.col("observed_cycles") + F.col("true_rul")
    )
    fine = F.col("implied_failure_cycle") > F.col("observed_cycles")
    problem = F.raise_error(F.concat(F.lit("label is not positive for unit "), F.col(u).cast("string")))
    return joined.withColumn(
        "implied_failure_cycle", F.when(fine, F.col("implied_failure_cycle")).otherwise(problem.cast("long"))
    )
