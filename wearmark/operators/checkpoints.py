"""Checkpoint manifests: fixed lifecycle cutoffs per unit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .profile import lifetimes
from .segments import ORDER, UNIT

# Lifecycle fractions of the two manifest generations.
LATE_FRACTIONS = (0.50, 0.65, 0.80, 0.90, 0.95)
BALANCED_FRACTIONS = (0.25, 0.45, 0.65, 0.80, 0.95)


def checkpoint_manifest(
    life: DataFrame, fractions: Sequence[float] = BALANCED_FRACTIONS, u: str = UNIT
) -> DataFrame:
    """Unit x fraction cutoffs, rounded half to even and kept inside ``1 .. L-1``.

    A lifetime under 2 leaves no cycle before the end; such a unit is an error.
    """
    share = F.explode(F.array(*[F.lit(float(f)) for f in fractions]))
    kept = [c for c in life.columns if c not in (u, "lifetime")]
    rows = life.select(u, *kept, F.col("lifetime").cast("long").alias("full_lifetime"), share.alias("fraction"))
    wanted = F.rint(F.col("fraction") * F.col("full_lifetime")).cast("long")
    cutoff = F.least(F.greatest(wanted, F.lit(1).cast("long")), F.col("full_lifetime") - 1)
    short = F.concat(F.lit("no checkpoint fits a lifetime of "), F.col("full_lifetime").cast("string"))
    checked = F.when(F.col("full_lifetime") < 2, F.raise_error(short).cast("long")).otherwise(cutoff)
    return rows.withColumn("cutoff_cycle", checked).select(
        u,
        *kept,
        "full_lifetime",
        "cutoff_cycle",
        (F.col("full_lifetime") - F.col("cutoff_cycle")).alias("true_raw_rul"),
        "fraction",
    )


def check_manifest(df: DataFrame, u: str = UNIT) -> DataFrame:
    """Invariants as a report: bounds, RUL identity, unique cutoffs."""
    rows = df.agg(
        F.count_if(F.col("cutoff_cycle") < 1).alias("below"),
        F.count_if(F.col("cutoff_cycle") >= F.col("full_lifetime")).alias("beyond"),
        F.count_if(F.col("true_raw_rul") != F.col("full_lifetime") - F.col("cutoff_cycle")).alias("identity"),
    )
    twice = (
        df.groupBy(u, "cutoff_cycle").agg((F.count(F.lit(1)) - 1).alias("_x"))
        .agg(F.coalesce(F.sum("_x"), F.lit(0)).alias("twice"))
    )
    names = {
        "cutoff_at_least_one": "below",
        "cutoff_before_end": "beyond",
        "rul_identity": "identity",
        "cutoffs_unique": "twice",
    }
    checks = [
        F.struct(
            F.lit(name).alias("check"),
            (F.col(c) == 0).alias("passed"),
            F.col(c).cast("long").alias("offending"),
        )
        for name, c in names.items()
    ]
    return rows.crossJoin(twice).select(F.explode(F.array(*checks)).alias("_c")).select("_c.*")


def manifests_by_role(
    life: DataFrame,
    assignments: DataFrame,
    fractions: Sequence[float] = BALANCED_FRACTIONS,
    roles: Sequence[str] = ("outer_eval", "calibration"),
    u: str = UNIT,
) -> DataFrame:
    """One manifest per role (and fold, where the assignment has one)."""
    chosen = assignments.filter(F.col("role").isin(list(roles)))
    return checkpoint_manifest(life.join(chosen, u), fractions, u)


def terminal_manifest(df: DataFrame, u: str = UNIT, o: str = ORDER) -> DataFrame:
    """One cutoff per unit: its last observed cycle."""
    return lifetimes(df, u, o).select(u, F.col("lifetime").alias("cutoff_cycle"))


def union_folds(manifests: dict[int, DataFrame]) -> DataFrame:
    """Stack fold manifests, tagged with their fold."""
    out = None
    for fold, manifest in manifests.items():
        tagged = manifest.withColumn("fold", F.lit(fold))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def manifest_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows found on one side only; empty when both manifests agree."""
    b = b.select(a.columns)
    return (
        a.exceptAll(b).withColumn("side", F.lit("left"))
        .unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
    )
