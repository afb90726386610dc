"""Unit-level splits as assignment tables, and the guards that keep them honest.

Ranks come from the md5 of ``unit:seed``: repeatable on any cluster and
independent of row order. Ranking is bucketed by hash prefix, so even the unit
table is never sorted in one task.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .segments import ORDER, SEGMENT_ROWS, UNIT, attach_units, number_rows

PYTHON_SHUFFLE_LIMIT = 1_000_000


def unit_hash(u: str, seed: int | Column) -> Column:
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    return F.md5(F.concat_ws(":", F.col(u).cast("string"), seed.cast("string")))


def ranked_units(
    units: DataFrame,
    seed: int | Column,
    u: str = UNIT,
    by: Sequence[str] = (),
    method: str = "hash",
    limit: int = PYTHON_SHUFFLE_LIMIT,
) -> DataFrame:
    """1-based ``rank`` of each unit in a seeded shuffle.

    ``hash`` is the distributed default. ``mt19937`` repeats the shuffle of
    Python's ``random.Random(seed)`` on the sorted ids; it reads the ids on the
    driver and refuses more than ``limit`` of them.
    """
    if method == "hash":
        hashed = units.withColumn("_hash", unit_hash(u, seed))
        return number_rows(hashed, list(by), ["_hash", u], [F.substring("_hash", 1, 3)], "rank").drop("_hash")
    if method != "mt19937":
        raise ValueError("method must be 'hash' or 'mt19937'")
    if by or isinstance(seed, Column):
        raise ValueError("method 'mt19937' shuffles one list with one seed")
    ids = [row[0] for row in units.select(u).distinct().limit(limit + 1).collect()]
    if len(ids) > limit:
        raise ValueError(f"more than {limit} units: use method='hash'")
    ids = sorted(int(i) for i in ids)
    random.Random(seed).shuffle(ids)
    ranks = units.sparkSession.createDataFrame([(i, r) for r, i in enumerate(ids, 1)], f"{u} long, rank long")
    return units.join(ranks, u)


def split_units(
    units: DataFrame,
    fractions: Sequence[tuple[str, float]] = (("validation", 0.2),),
    seed: int = 42,
    method: str = "hash",
    u: str = UNIT,
    rest: str = "train",
) -> DataFrame:
    """Assign each unit to a split: shuffled, first ``round(n*f)`` units per named split.

    Counts round half to even; whoever is left goes to ``rest``. The three-way
    split gives ``calibration`` the validation fraction.
    """
    ids = units.select(u).distinct()
    ranked = ranked_units(ids, seed, u, method=method).crossJoin(
        F.broadcast(ids.agg(F.count(F.lit(1)).alias("_n")))
    )
    role: Column = F.lit(rest)
    edges: list[tuple[str, Column]] = []
    edge: Column = F.lit(0)
    for name, fraction in fractions:
        edge = edge + F.bround(F.col("_n") * F.lit(float(fraction)), 0).cast("long")
        edges.append((name, edge))
    for name, end in reversed(edges):
        role = F.when(F.col("rank") <= end, F.lit(name)).otherwise(role)
    return ranked.select(u, role.alias("role"))


THREE_WAY = (("validation", 0.15), ("calibration", 0.15))


def development_units(units: DataFrame, calibration: DataFrame, u: str = UNIT) -> DataFrame:
    """All units except the calibration units, which must all exist."""
    strangers = calibration.select(u).join(units.select(u), u, "left_anti")
    if not strangers.isEmpty():
        raise ValueError("calibration units must be a subset of all units")
    return units.select(u).distinct().join(calibration.select(u), u, "left_anti")


def group_folds(
    units: DataFrame, k: int = 5, seed: int = 42, method: str = "hash", u: str = UNIT, strict: bool = True
) -> DataFrame:
    """``k`` contiguous blocks of the shuffled units, numbered from 1.

    With ``strict`` the units must divide evenly; otherwise the first folds get
    one unit more.
    """
    ids = units.select(u).distinct()
    ranked = ranked_units(ids, seed, u, method=method).crossJoin(
        F.broadcast(ids.agg(F.count(F.lit(1)).alias("_n")))
    )
    size = F.floor(F.col("_n") / k)
    longer = F.col("_n") % k
    place = F.col("rank") - 1
    head = longer * (size + 1)
    fold = F.when(place < head, F.floor(place / (size + 1))).otherwise(
        longer + F.floor((place - head) / F.greatest(size, F.lit(1)))
    ) + 1
    if strict:
        fold = F.when(longer == 0, fold).otherwise(
            F.raise_error(F.lit(f"units must divide into {k} equal folds")).cast("long")
        )
    return ranked.select(u, fold.cast("int").alias("fold"))


def fold_assignments(folds: DataFrame, k: int, u: str = UNIT) -> DataFrame:
    """Every unit in every fold: ``outer_eval`` in its own, ``outer_train`` elsewhere."""
    every = F.explode(F.sequence(F.lit(1), F.lit(k)))
    return folds.select(u, F.col("fold").alias("_own"), every.alias("fold")).select(
        u, "fold", F.when(F.col("fold") == F.col("_own"), "outer_eval").otherwise("outer_train").alias("role")
    )


def inner_split(
    assignments: DataFrame, n_stop: int | Column, seed_base: int = 4200, u: str = UNIT
) -> DataFrame:
    """Split each fold's outer training units: last ``n_stop`` stop early, the rest fit.

    The seed of fold ``f`` is ``seed_base + f``. ``n_stop`` may be an expression
    over the training-unit count ``_n``.
    """
    train = assignments.filter(F.col("role") == "outer_train").select(u, "fold")
    ranked = ranked_units(train, F.lit(seed_base) + F.col("fold"), u, by=["fold"])
    sizes = train.groupBy("fold").agg(F.count(F.lit(1)).alias("_n"))
    stop = n_stop if isinstance(n_stop, Column) else F.lit(n_stop)
    return ranked.join(F.broadcast(sizes), "fold").select(
        u,
        "fold",
        F.when(F.col("rank") <= F.col("_n") - stop, "inner_fit").otherwise("inner_stop").alias("role"),
    )


def rows_for(
    df: DataFrame,
    assignments: DataFrame,
    roles: str | Sequence[str],
    fold: int | None = None,
    u: str = UNIT,
    o: str = ORDER,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Trajectory rows of the units that hold one of ``roles``."""
    roles = [roles] if isinstance(roles, str) else list(roles)
    chosen = assignments.filter(F.col("role").isin(roles))
    if fold is not None:
        chosen = chosen.filter(F.col("fold") == fold)
    return attach_units(df, chosen.select(u).distinct(), u, o, "left_semi", segment_rows)


def check_assignments(
    assignments: DataFrame,
    units: DataFrame,
    calibration: DataFrame | None = None,
    u: str = UNIT,
    training_roles: Sequence[str] = ("train", "outer_train", "inner_fit", "inner_stop"),
) -> DataFrame:
    """Guards as a report: one role per unit and fold, exact cover, calibration untouched."""
    if "fold" not in assignments.columns:
        assignments = assignments.withColumn("fold", F.lit(0))
    overlap = assignments.groupBy(u, "fold").agg(F.count_distinct("role").alias("_r")).filter("_r > 1")
    named = assignments.select(u).distinct()
    known = units.select(u).distinct()
    parts = [
        ("roles_disjoint", overlap.agg(F.count(F.lit(1)).alias("offending"))),
        ("all_units_assigned", known.exceptAll(named).agg(F.count(F.lit(1)).alias("offending"))),
        ("no_unknown_units", named.exceptAll(known).agg(F.count(F.lit(1)).alias("offending"))),
    ]
    if calibration is not None:
        trained = assignments.filter(F.col("role").isin(list(training_roles))).select(u)
        parts.append(
            (
                "calibration_untouched",
                trained.intersect(calibration.select(u)).agg(F.count(F.lit(1)).alias("offending")),
            )
        )
    report = None
    for name, part in parts:
        line = part.select(
            F.lit(name).alias("check"), (F.col("offending") == 0).alias("passed"), "offending"
        )
        report = line if report is None else report.unionByName(line)
    return report


def final_fit_units(
    assignments: DataFrame, roles: Sequence[str] = ("train", "validation"), u: str = UNIT
) -> DataFrame:
    """Population of the final fit; calibration stays reserved."""
    chosen = assignments.filter(F.col("role").isin(list(roles))).select(u).distinct()
    reserved = assignments.filter(F.col("role") == "calibration").select(u)
    return chosen.join(reserved, u, "left_anti")
