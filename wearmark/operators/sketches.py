"""Approximate order statistics from mergeable quantile sketches.

A KLL sketch keeps a bounded number of values whatever it has seen, and two of
them merge into one of the same bound. Sketches are kept per unit, so a group of
units, or the whole fleet, is answered by merging lines of a small table and the
rows are never read again. Exact quantiles stay the default everywhere; the
operators that offer the switch say so.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import clean
from .segments import UNIT

# Values kept per level; a sketch that has seen no more than these is exact.
SIZE = 800


def rank_error(size: int = SIZE) -> float:
    """Normalised rank error that a quantile keeps within, with 99 % confidence, for sketches of this size."""
    return 2.296 / size**0.9021


def unit_sketches(df: DataFrame, value: str | Column, keys: Sequence[str] = (UNIT,), size: int = SIZE) -> DataFrame:
    """``keys, sketch, n`` of a column's known values; combined on the map side, so a hot unit moves a sketch per task."""
    value = clean(value) if isinstance(value, str) else value
    rows = df.select(*keys, value.cast("double").alias("_value")).filter(F.col("_value").isNotNull())
    return rows.groupBy(*keys).agg(
        F.kll_sketch_agg_double("_value", size).alias("sketch"), F.count(F.lit(1)).alias("n")
    )


def merged(sketches: DataFrame, by: Sequence[str] = (), size: int = SIZE) -> DataFrame:
    """One sketch per group of ``by``, or one of all, from finer ones; no row is read again."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", size).alias("sketch"), F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, params: Sequence[float], out: str = "quantile", param: str = "prob") -> DataFrame:
    """One line per sketch and parameter: the smallest value whose rank reaches it, within ``rank_error``.

    Groups without values have no line.
    """
    keys = [c for c in sketches.columns if c not in ("sketch", "n")]
    known = sketches.filter(F.col("n") > 0)
    cells = [
        F.struct(F.lit(float(p)).alias(param), F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(out))
        for p in params
    ]
    return known.select(*keys, "n", F.explode(F.array(*cells)).alias("_c")).select(*keys, "_c.*", "n")


def ranks(sketches: DataFrame, values: Sequence[float], out: str = "rank") -> DataFrame:
    """One line per sketch and value: the share of values up to it, within ``rank_error``."""
    keys = [c for c in sketches.columns if c not in ("sketch", "n")]
    cells = [
        F.struct(F.lit(float(v)).alias("value"), F.kll_sketch_get_rank_double("sketch", F.lit(float(v))).alias(out))
        for v in values
    ]
    return sketches.filter(F.col("n") > 0).select(*keys, F.explode(F.array(*cells)).alias("_c")).select(*keys, "_c.*")
