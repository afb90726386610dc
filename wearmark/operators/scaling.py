"""Standard scalers as parameter tables, fitted on permitted rows only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import clean
from .segments import UNIT

EPS = 2.220446049250313e-16


def safe_scale(n: Column, mean: Column, var: Column) -> Column:
    """Standard deviation, or 1 when the variance is no more than rounding noise."""
    noise = n * EPS * var + (n * EPS * mean) * (n * EPS * mean)
    return F.when(var <= noise, F.lit(1.0)).otherwise(F.sqrt(var))


def fit_scaler(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Long table ``(by..., column, n, mean, scale)``; population variance, one scan.

    ``ml.feature.StandardScaler`` is not used: it divides by n-1 and zeroes
    constant columns.
    """
    facts = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(clean(c)).alias("n"),
            F.avg(clean(c)).alias("mean"),
            F.var_pop(clean(c)).alias("var"),
        )
        for c in cols
    ]
    long = (
        df.groupBy(*by)
        .agg(F.array(*facts).alias("_facts"))
        .select(*by, F.explode("_facts").alias("_f"))
        .select(*by, "_f.*")
    )
    return long.select(
        *by, "column", "n", "mean", safe_scale(F.col("n"), F.col("mean"), F.col("var")).alias("scale")
    )


def wide_params(params: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One line per scope with ``_mean_c`` and ``_scale_c`` columns."""
    picks = []
    for c in cols:
        here = F.col("column") == c
        picks.append(F.max(F.when(here, F.col("mean"))).alias(f"_mean_{c}"))
        picks.append(F.max(F.when(here, F.col("scale"))).alias(f"_scale_{c}"))
    return params.groupBy(*by).agg(*picks)


def apply_scaler(df: DataFrame, params: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Replace ``cols`` by ``(x - mean) / scale``.

    The broadcast side has one line per scope (global, fold or regime). A row
    whose scope was not fitted is an error, not a lost row.
    """
    wide = F.broadcast(wide_params(params, cols, by).withColumn("_fitted", F.lit(True)))
    joined = df.join(wide, list(by), "left") if by else df.crossJoin(wide)
    unseen = F.col("_fitted").isNull()
    message = F.concat_ws(" ", F.lit("no scaler was fitted for"), *[F.col(c).cast("string") for c in by])
    scaled = {
        c: F.when(unseen, F.raise_error(message).cast("double")).otherwise(
            (F.col(c) - F.col(f"_mean_{c}")) / F.col(f"_scale_{c}")
        )
        for c in cols
    }
    return joined.withColumns(scaled).select(df.columns)


def unit_moments(df: DataFrame, cols: Sequence[str], u: str = UNIT) -> DataFrame:
    """Per unit and column: count, mean, population variance (long form)."""
    return (
        df.groupBy(u)
        .agg(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"),
                        F.count(clean(c)).alias("n"),
                        F.avg(clean(c)).alias("mean"),
                        F.var_pop(clean(c)).alias("var"),
                    )
                    for c in cols
                ]
            ).alias("_facts")
        )
        .select(u, F.explode("_facts").alias("_f"))
        .select(u, "_f.*")
    )


def fold_scalers(
    df: DataFrame,
    assignments: DataFrame,
    cols: Sequence[str],
    roles: Sequence[str] = ("outer_train",),
    u: str = UNIT,
) -> DataFrame:
    """Scaler parameters of every (fold, role) from one scan of the rows.

    Rows are reduced to moments per unit once; folds then combine unit lines, so
    the rows are never repeated per fold.
    """
    scope = ["fold", "role", "column"]
    members = assignments.filter(F.col("role").isin(list(roles)))
    moments = unit_moments(df, cols, u).filter(F.col("n") > 0).join(members, u)
    centre = moments.groupBy(*scope).agg(
        F.sum("n").alias("_n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mean")
    )
    spread = F.col("var") + (F.col("mean") - F.col("_mean")) * (F.col("mean") - F.col("_mean"))
    # one line per fold, role and column
    combined = (
        moments.join(F.broadcast(centre), scope)
        .groupBy(*scope)
        .agg(
            F.max("_n").alias("n"),
            F.max("_mean").alias("mean"),
            (F.sum(F.col("n") * spread) / F.sum("n")).alias("var"),
        )
    )
    return combined.select(
        *scope, "n", "mean", safe_scale(F.col("n"), F.col("mean"), F.col("var")).alias("scale")
    )
