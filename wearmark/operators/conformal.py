"""Split-conformal intervals calibrated per unit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .evaluate import metric_columns
from .quantiles import UNIT_LEVELS, exact_median, exact_quantiles, higher_rank
from .segments import UNIT

ALPHAS = (0.1, 0.2, 0.3)


def finite_sample_index(n: Column, alpha: Column) -> Column:
    """1-based ``k = ceil((n+1)(1-alpha))``, kept inside 1..n."""
    k = F.ceil((n + 1) * (F.lit(1.0) - alpha)).cast("double")
    return F.least(F.greatest(k, F.lit(1.0)), n)


def _finite_sample_rank(n: Column, alpha: Column) -> Column:
    return finite_sample_index(n, alpha) - 1


def _row_level_rank(n: Column, alpha: Column) -> Column:
    level = (n + 1) * (F.lit(1.0) - alpha) / n
    safe = F.when(level <= 1, level).otherwise(
        F.raise_error(F.lit("too few scores for this alpha")).cast("double")
    )
    return higher_rank(n, safe)


def conformal_q(
    scores: DataFrame,
    alphas: Sequence[float] = ALPHAS,
    rule: str = "finite_sample",
    score: str = "score",
    by: Sequence[str] = (),
) -> DataFrame:
    """Half-width ``q`` per alpha.

    ``finite_sample`` takes the k-th smallest score; ``higher`` is the older
    row-level quantile at level (n+1)(1-alpha)/n. They differ in general.
    """
    ranks = {"finite_sample": _finite_sample_rank, "higher": _row_level_rank}
    q = exact_quantiles(
        scores, score, alphas, by, rank=ranks[rule], out="q", param="alpha", size="n", levels=UNIT_LEVELS
    )
    if rule == "finite_sample":
        k = finite_sample_index(F.col("n").cast("double"), F.col("alpha")).cast("long")
        return q.withColumn("k", k)
    return q


def cluster_scores(
    predictions: DataFrame, u: str = UNIT, y: str = "true_raw_rul", p: str = "prediction",
    digits: int | None = None,
) -> DataFrame:
    """One score per unit: its largest absolute error over the checkpoints."""
    worst = F.max(F.abs(F.col(p) - F.col(y)))
    return predictions.groupBy(u).agg((worst if digits is None else F.round(worst, digits)).alias("score"))


def coverage(
    predictions: DataFrame,
    q: DataFrame,
    y: str = "true_raw_rul",
    p: str = "prediction",
    history: str | None = None,
    w: int | None = None,
) -> DataFrame:
    """Share of rows inside the interval per alpha, optionally split by history length.

    ``q`` has one line per alpha.
    """
    inside = (F.abs(F.col(y) - F.col(p)) <= F.col("q")).cast("double")
    aggs = [F.avg(inside).alias("coverage"), F.count(F.lit(1)).alias("rows")]
    if history is not None:
        aggs += [
            F.avg(F.when(F.col(history) >= w, inside)).alias("coverage_full_history"),
            F.avg(F.when(F.col(history) < w, inside)).alias("coverage_short_history"),
        ]
    lines = q.select("alpha", "q")
    return predictions.crossJoin(F.broadcast(lines)).groupBy("alpha", "q").agg(*aggs)


def add_interval(df: DataFrame, q: DataFrame, digits: int | None = 2, p: str = "prediction") -> DataFrame:
    """Symmetric interval and its width per alpha; the lower bound may be negative."""
    both = df.crossJoin(F.broadcast(q.select("alpha", "q")))
    bounds = {"lo": F.col(p) - F.col("q"), "hi": F.col(p) + F.col("q"), "width": F.lit(2.0) * F.col("q")}
    if digits is not None:
        bounds = {k: F.round(v, digits) + F.lit(0.0) for k, v in bounds.items()}
    return both.withColumns(bounds)


def early_warning_metrics(
    df: DataFrame, q: DataFrame, by: Sequence[str] = ("sample",), y: str = "true_rul", p: str = "prediction"
) -> DataFrame:
    """Metrics of the lower bound used as the prediction, next to coverage, per alpha."""
    both = df.crossJoin(F.broadcast(q.select("alpha", "q")))
    inside = (F.abs(F.col(y) - F.col(p)) <= F.col("q")).cast("double")
    return both.groupBy(*by, "alpha", "q").agg(
        F.avg(inside).alias("coverage"), *metric_columns(F.col(y), F.col(p) - F.col("q"), "lb_")
    )


def interval_table(samples: dict[str, DataFrame], q: DataFrame, u: str = UNIT) -> DataFrame:
    """Stack samples with their intervals."""
    out = None
    for name, df in samples.items():
        part = add_interval(df.select(u, "true_rul", "prediction"), q, digits=None).withColumn(
            "sample", F.lit(name)
        )
        out = part if out is None else out.unionByName(part)
    return out


def residual_summary(df: DataFrame, y: str = "true_raw_rul", p: str = "prediction") -> DataFrame:
    """Mean, median and largest absolute residual."""
    r = F.abs(F.col(p) - F.col(y))
    plain = df.agg(F.count(r).alias("n"), F.avg(r).alias("mean"), F.max(r).alias("max"))
    return plain.crossJoin(exact_median(df, r, levels=UNIT_LEVELS))


def check_guarantee(coverage_rows: DataFrame, slack: float = 1e-9) -> DataFrame:
    """Calibration coverage must reach ``1 - alpha``."""
    return coverage_rows.withColumn("passed", F.col("coverage") >= F.lit(1.0) - F.col("alpha") - slack)
