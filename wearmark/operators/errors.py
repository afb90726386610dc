"""Error analysis of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import asymmetric_score, pearson
from .quantiles import UNIT_LEVELS, exact_median
from .segments import UNIT

# History buckets (half-open) and the three inclusive bucketings;
# a bound of None leaves the last bucket open.
HISTORY_BUCKETS = ((0, 45), (45, 90), (90, 128), (128, 200), (200, None))
PROFILE_BUCKETS = {
    "observed_history": (
        (0, 44, "padded_observed_lt_window"),
        (45, 127, "observed_45_127"),
        (128, None, "observed_ge_128"),
    ),
    "implied_lifetime": (
        (0, 127, "implied_lifetime_lt_128"),
        (128, None, "implied_lifetime_ge_128"),
    ),
    "true_rul_bin": (
        (0, 29, "true_rul_0_29"),
        (30, 59, "true_rul_30_59"),
        (60, 99, "true_rul_60_99"),
        (100, None, "true_rul_ge_100"),
    ),
}
NEAR = 13
FAR = 50


def with_errors(df: DataFrame, y: str = "true_rul", p: str = "prediction") -> DataFrame:
    e = F.col(p) - F.col(y)
    return df.withColumns({"error": e, "abs_error": F.abs(e), "score_point": asymmetric_score(y, p)})


def _below(value: Column, bound: int | None, inclusive: bool = False) -> Column:
    """``value`` under an upper bound; None has no bound."""
    if bound is None:
        return F.lit(True)
    return value <= bound if inclusive else value < bound


def history_bucket(value: Column, buckets: Sequence[tuple[int, int | None]] = HISTORY_BUCKETS) -> Column:
    """Lower bound of the half-open bucket; NULL outside all buckets."""
    out = F.lit(None).cast("int")
    for lo, hi in buckets:
        out = F.when((value >= lo) & _below(value, hi), F.lit(lo)).otherwise(out)
    return out


def bucket_profile(
    df: DataFrame,
    buckets: Sequence[tuple[int, int | None]] = HISTORY_BUCKETS,
    history: str = "observed_cycles",
    y: str = "true_rul",
    p: str = "prediction",
) -> DataFrame:
    """Signed error by history length; bounds stay numeric (NULL: open), empty buckets drop out."""
    rows = with_errors(df, y, p).withColumn("lower", history_bucket(F.col(history), buckets))
    upper = F.lit(None).cast("int")
    for lo, hi in buckets:
        upper = F.when(F.col("lower") == lo, F.lit(hi)).otherwise(upper)
    return (
        rows.filter(F.col("lower").isNotNull())
        .groupBy("lower")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("error").alias("mean_signed_error"),
            F.avg((F.col("error") > 0).cast("double")).alias("overprediction_share"),
            F.avg("abs_error").alias("mean_abs_error"),
        )
        .withColumn("upper", upper)
    )


def multi_profile(
    df: DataFrame,
    window: int = 45,
    buckets: dict[str, Sequence[tuple[int, int | None, str]]] = PROFILE_BUCKETS,
    y: str = "true_rul",
    p: str = "prediction",
) -> DataFrame:
    """Independent inclusive bucketings plus padded/full, with shares of the total score.

    ``df`` has ``observed_cycles`` and ``implied_failure_cycle``. One aggregate
    over grouping sets counts every bucketing and the whole, so ``df`` is read
    and shuffled once; empty groups are kept with count 0.
    """
    sources = {
        "observed_history": F.col("observed_cycles"),
        "implied_lifetime": F.col("implied_failure_cycle"),
        "true_rul_bin": F.col(y),
    }
    names, tags = [], {}
    for split, parts in buckets.items():
        value = sources[split]
        tag = F.lit(None).cast("string")
        for lo, hi, group in parts:
            names.append((split, group))
            tag = F.when((value >= lo) & _below(value, hi, inclusive=True), F.lit(group)).otherwise(tag)
        tags[split] = tag
    padded, full = f"padded_observed_lt_{window}", f"full_observed_ge_{window}"
    names += [("padded_vs_full", padded), ("padded_vs_full", full)]
    short = F.col("observed_cycles") < window
    tags["padded_vs_full"] = F.when(short, F.lit(padded)).otherwise(F.lit(full))

    columns = [f"_g{i}" for i in range(len(tags))]
    rows = with_errors(df, y, p).select(
        "error", "abs_error", "score_point", *[tag.alias(c) for c, tag in zip(columns, tags.values())]
    )
    sets = [[F.col(c)] for c in columns] + [[]]
    stats = rows.groupingSets(sets, *[F.col(c) for c in columns]).agg(
        F.grouping_id().alias("_set"),
        F.count(F.lit(1)).alias("count"),
        F.avg("error").alias("mean_error"),
        F.avg("abs_error").alias("mean_abs_error"),
        F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"),
        F.sum("score_point").alias("score_sum"),
    )
    # a set's number has a bit for every column that it leaves out
    whole = (1 << len(columns)) - 1
    split = F.lit(None).cast("string")
    for i, name in enumerate(tags):
        split = F.when(F.col("_set") == whole - (1 << (len(columns) - 1 - i)), F.lit(name)).otherwise(split)
    # one line per group and one for the whole: a fixed, small number
    lines = Window.partitionBy(F.lit(1))
    stats = stats.select(
        split.alias("split"),
        F.coalesce(*columns).alias("group"),
        *[c for c in ("count", "mean_error", "mean_abs_error", "rmse", "score_sum")],
        F.max(F.when(F.col("_set") == whole, F.col("score_sum"))).over(lines).alias("_total"),
    )
    groups = df.sparkSession.createDataFrame(names, "split string, group string")
    return (
        F.broadcast(groups)
        .join(stats.filter(F.col("group").isNotNull()), ["split", "group"], "left")
        .fillna({"count": 0})
        .withColumn("score_pct", F.try_divide(F.col("score_sum"), F.col("_total")) * 100)
        .drop("_total")
    )


def rul_bucket_table(
    df: DataFrame, edges: Sequence[float], y: str = "true_rul", p: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """Errors by true remaining life; a bucket is [edge, next edge), the last one open."""
    lower = F.lit(None).cast("double")
    for edge in edges:
        lower = F.when(F.col(y) >= edge, F.lit(float(edge))).otherwise(lower)
    return (
        with_errors(df, y, p)
        .withColumn("lower", lower)
        .filter(F.col("lower").isNotNull())
        .groupBy(*by, "lower")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("error").alias("mean_error"),
            F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"),
            F.avg("abs_error").alias("mae"),
            F.avg((F.col("error") > 0).cast("double")).alias("late_share"),
            F.avg((F.col("abs_error") < NEAR).cast("double")).alias("near_share"),
        )
    )


def error_headline(df: DataFrame, by: Sequence[str] = (), y: str = "true_rul", p: str = "prediction") -> DataFrame:
    """Bias, share within 13 cycles, late and early counts, misses beyond 50 cycles."""
    rows = with_errors(df, y, p)
    e = F.col("error")
    plain = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(e).alias("bias_mean"),
        F.avg((F.col("abs_error") < NEAR).cast("double")).alias("near_share"),
        F.count_if(e > 0).alias("late"),
        F.count_if(e < 0).alias("early"),
        F.count_if(e > FAR).alias("late_far"),
        F.count_if(e < -FAR).alias("early_far"),
    )
    median = exact_median(rows, "error", by, out="bias_median", levels=UNIT_LEVELS)
    return plain.join(median, list(by)) if by else plain.crossJoin(median)


def error_correlation(
    df: DataFrame, by: Sequence[str] = (), history: str = "observed_cycles",
    y: str = "true_rul", p: str = "prediction",
) -> DataFrame:
    e = F.col(p) - F.col(y)
    return df.groupBy(*by).agg(
        pearson(y, e).alias("corr_true_rul"),
        pearson(history, e).alias("corr_history"),
    )


def worst_k(
    df: DataFrame, by: str, k: int = 5, on: str = "abs_error", u: str = UNIT,
    y: str = "true_rul", p: str = "prediction", tie: Sequence[str] = (),
) -> DataFrame:
    """The ``k`` worst rows per sample. Spark cuts each partition to ``k`` before the shuffle."""
    order = Window.partitionBy(by).orderBy(F.desc(on), u, *tie)
    return with_errors(df, y, p).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def late_share(df: DataFrame, by: Sequence[str] = (), y: str = "true_rul", p: str = "prediction") -> DataFrame:
    """Share of the total score that comes from late errors, and from far-late errors."""
    rows = with_errors(df, y, p)
    point, e = F.col("score_point"), F.col("error")
    total = F.sum(point)
    return rows.groupBy(*by).agg(
        F.try_divide(F.sum(F.when(e > 0, point).otherwise(0.0)), total).alias("late_share"),
        F.try_divide(F.sum(F.when(e > FAR, point).otherwise(0.0)), total).alias("far_late_share"),
    )


def padded_errors(
    df: DataFrame, w: int, history: str = "observed_cycles", u: str = UNIT,
    y: str = "true_rul", p: str = "prediction", digits: int = 1,
) -> DataFrame:
    """Errors of units shorter than the window, one line each."""
    return df.filter(F.col(history) < w).select(
        *[c for c in ("sample",) if c in df.columns],
        u,
        history,
        (F.round(F.col(p) - F.col(y), digits) + F.lit(0.0)).alias("error"),
    )


def error_profile(samples: dict[str, DataFrame], u: str = UNIT) -> DataFrame:
    """Stack per-row errors of several samples."""
    out = None
    for name, df in samples.items():
        part = with_errors(df).select(
            F.lit(name).alias("sample"), u, "observed_cycles", "true_rul", "prediction", "error", "score_point"
        )
        out = part if out is None else out.unionByName(part)
    return out
