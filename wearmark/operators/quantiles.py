"""Exact order statistics of columns of any size.

The built-in exact percentile gathers every distinct value of a group in one
task. Here values are first counted per distinct value (with map-side partial
aggregation), then a histogram narrows the range that holds the wanted rank a
few times, and only the values of that last small range are ordered.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import clean

BINS = 4096
# narrowing steps: two leave about one value in 16 million for the final ordering
# (row tables), one leaves one in 4096 (unit-sized tables)
LEVELS = 2
UNIT_LEVELS = 1

# (group size n, parameter p) -> 0-based rank, fractional ranks are interpolated
RankRule = Callable[[Column, Column], Column]


def linear_rank(n: Column, p: Column) -> Column:
    return (n - 1) * p


def higher_rank(n: Column, p: Column) -> Column:
    return F.ceil((n - 1) * p).cast("double")


def _bin(value: Column, low: Column, high: Column) -> Column:
    width = high - low
    usable = (width > 0) & (width < float("inf"))
    return F.when(
        usable, F.least(F.floor((value - low) / width * BINS), F.lit(BINS - 1))
    ).otherwise(F.lit(0)).cast("long")


def _in_range(values: DataFrame, targets: DataFrame, by: list[str]) -> DataFrame:
    # targets: one line per category, parameter and side
    few = F.broadcast(targets)
    joined = values.join(few, by) if by else values.crossJoin(few)
    return joined.filter(F.col("_value").between(F.col("_low"), F.col("_high")))


CARRIED = ["_place", "_total"]


def _narrow(values: DataFrame, targets: DataFrame, by: list[str], slot: list[str]) -> DataFrame:
    """Replace each target's range by the histogram bin that holds its rank."""
    key = [*by, *slot]
    place = _bin(F.col("_value"), F.col("_low"), F.col("_high")).alias("_bin")
    bins = _in_range(values, targets, by).groupBy(*key, *CARRIED, "_rank", place).agg(
        F.sum("_count").alias("_n"), F.min("_value").alias("_lo"), F.max("_value").alias("_hi")
    )
    run = Window.partitionBy(*key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    before = F.col("_upto") - F.col("_n")
    return (
        bins.withColumn("_upto", F.sum("_n").over(run))
        .filter((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= before))
        .select(
            *key,
            *CARRIED,
            (F.col("_rank") - before).alias("_rank"),
            F.col("_lo").alias("_low"),
            F.col("_hi").alias("_high"),
        )
    )


def exact_quantiles(
    df: DataFrame,
    value: str | Column,
    params: Sequence[float],
    by: Sequence[str] = (),
    weight: Column | None = None,
    rank: RankRule = linear_rank,
    out: str = "quantile",
    param: str = "prob",
    size: str | None = None,
    levels: int = LEVELS,
) -> DataFrame:
    """One row per group and parameter with the exact (interpolated) order statistic.

    NULL and NaN are skipped. With ``weight`` a value counts as that many rows.
    ``by`` names category columns (sensor, sample, ...): there is one broadcast
    line per category and parameter, so do not pass ids. ``size`` names an
    output column for the number of rows in the group.
    """
    by = list(by)
    value = F.col(value) if isinstance(value, str) else value
    weight = F.lit(1).cast("long") if weight is None else weight.cast("long")
    values = (
        df.select(*by, clean(value).alias("_value"), weight.alias("_w"))
        .filter(F.col("_value").isNotNull() & (F.col("_w") > 0))
        .groupBy(*by, "_value")
        .agg(F.sum("_w").alias("_count"))
    )
    stats = values.groupBy(*by).agg(
        F.min("_value").alias("_low"), F.max("_value").alias("_high"), F.sum("_count").alias("_total")
    )
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in params]))
    sides = F.explode(F.array(F.lit(0), F.lit(1)))
    side_rank = F.when(F.col("_side") == 0, F.floor("_place")).otherwise(F.ceil("_place"))
    targets = (
        stats.filter(F.col("_total") > 0)
        .select(*by, "_low", "_high", "_total", wanted.alias(param))
        .withColumn("_place", rank(F.col("_total").cast("double"), F.col(param)))
        .select("*", sides.alias("_side"))
        .withColumn("_rank", side_rank.cast("long"))
    )
    slot = [param, "_side"]
    for _ in range(levels):
        targets = _narrow(values, targets, by, slot)

    key = [*by, *slot]
    run = Window.partitionBy(*key).orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
    reached = (
        _in_range(values, targets, by)
        .withColumn("_upto", F.sum("_count").over(run))
        .filter(F.col("_upto") > F.col("_rank"))
    )
    lower, upper = (
        F.min(F.when(F.col("_side") == i, F.col("_value"))) for i in (0, 1)
    )
    share = F.max("_place") - F.floor(F.max("_place"))
    sizes = [F.max("_total").alias(size)] if size else []
    return reached.groupBy(*by, param).agg((lower + (upper - lower) * share).alias(out), *sizes)


def exact_median(
    df: DataFrame,
    value: str | Column,
    by: Sequence[str] = (),
    weight: Column | None = None,
    out: str = "median",
    levels: int = LEVELS,
) -> DataFrame:
    return exact_quantiles(df, value, [0.5], by, weight, out=out, levels=levels).drop("prob")
