"""Fleet profiling tables."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import as_column, clean, pearson
from .quantiles import exact_median, exact_quantiles
from .segments import ORDER, UNIT, attach_units, number_rows
from .sketches import merged, unit_sketches

CONSTANT_EPS = 1e-12


def lifetimes(df: DataFrame, u: str = UNIT, o: str = ORDER) -> DataFrame:
    """Last cycle per unit (combined on the map side before the shuffle)."""
    return df.groupBy(u).agg(F.max(o).cast("long").alias("lifetime"))


def fleet_summary(df: DataFrame, u: str = UNIT, o: str = ORDER, sketch_size: int | None = None) -> DataFrame:
    """Units, rows and the spread of lifetimes (sample standard deviation).

    The median is exact unless ``sketch_size`` asks for one within
    ``sketches.rank_error``. The built-in exact one gathers the distinct
    lifetimes: where cycles have no gaps they add up to at most the row count n,
    so there are fewer than sqrt(2n) of them; a fleet with gaps and very many
    different lifetimes should take the sketch.
    """
    median = F.expr("percentile(lifetime, 0.5D)")
    if sketch_size is not None:
        sketch = F.kll_sketch_agg_double(F.col("lifetime").cast("double"), sketch_size)
        median = F.kll_sketch_get_quantile_double(sketch, F.lit(0.5))
    per_unit = df.groupBy(u).agg(F.max(o).cast("long").alias("lifetime"), F.count(F.lit(1)).alias("rows"))
    return per_unit.agg(
        F.count(F.lit(1)).alias("units"),
        F.sum("rows").alias("rows"),
        F.min("lifetime").alias("min_lifetime"),
        F.max("lifetime").alias("max_lifetime"),
        F.avg("lifetime").alias("mean_lifetime"),
        median.alias("median_lifetime"),
        F.stddev_samp("lifetime").alias("std_lifetime"),
    )


def _per_column(df: DataFrame, columns: Sequence[str], fact, name: str, label: str = "sensor") -> DataFrame:
    """One aggregate per column in a single scan, then one line per column."""
    row = df.agg(F.array(*[F.struct(F.lit(c).alias(label), fact(c).alias(name)) for c in columns]).alias("_a"))
    return row.select(F.explode("_a").alias("_e")).select("_e.*")


def sensor_std(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Sample standard deviation per sensor, largest first."""
    table = _per_column(df, cols, lambda c: F.stddev_samp(clean(c)), "std")
    return table.orderBy(F.desc("std"), "sensor")


def varying_sensors(df: DataFrame, cols: Sequence[str], eps: float = CONSTANT_EPS) -> DataFrame:
    """Split sensors into varying and constant. Pass training rows only."""
    return sensor_std(df, cols).withColumn("varying", F.coalesce(F.col("std") > eps, F.lit(False)))


def sensor_target_corr(df: DataFrame, cols: Sequence[str], target: str = "rul") -> DataFrame:
    """Pearson correlation of each sensor with the target, strongest first."""
    table = _per_column(df, cols, lambda c: pearson(clean(c), target), "corr")
    return table.filter(F.col("corr").isNotNull() & ~F.isnan("corr")).orderBy(F.desc(F.abs("corr")), "sensor")


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pairwise correlations in long form, both triangles, in one scan."""
    pairs = list(combinations_with_replacement(cols, 2))
    cells = []
    for a, b in pairs:
        value = pearson(clean(a), clean(b))
        cells.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), value.alias("corr")))
    half = df.agg(F.array(*cells).alias("_c")).select(F.explode("_c").alias("_e")).select("_e.*")
    sides = F.when(
        F.col("a") == F.col("b"), F.array(F.struct("a", "b"))
    ).otherwise(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return half.select(F.explode(sides).alias("_s"), "corr").select("_s.a", "_s.b", "corr")


def top_corr_matrix(df: DataFrame, cols: Sequence[str], target: str = "rul", k: int = 5) -> DataFrame:
    """Correlation matrix of the ``k`` sensors that follow the target most closely.

    All pairs are computed in the same scan as the ranking; the ranking filters them.
    """
    top = sensor_target_corr(df, cols, target).limit(k).select("sensor")
    pairs = corr_matrix(df, cols)
    return pairs.join(top.withColumnRenamed("sensor", "a"), "a", "left_semi").join(
        top.withColumnRenamed("sensor", "b"), "b", "left_semi"
    )


def distinct_and_std(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Sample standard deviation and number of distinct values (NaN skipped)."""
    stds = _per_column(df, cols, lambda c: F.stddev_samp(clean(c)), "std", "setting")
    long = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("setting"), clean(c).alias("value")) for c in cols])).alias("_e")
    ).select("_e.*")
    counts = (
        long.filter(F.col("value").isNotNull())
        .groupBy("setting", "value").agg(F.lit(1).alias("_one"))
        .groupBy("setting").agg(F.count(F.lit(1)).alias("distinct_values"))
    )
    return stds.join(counts, "setting", "left").fillna({"distinct_values": 0})


def describe(df: DataFrame, col: str, sketch_size: int | None = None) -> DataFrame:
    """Count, mean, sample std, min, quartiles, max of one column.

    Quartiles are exact, which shuffles every distinct value; with
    ``sketch_size`` they come from one sketch in the same scan, within
    ``sketches.rank_error``.
    """
    value = clean(col)
    plain = df.agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    if sketch_size is not None:
        sketch = merged(unit_sketches(df, col, [], sketch_size), [], sketch_size)
        cells = [F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(n) for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))]
        return plain.crossJoin(F.broadcast(sketch.filter(F.col("n") > 0).select(*cells)))
    quartiles = exact_quantiles(df, col, [0.25, 0.5, 0.75]).agg(
        *[
            F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(name)
            for p, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))
        ]
    )
    return plain.crossJoin(quartiles)


def histogram(df: DataFrame, col: str, bins: int = 15) -> DataFrame:
    """Equal-width bins between the smallest and largest value; the last bin is closed."""
    values = df.select(F.col(col).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    range_ = values.agg(F.min("_v").alias("low"), F.max("_v").alias("high"))
    width = F.col("high") - F.col("low")
    place = F.when(
        width > 0, F.least(F.floor((F.col("_v") - F.col("low")) / width * bins) + 1, F.lit(bins))
    ).otherwise(F.lit(1))
    counted = (
        values.crossJoin(F.broadcast(range_))
        .groupBy(place.cast("long").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    edges = range_.select(
        F.explode(F.sequence(F.lit(1).cast("long"), F.lit(bins).cast("long"))).alias("bin"), "low", "high"
    ).select(
        "bin",
        (F.col("low") + width / bins * (F.col("bin") - 1)).alias("lower"),
        (F.col("low") + width / bins * F.col("bin")).alias("upper"),
    )
    return edges.join(counted, "bin", "left").fillna({"n": 0})


def representative_units(life: DataFrame, u: str = UNIT) -> DataFrame:
    """Units of shortest, middle-rank and longest lifetime (ties by unit id).

    Lifetimes are counted first; only the units of the middle lifetime are then
    numbered, in buckets of ids, so no window spans all units.
    """
    pair = F.struct("lifetime", u)
    ends = life.agg(F.count(F.lit(1)).alias("_n"), F.min(pair).alias("shortest"), F.max(pair).alias("longest"))
    sizes = life.groupBy("lifetime").agg(F.count(F.lit(1)).alias("_units"))
    # one line per distinct lifetime
    upto = Window.partitionBy(F.lit(1)).orderBy("lifetime").rowsBetween(Window.unboundedPreceding, 0)
    placed = sizes.crossJoin(F.broadcast(ends.select("_n"))).withColumn("_upto", F.sum("_units").over(upto))
    half = F.floor(F.col("_n") / 2)
    middle = placed.filter((F.col("_upto") > half) & (F.col("_upto") - F.col("_units") <= half)).select(
        "lifetime", (half - F.col("_upto") + F.col("_units")).alias("_place")
    )
    level = life.join(F.broadcast(middle), "lifetime")
    numbered = number_rows(level, [], [u], [F.floor(F.col(u) / 1_000_000)], "_rank")
    found = numbered.filter(F.col("_rank") == F.col("_place") + 1).select(F.lit("middle").alias("kind"), u, "lifetime")
    cells = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("_p")) for k in ("shortest", "longest")])
    outer = ends.filter(F.col("_n") > 0).select(F.explode(cells).alias("_c")).select("_c.kind", f"_c._p.{u}", "_c._p.lifetime")
    return outer.unionByName(found)


# Ids of a list that is broadcast.
SHORT_LIST = 10_000


def trajectories_of(
    df: DataFrame, units: DataFrame, cols: Sequence[str], u: str = UNIT, o: str = ORDER
) -> DataFrame:
    """Plot-ready rows of chosen units.

    Up to ``SHORT_LIST`` ids are broadcast, so no trajectory is shuffled; a
    longer list meets the rows by (unit, segment).
    """
    chosen = units.select(u).distinct()
    rows = df.select(u, o, *cols)
    if chosen.limit(SHORT_LIST + 1).count() <= SHORT_LIST:
        return rows.join(F.broadcast(chosen), u, "left_semi")
    return attach_units(rows, chosen, u, o)


def target_distribution(df: DataFrame, threshold: float = 45, target: str = "rul") -> DataFrame:
    """Range, centre and counts of the target: above the threshold, and exactly zero."""
    value = F.col(target)
    plain = df.agg(
        F.min(value).cast("double").alias("min"),
        F.max(value).cast("double").alias("max"),
        F.avg(value).alias("mean"),
        F.count_if(value > threshold).alias("n_above"),
        F.count_if(value == 0).alias("n_zero"),
    )
    return plain.crossJoin(exact_median(df, target))


def padded_count(df: DataFrame, window: int, n_observed: str | Column = "n_observed") -> DataFrame:
    """How many windows hold fewer than ``window`` observed rows."""
    seen = as_column(n_observed)
    return df.agg(F.count_if(seen < window).alias("padded"), F.count(F.lit(1)).alias("windows"))


def manifest_summary(df: DataFrame, u: str = UNIT) -> DataFrame:
    """Diagnostic counts of a checkpoint manifest."""
    per_unit = df.groupBy(u).agg(F.count(F.lit(1)).alias("_n"))
    ranges = df.agg(
        F.count(F.lit(1)).alias("samples"),
        F.min("true_raw_rul").alias("min_raw_rul"),
        F.max("true_raw_rul").alias("max_raw_rul"),
        F.min("cutoff_cycle").alias("min_cutoff"),
        F.max("cutoff_cycle").alias("max_cutoff"),
        F.sort_array(F.collect_set("fraction")).alias("fractions"),
    )
    counts = per_unit.agg(F.count(F.lit(1)).alias("units"), F.min_by("_n", u).alias("samples_per_unit"))
    return ranges.crossJoin(counts)
