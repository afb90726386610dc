"""Mixing sources to target weights by entropy balancing.

Every document has a rate, the number of times the mix takes it. Entropy
balancing keeps the rates closest (in relative entropy, weighted by tokens) to
taking everything once, subject to one token constraint per source. The optimum
is an exponential tilt ``rate = exp(lambda[source])``; its convex dual

    sum_i size_i * exp(lambda[source_i]) - sum_s lambda[s] * target_s

is solved by Newton iterations whose gradient and curvature are sums per source,
aggregated in Spark. Rates become whole copies: in a keyed random order the
leading part of a source takes one copy more than the rest, cut where the
tokens reach the target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import n_words, small_side, written

# Weights of the sources in order, repeating, and the ceiling of a target.
WEIGHTS = (5, 2, 1)
CEILING = 3
NEWTON_ROUNDS = 40
TOLERANCE = 1e-9
ORDER_BITS = 60
BUCKET_SHIFT = 48  # the keyed order is cut into 4,096 buckets per source, of which one is walked row by row
LEVELS = 4
SEED = "mix"


def numbered_sources(sources: DataFrame, column: str = "source") -> DataFrame:
    """``sources`` with ``position`` (0-based) by code point, null last.

    The order is sorted in Spark and numbered from the partitions' counts, so no
    task holds all sources.
    """
    ordered = written(sources.orderBy(F.col(column).asc_nulls_last()), "sources")
    # code points sort as UTF-8 bytes do, and Spark compares bytes
    ranges = ordered.repartitionByRange(F.col(column).asc_nulls_last()).sortWithinPartitions(
        F.col(column).asc_nulls_last()
    )
    placed = written(
        ranges.withColumn("_part", F.spark_partition_id()).withColumn(
            "_in", F.monotonically_increasing_id() - (F.spark_partition_id().cast("long") * F.lit(1 << 33))
        ),
        "placed",
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    )
    joined = placed.join(F.broadcast(starts.select("_part", "_start")), "_part")
    return joined.withColumn("position", F.col("_start") + F.col("_in")).drop("_part", "_in", "_start")


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, ceiling: float = CEILING) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: weighted shares under a ceiling.

    Water filling: sources over ``ceiling`` times their size stop there and what
    they leave is shared again by weight, until none is above. A few sums over the
    source table per round; every round stops one source more at least. A mix of
    size 0 has targets 0.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("position", F.lit(len(weights))).cast("int") + 1)
    table = written(numbered_sources(sources).withColumn("weight", weight), "weights")
    total = float(table.agg(F.sum("source_size")).first()[0] or 0)
    cap = F.col("source_size") * F.lit(float(ceiling))
    level, stopped = 0.0, -1
    while True:
        # a source is stopped once weight * level is above its ceiling; levels only rise
        full = F.col("weight") * F.lit(level) > cap
        facts = table.agg(
            F.sum(F.when(full, cap).otherwise(0.0)),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))),
            F.count(F.when(full, 1)),
        ).first()
        if facts[2] == stopped or not facts[1]:
            break
        stopped = facts[2]
        level = max(level, (total - facts[0]) / facts[1])
    return table.withColumn("target", F.least(F.col("weight") * F.lit(level), cap)).drop("weight", "position")


def solved(table: DataFrame) -> DataFrame:
    """``table(source, source_size, target)`` with the dual optimum ``rate`` = exp(lambda).

    Gradient and curvature of the dual are ``size * exp(lambda) - target`` and
    ``size * exp(lambda)`` per source. A Newton step is bounded to 1 each way, so
    it converges from 0 whatever the target. Sources of size 0 or target 0 get rate 0.
    """

    def step(acc: Column, _: Column) -> Column:
        mass = F.col("source_size") * F.exp(acc)
        return acc - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (mass - F.col("target")) / mass))

    live = (F.col("source_size") > 0) & (F.col("target") > 0)
    start = table.withColumn("lambda", F.lit(0.0))
    for _ in range(NEWTON_ROUNDS):
        off = F.abs(F.col("source_size") * F.exp("lambda") - F.col("target")) / F.col("target")
        start = written(start.withColumn("lambda", F.when(live, step(F.col("lambda"), F.lit(0))).otherwise(0.0)), "dual")
        worst = start.agg(F.max(F.when(live, off))).first()[0]
        if worst is None or worst < TOLERANCE:
            break
    return start.withColumn("rate", F.when(live, F.least(F.exp("lambda"), F.lit(float(CEILING)))).otherwise(0.0)).drop("lambda")


def _keyed(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    # the text counts too, so rows without an id are spread like all others
    order = F.pmod(F.xxhash64(F.lit(SEED), F.col(key), F.col(text)), F.lit(1 << ORDER_BITS))
    return docs.withColumns(
        {"_size": n_words(text), "_order": order, "_source": F.col(source).cast("string")}
    )


def plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """Per source: ``source, source_size, target, rate, least, levels``.

    A document of the source is taken ``least`` times, and once more if some
    level takes it: its size is up to the level's ``_most`` and its keyed order
    below the level's ``_cut``. The first level takes documents of any size while
    they fit the tokens that remain; each further level takes later ones that
    fit what the level before left. Rows that repeat an id have one order and
    are rounded alike.
    """
    facts = written(
        _keyed(docs, key, text, source).select("_source", "_size", "_order", F.shiftright("_order", BUCKET_SHIFT).alias("_bucket")),
        "sizes",
    )
    sources = facts.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"))
    solution = solved(targets(written(sources, "sources"), weights))
    solution = written(solution.withColumn("least", F.floor("rate").cast("int")), "solution")
    quota = (F.col("rate") - F.col("least")) * F.col("source_size")
    open_ = written(
        solution.select("source", quota.alias("_quota"), F.lit(0).cast("long").alias("_from"), F.lit(1 << 62).alias("_most")),
        "open",
    )
    cuts = None
    for _ in range(LEVELS):
        level = written(_cut(facts, open_), "level")
        found = level.select("source", F.struct("_most", "_cut").alias("_level"))
        cuts = found if cuts is None else cuts.unionByName(found)
        left = F.col("_quota") - F.col("_used")
        open_ = level.select(
            "source", left.alias("_quota"), F.col("_cut").alias("_from"), F.floor(left).cast("long").alias("_most")
        )
    levels = cuts.groupBy(F.col("source").alias("_l_source")).agg(F.array_sort(F.collect_list("_level")).alias("levels"))
    return solution.join(levels, F.col("source").eqNullSafe(F.col("_l_source")), "left").drop("_l_source")


def _cut(facts: DataFrame, open_: DataFrame) -> DataFrame:
    """``open_`` with ``_cut, _used``: rows from ``_from`` below ``_cut`` and up to ``_most`` words fit the quota.

    Rows are summed per source and bucket before they are shuffled; only the
    bucket in which the quota runs out is walked row by row.
    """
    live = facts.join(small_side(open_), F.col("_source").eqNullSafe(F.col("source"))).filter(
        (F.col("_order") >= F.col("_from")) & (F.col("_size") <= F.col("_most"))
    )
    sums = live.groupBy("source", "_quota", "_bucket").agg(F.sum("_size").alias("_sum"))
    so_far = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = written(sums.withColumn("_to", F.sum("_sum").over(so_far)), "sums")
    full = sums.filter("_to <= _quota").groupBy("source").agg(
        F.max(F.shiftleft(F.col("_bucket") + 1, BUCKET_SHIFT)).alias("_full_cut"), F.max("_to").alias("_full_used")
    )
    hit = sums.filter("_to > _quota").groupBy("source").agg(F.min("_bucket").alias("_hit"))
    table = open_
    for side in (full, hit):
        side = side.withColumnRenamed("source", "_s")
        table = table.join(side, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    table = written(table, "hits")
    edge = table.filter("_hit is not null").select(
        F.col("source").alias("_e"), "_from", "_most", "_quota", "_hit", F.coalesce("_full_used", F.lit(0)).alias("_base")
    )
    inside = Window.partitionBy("_e").orderBy("_order")
    walked = (
        facts.join(small_side(edge), F.col("_source").eqNullSafe(F.col("_e")) & (F.col("_bucket") == F.col("_hit")))
        .filter((F.col("_order") >= F.col("_from")) & (F.col("_size") <= F.col("_most")))
        .groupBy("_e", "_quota", "_base", "_order")
        .agg(F.sum("_size").alias("_sum"))
        .withColumn("_to", F.col("_base") + F.sum("_sum").over(inside))
        .filter("_to <= _quota")
        .groupBy("_e")
        .agg(F.max("_order").alias("_last"), F.max("_to").alias("_walked"))
    )
    return table.join(walked, F.col("source").eqNullSafe(F.col("_e")), "left").select(
        "source",
        "_quota",
        "_most",
        F.coalesce(F.col("_last") + 1, "_full_cut", "_from").alias("_cut"),
        F.coalesce("_walked", "_full_used", F.lit(0)).alias("_used"),
    )


def _times(size: Column, order: Column, least: Column, levels: Column) -> Column:
    """How often a row is taken: as often as the rest of its source, or once more, and never above the ceiling.

    Rows without words take no part in filling the target, so they are not taken more than once.
    """
    more = F.coalesce(F.exists(levels, lambda x: (size <= x["_most"]) & (order < x["_cut"])), F.lit(False)).cast("int")
    return F.when(size > 0, F.least(least + more, F.lit(CEILING))).otherwise(F.least(least, F.lit(1))).cast("int")


def copies(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """``docs`` with ``size, source_size, target, taken, copies`` of every row.

    A null text has size 0, a null source is a source of its own. Input columns
    of those names are replaced. An empty table gives an empty one.
    """
    table = written(plan(docs, key, text, source, weights), "plan")
    table = table.select(*[F.col(c).alias(f"_p_{c}") for c in table.columns])
    kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken", "copies")]
    rows = _keyed(docs, key, text, source).join(small_side(table), F.col("_source").eqNullSafe(F.col("_p_source")))
    times = _times(F.col("_size"), F.col("_order"), F.col("_p_least"), F.col("_p_levels"))
    return rows.select(
        *kept,
        F.col("_size").alias("size"),
        F.col("_p_source_size").alias("source_size"),
        F.col("_p_target").alias("target"),
        (F.col("_size") * times).alias("taken"),
        times.alias("copies"),
    )


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with the columns of ``docs``."""
    table = written(plan(docs, key, text, source, weights), "plan")
    table = table.select(*[F.col(c).alias(f"_p_{c}") for c in table.columns])
    rows = docs.select(F.struct(*docs.columns).alias("__row"), key, text, source)
    rows = _keyed(rows, key, text, source).select("__row", "_source", "_size", "_order")
    placed = rows.join(small_side(table), F.col("_source").eqNullSafe(F.col("_p_source")))
    times = _times(F.col("_size"), F.col("_order"), F.col("_p_least"), F.col("_p_levels"))
    return placed.select("__row", F.explode(F.array_repeat(F.lit(1), times)).alias("__n")).select("__row.*")
