"""History-only features: what was known at a cycle, never anything later."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .segments import (
    HALO,
    ORDER,
    SEGMENT,
    SEGMENT_ROWS,
    UNIT,
    drop_halo,
    positioned,
    segment_of,
    segment_window,
    with_halo,
)

# Feature groups per sensor and the short recent means.
GROUPS = ("latest", "mean", "std", "min", "max", "slope", "delta", "last5_mean", "last10_mean")
LEGACY_GROUPS = ("last", "mean", "std", "min", "max", "slope", "last5", "last10")
RECENT = (5, 10)
EXTRA = ("engine_age", "history_length")


def feature_names(cols: Sequence[str]) -> list[str]:
    return [f"{c}_{g}" for g in GROUPS for c in cols] + list(EXTRA)


def _time_variance(n: Column) -> Column:
    """Population variance of n consecutive positions."""
    n = n.cast("double")
    return (n * n - 1.0) / 12.0


def dense_features(
    df: DataFrame,
    cols: Sequence[str],
    w: int | None,
    u: str = UNIT,
    o: str = ORDER,
    keep: Sequence[str] = (),
    gapless: bool = False,
    segment_rows: int = SEGMENT_ROWS,
    tasks: int | None = None,
) -> DataFrame:
    """Features at every end cycle, over the last ``w`` rows or (``None``) all earlier rows.

    ``tasks`` is the number of shuffle partitions of the windowed ones, so that a task's sorts stay
    bounded where the session's number is too small for the rows.
    """
    rows = positioned(df, u, o, gapless, segment_rows).select(
        u, o, "_pos", *keep, *[F.col(c).cast("double").alias(c) for c in cols]
    )
    if w is None:
        return _dense_full(rows, cols, u, o, keep, segment_rows)
    return _dense_windowed(rows, cols, w, u, o, keep, segment_rows, tasks)


def _recent_means(out: dict, cols: Sequence[str], ordered, seen: Column, limit: int | None) -> None:
    for k in RECENT:
        if limit is not None and limit < k:
            out.update({f"{c}_last{k}_mean": F.col(c) for c in cols})
            continue
        recent = ordered.rowsBetween(-(k - 1), 0)
        out.update(
            {f"{c}_last{k}_mean": F.when(seen >= k, F.avg(c).over(recent)).otherwise(F.col(c)) for c in cols}
        )


def _dense_windowed(rows, cols, w, u, o, keep, segment_rows, tasks=None) -> DataFrame:
    """Sliding windows whose cost per row does not depend on ``w``.

    Positions are cut into blocks of ``w``. A window is then the end of one
    block and the beginning of the next: running facts of both directions are
    kept within every block and merged per row, means, variances and slopes by
    their centred moments. No fact ever holds a row outside the window, so
    nothing is subtracted and no digits are lost beside an outlier. One shuffle
    by (unit, segment) and two sorts serve everything.
    """
    spread, _ = with_halo(rows, "_pos", w, segment_rows)
    # dealt by (unit, segment) at once: blocks lie inside, so no window shuffles again
    spread = spread.withColumn("_block", F.floor((F.col("_pos") - 1) / w))
    spread = spread.repartition(tasks, u, SEGMENT) if tasks else spread.repartition(u, SEGMENT)
    whole = Window.unboundedPreceding, 0
    block = Window.partitionBy(u, SEGMENT, "_block")
    ends = block.orderBy(F.desc("_pos")).rowsBetween(*whole)
    starts = block.orderBy("_pos").rowsBetween(*whole)
    # the same order as by position alone, and the same sort as within blocks
    along = Window.partitionBy(u, SEGMENT).orderBy("_block", "_pos")

    ending = spread.withColumns(_running(cols, ends, "e"))
    starting = ending.withColumns(_running(cols, starts, "s"))
    # a whole block needs no second part; nor does a unit's first block
    split = (F.col("_pos") > w) & (F.col("_pos") % w != 0)
    back = lambda c: F.lag(c, w - 1).over(along) if w > 1 else F.col(c)
    part = lambda c: F.when(split, back(c))
    out: dict[str, Column] = {"_seen": F.least(F.col("_pos"), F.lit(w)), "_n0": F.coalesce(part("_n_e"), F.lit(0))}
    out["_t0"] = part("_t_e")
    for c in cols:
        oldest = F.when(F.col("_pos") >= w, back(c)).otherwise(F.first(c).over(along.rowsBetween(*whole)))
        out[f"{c}_delta"] = F.col(c) - oldest
        out.update({f"_{k}0_{c}": part(f"_{k}_e_{c}") for k in ("m", "v", "k", "lo", "hi")})
    _recent_means(out, cols, along, out["_seen"], w)
    framed = drop_halo(starting.withColumns(out))

    n0, n1 = F.col("_n0").cast("double"), F.col("_n_s").cast("double")
    n = n0 + n1
    alone = F.col("_n0") == 0
    final: list[Column] = []
    for c in cols:
        m0, m1 = F.col(f"_m0_{c}"), F.col(f"_m_s_{c}")
        low = F.least(f"_lo0_{c}", f"_lo_s_{c}")
        high = F.greatest(f"_hi0_{c}", f"_hi_s_{c}")
        cross = n0 * n1 / n / n
        mean = F.when(alone, m1).otherwise(m1 + (m0 - m1) * (n0 / n))
        var = F.when(alone, F.col(f"_v_s_{c}")).otherwise(
            (n0 * F.col(f"_v0_{c}") + n1 * F.col(f"_v_s_{c}")) / n + cross * (m1 - m0) * (m1 - m0)
        )
        cov = F.when(alone, F.col(f"_k_s_{c}")).otherwise(
            (n0 * F.col(f"_k0_{c}") + n1 * F.col(f"_k_s_{c}")) / n
            + cross * (m1 - m0) * (F.col("_t_s") - F.col("_t0"))
        )
        flat = low == high
        final += [
            F.col(c).alias(f"{c}_latest"),
            F.when(flat, F.col(c)).otherwise(mean).alias(f"{c}_mean"),
            F.when(flat, F.lit(0.0)).otherwise(F.sqrt(var)).alias(f"{c}_std"),
            low.alias(f"{c}_min"),
            high.alias(f"{c}_max"),
            F.when(flat, F.lit(0.0)).otherwise(cov / _time_variance(F.col("_seen"))).alias(f"{c}_slope"),
            F.col(f"{c}_delta"),
            *[F.col(f"{c}_last{k}_mean") for k in RECENT],
        ]
    return framed.select(
        u,
        o,
        *keep,
        *final,
        F.col(o).cast("double").alias("engine_age"),
        F.col("_seen").cast("double").alias("history_length"),
    )


def dense_arrays(
    df: DataFrame,
    cols: Sequence[str],
    w: int,
    u: str = UNIT,
    o: str = ORDER,
    keep: Sequence[str] = (),
    gapless: bool = False,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """``dense_features`` of many columns with known values: the windows are cut from arrays inside the tasks.

    Spark deals and sorts the rows by (unit, segment) as it does there; a row's window
    is then the ``min(position, w)`` rows that end with it. The cost per value grows
    with ``w``, and for windows of some dozens it is a fraction of that of the window functions.
    A value that is null or not a number makes the features of its windows so.
    """
    cols, keep = list(cols), list(keep)
    rows = positioned(df, u, o, gapless, segment_rows).select(
        u, o, *keep, "_pos", *[F.col(c).cast("double").alias(c) for c in cols]
    )
    spread, _ = with_halo(rows, "_pos", w, segment_rows)
    dealt = spread.repartition(u, SEGMENT).sortWithinPartitions(u, SEGMENT, "_pos")
    plain = [u, o, *keep]
    names = [f"{c}_{g}" for c in cols for g in GROUPS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = [np.zeros(0) for _ in cols]
        for batch in batches:
            own = ~batch.column(HALO).to_numpy(zero_copy_only=False)
            seen = np.minimum(batch.column("_pos").to_numpy(), w)
            values = [batch.column(c).to_numpy(zero_copy_only=False) for c in cols]
            # windows may begin in the batch before
            values = [np.concatenate(pair) for pair in zip(before, values)]
            at = np.arange(len(batch)) + len(before[0]) if cols else np.zeros(0, int)
            before = [v[max(len(v) - (w - 1), 0) :] for v in values]
            found = np.empty((len(names), int(own.sum())))
            of = seen[own]
            for length in np.unique(of):
                mine = np.flatnonzero(of == length)
                places = at[own][mine] + np.arange(1 - length, 1)[:, None]
                for i, v in enumerate(values):
                    found[i * len(GROUPS) : (i + 1) * len(GROUPS), mine] = _of_windows(v[places])
            kept = batch.select(plain).filter(pa.array(own))
            made = [pa.array(f) for f in found]
            age = kept.column(o).cast(pa.float64())
            yield pa.RecordBatch.from_arrays([*kept.columns, *made, age, pa.array(of.astype(float))], names=[*plain, *names, *EXTRA])

    made = [StructField(n, DoubleType()) for n in (*names, *EXTRA)]
    return dealt.mapInArrow(run, StructType([*rows.select(*plain).schema.fields, *made]))


def _of_windows(values: np.ndarray) -> list[np.ndarray]:
    """The feature groups of windows of one length; a line per place, a column per window."""
    n, latest = len(values), values[-1]
    low, high, mean = values.min(axis=0), values.max(axis=0), values.mean(axis=0)
    flat, apart = low == high, values - mean
    times = np.arange(n) - (n - 1) / 2
    slope = (times @ apart) / n / ((n * n - 1) / 12) if n > 1 else np.zeros(len(latest))
    recent = [values[-k:].mean(axis=0) if n >= k else latest for k in RECENT]
    return [
        latest,
        np.where(flat, latest, mean),
        np.where(flat, 0.0, np.sqrt((apart * apart).mean(axis=0))),
        low,
        high,
        np.where(flat, 0.0, slope),
        latest - values[0],
        *recent,
    ]


def scale_features(df: DataFrame, params: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The features that columns scaled by ``params`` (one line per column) would have, from those of the plain columns."""
    # a line per column comes back
    known = {r["column"]: (r["mean"], r["scale"]) for r in params.select("column", "mean", "scale").collect()}
    out = {}
    for c in cols:
        mean, scale = known[c]
        for g in GROUPS:
            f = F.col(f"{c}_{g}")
            # differences and deviations do not hold the mean
            out[f"{c}_{g}"] = (f if g in ("std", "slope", "delta") else f - F.lit(mean)) / F.lit(scale)
    return df.withColumns(out)


def _running(cols: Sequence[str], over, side: str) -> dict[str, Column]:
    """Facts of the rows of a block up to each row, in the order of ``over``."""
    out = {f"_n_{side}": F.count(F.lit(1)).over(over), f"_t_{side}": F.avg("_pos").over(over)}
    for c in cols:
        out.update(
            {
                f"_m_{side}_{c}": F.avg(c).over(over),
                f"_v_{side}_{c}": F.var_pop(c).over(over),
                f"_k_{side}_{c}": F.covar_pop("_pos", c).over(over),
                f"_lo_{side}_{c}": F.min(c).over(over),
                f"_hi_{side}_{c}": F.max(c).over(over),
            }
        )
    return out


def _segment_facts(cols: Sequence[str]) -> list[Column]:
    """Mergeable facts of a run of rows."""
    facts = [
        F.count(F.lit(1)).alias("_n"),
        F.avg("_pos").alias("_tm"),
        F.min("_pos").alias("_from"),
    ]
    for c in cols:
        facts += [
            F.avg(c).alias(f"_m_{c}"),
            F.var_pop(c).alias(f"_v_{c}"),
            F.covar_pop("_pos", c).alias(f"_k_{c}"),
            F.min(c).alias(f"_lo_{c}"),
            F.max(c).alias(f"_hi_{c}"),
            F.min_by(c, "_pos").alias(f"_first_{c}"),
        ]
    return facts


def _with_references(facts: DataFrame, cols: Sequence[str], u: str) -> DataFrame:
    """The means of a unit's first segment: sums of later segments are taken relative to them, so they keep their digits."""
    first = Window.partitionBy(u).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, 0)
    names = {"_rt": "_tm", **{f"_r_{c}": f"_m_{c}" for c in cols}}
    return facts.withColumns({out: F.first(c).over(first) for out, c in names.items()})


def _dense_full(rows, cols, u, o, keep, segment_rows) -> DataFrame:
    """Running frames inside a segment, merged with the facts of all earlier segments."""
    spread, size = with_halo(rows, "_pos", max(RECENT) - 1, segment_rows)
    ordered = segment_window(u, "_pos")
    running = ordered.rowsBetween(Window.unboundedPreceding, 0)

    # facts of the segments before each segment; one line per segment
    facts = (
        rows.withColumn(SEGMENT, segment_of("_pos", size)).groupBy(u, SEGMENT).agg(*_segment_facts(cols))
    )
    facts = _with_references(facts, cols, u)
    earlier = Window.partitionBy(u).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    n, t = F.col("_n"), F.col("_tm") - F.col("_rt")
    before = {"_n0": F.coalesce(F.sum(n).over(earlier), F.lit(0)), "_t0": F.sum(n * t).over(earlier)}
    for c in cols:
        m = F.col(f"_m_{c}") - F.col(f"_r_{c}")
        before.update(
            {
                f"_s0_{c}": F.sum(n * m).over(earlier),
                f"_q0_{c}": F.sum(n * (F.col(f"_v_{c}") + m * m)).over(earlier),
                f"_p0_{c}": F.sum(n * (F.col(f"_k_{c}") + m * t)).over(earlier),
                f"_lo0_{c}": F.min(f"_lo_{c}").over(earlier),
                f"_hi0_{c}": F.max(f"_hi_{c}").over(earlier),
                f"_f0_{c}": F.first(f"_first_{c}").over(earlier),
            }
        )
    references = ["_rt", *[f"_r_{c}" for c in cols]]
    prior = facts.withColumns(before).select(u, SEGMENT, *before, *references)

    # halo rows feed only the recent means, so running facts skip them
    real = lambda c: F.when(~F.col("_halo"), F.col(c))
    out: dict[str, Column] = {"_n1": F.count(real("_pos")).over(running), "_t1": F.avg(real("_pos")).over(running)}
    for c in cols:
        out.update(
            {
                f"_m1_{c}": F.avg(real(c)).over(running),
                f"_v1_{c}": F.var_pop(real(c)).over(running),
                f"_k1_{c}": F.covar_pop(real("_pos"), real(c)).over(running),
                f"_lo1_{c}": F.min(real(c)).over(running),
                f"_hi1_{c}": F.max(real(c)).over(running),
                f"_f1_{c}": F.first(real(c), ignorenulls=True).over(running),
            }
        )
    _recent_means(out, cols, ordered, F.col("_pos"), None)
    here = spread.withColumns(out).filter(~F.col("_halo")).join(prior, [u, SEGMENT])
    return here.select(
        u,
        o,
        *keep,
        *_merged(cols),
        F.col(o).cast("double").alias("engine_age"),
        F.col("_pos").cast("double").alias("history_length"),
    )


def _merged(cols: Sequence[str]) -> list[Column]:
    """Final features from earlier facts (suffix 0) and facts at hand (suffix 1)."""
    n0 = F.col("_n0").cast("double")
    n1 = F.col("_n1").cast("double")
    n = n0 + n1
    alone = F.col("_n0") == 0
    final: list[Column] = []
    for c in cols:
        # earlier means relative to the unit's references, then absolute
        dm = F.when(alone, F.lit(0.0)).otherwise(F.col(f"_s0_{c}") / n0)
        dt = F.when(alone, F.lit(0.0)).otherwise(F.col("_t0") / n0)
        v0 = F.when(alone, F.lit(0.0)).otherwise(F.greatest(F.col(f"_q0_{c}") / n0 - dm * dm, F.lit(0.0)))
        k0 = F.when(alone, F.lit(0.0)).otherwise(F.col(f"_p0_{c}") / n0 - dm * dt)
        m0, t0 = dm + F.col(f"_r_{c}"), dt + F.col("_rt")
        m1, v1, k1 = F.col(f"_m1_{c}"), F.col(f"_v1_{c}"), F.col(f"_k1_{c}")
        low = F.least(F.col(f"_lo0_{c}"), F.col(f"_lo1_{c}"))
        high = F.greatest(F.col(f"_hi0_{c}"), F.col(f"_hi1_{c}"))
        flat = low == high
        cross = n0 * n1 / n / n
        mean = F.when(alone, m1).otherwise((n0 * m0 + n1 * m1) / n)
        var = F.when(alone, v1).otherwise((n0 * v0 + n1 * v1) / n + cross * (m1 - m0) * (m1 - m0))
        cov = F.when(alone, k1).otherwise(
            (n0 * k0 + n1 * k1) / n + cross * (m1 - m0) * (F.col("_t1") - t0)
        )
        first = F.coalesce(F.col(f"_f0_{c}"), F.col(f"_f1_{c}"))
        final += [
            F.col(c).alias(f"{c}_latest"),
            F.when(flat, F.col(c)).otherwise(mean).alias(f"{c}_mean"),
            F.when(flat, F.lit(0.0)).otherwise(F.sqrt(var)).alias(f"{c}_std"),
            low.alias(f"{c}_min"),
            high.alias(f"{c}_max"),
            F.when(flat, F.lit(0.0)).otherwise(cov / _time_variance(n)).alias(f"{c}_slope"),
            (F.col(c) - first).alias(f"{c}_delta"),
            *[F.col(f"{c}_last{k}_mean") for k in RECENT],
        ]
    return final


def features_at(
    df: DataFrame,
    manifest: DataFrame,
    cols: Sequence[str],
    w: int | None,
    u: str = UNIT,
    o: str = ORDER,
    gapless: bool = False,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Features of each manifest line at its ``cutoff_cycle``; manifest columns are kept.

    The manifest is spread over the one or two segments that hold the wanted
    rows, so the join key is (unit, segment) even for a very long unit. With
    full history, earlier segments enter as one pre-aggregated line each.
    """
    rows = positioned(df, u, o, gapless, segment_rows).select(
        u, F.col(o).alias("_cycle"), "_pos", *[F.col(c).cast("double").alias(c) for c in cols]
    )
    size = max(segment_rows, w or 0, max(RECENT))
    keys = manifest.select(u, "cutoff_cycle").distinct()
    if gapless:
        placed = keys.withColumn("_cut", F.col("cutoff_cycle").cast("long"))
    else:
        placed = _cut_positions(rows, keys, u, size)

    reach = w if w is not None else max(RECENT)
    first_segment = F.greatest(segment_of(F.col("_cut") - (reach - 1), size), F.lit(0))
    spread = placed.withColumn(SEGMENT, F.explode(F.sequence(first_segment, segment_of("_cut", size))))

    segmented = rows.withColumn(SEGMENT, segment_of("_pos", size))
    near = segmented.join(spread, [u, SEGMENT]).filter(F.col("_pos") <= F.col("_cut"))
    if w is not None:
        near = near.filter(F.col("_pos") > F.col("_cut") - w)

    key = [u, "cutoff_cycle"]
    aggs = [F.count(F.lit(1)).alias("_n1"), F.avg("_pos").alias("_t1"), F.max("_cut").alias("_cut")]
    for c in cols:
        aggs += [
            F.max_by(c, "_pos").alias(c),
            F.avg(c).alias(f"_m1_{c}"),
            F.var_pop(c).alias(f"_v1_{c}"),
            F.covar_pop("_pos", c).alias(f"_k1_{c}"),
            F.min(c).alias(f"_lo1_{c}"),
            F.max(c).alias(f"_hi1_{c}"),
            F.min_by(c, "_pos").alias(f"_f1_{c}"),
            *[F.avg(F.when(F.col("_pos") > F.col("_cut") - k, F.col(c))).alias(f"_r{k}_{c}") for k in RECENT],
        ]
    found = near.groupBy(*key).agg(*aggs)

    if w is None:
        found = found.join(_facts_before(segmented, placed, cols, u, size, reach), key, "left").withColumn(
            "_n0", F.coalesce("_n0", F.lit(0))
        )
    else:
        none = {"_n0": F.lit(0), "_t0": F.lit(None).cast("double"), "_rt": F.lit(None).cast("double")}
        for c in cols:
            none.update({f"_{k}0_{c}": F.lit(None).cast("double") for k in ("s", "q", "p", "lo", "hi", "f")})
            none[f"_r_{c}"] = F.lit(None).cast("double")
        found = found.withColumns(none)

    length = F.col("_n0") + F.col("_n1")
    found = found.withColumns(
        {
            f"{c}_last{k}_mean": F.when(length >= k, F.col(f"_r{k}_{c}")).otherwise(F.col(c))
            for c in cols
            for k in RECENT
        }
    )
    features = found.select(
        *key,
        *_merged(cols),
        F.col("cutoff_cycle").cast("double").alias("engine_age"),
        length.cast("double").alias("history_length"),
    )
    # a line without rows up to its cutoff must not vanish
    missing = F.concat_ws(" ", F.lit("no rows for unit"), F.col(u).cast("string"), F.lit("at"), F.col("cutoff_cycle").cast("string"))
    checked = F.when(F.col("engine_age").isNull(), F.raise_error(missing).cast("double")).otherwise(F.col("engine_age"))
    return manifest.join(features, key, "left").withColumn("engine_age", checked)


def _cut_positions(rows: DataFrame, keys: DataFrame, u: str, size: int) -> DataFrame:
    """Position of the last row at or before each cutoff, when cycles have gaps.

    Runs of rows are summarised first; only the run that straddles a cutoff is
    looked at row by row.
    """
    runs = (
        rows.withColumn(SEGMENT, segment_of("_pos", size))
        .groupBy(u, SEGMENT)
        .agg(F.min("_cycle").alias("_lo"), F.max("_cycle").alias("_hi"), F.max("_pos").alias("_last"))
    )
    met = runs.join(keys, u).filter(F.col("_lo") <= F.col("cutoff_cycle"))
    latest = met.groupBy(u, "cutoff_cycle").agg(F.max(SEGMENT).alias(SEGMENT))
    inside = (
        rows.withColumn(SEGMENT, segment_of("_pos", size))
        .join(latest, [u, SEGMENT])
        .filter(F.col("_cycle") <= F.col("cutoff_cycle"))
    )
    return inside.groupBy(u, "cutoff_cycle").agg(F.max("_pos").alias("_cut"))


def _facts_before(segmented, placed, cols, u, size, reach) -> DataFrame:
    """Merged facts of all segments that lie wholly before the rows at hand."""
    facts = _with_references(segmented.groupBy(u, SEGMENT).agg(*_segment_facts(cols)), cols, u)
    first_segment = F.greatest(segment_of(F.col("_cut") - (reach - 1), size), F.lit(0))
    wanted = placed.select(u, "cutoff_cycle", first_segment.alias("_first_segment"))
    early = facts.join(wanted, u).filter(F.col(SEGMENT) < F.col("_first_segment"))
    n, t = F.col("_n"), F.col("_tm") - F.col("_rt")
    aggs = [F.sum(n).alias("_n0"), F.sum(n * t).alias("_t0"), F.max("_rt").alias("_rt")]
    for c in cols:
        m = F.col(f"_m_{c}") - F.col(f"_r_{c}")
        aggs += [
            F.sum(n * m).alias(f"_s0_{c}"),
            F.sum(n * (F.col(f"_v_{c}") + m * m)).alias(f"_q0_{c}"),
            F.sum(n * (F.col(f"_k_{c}") + m * t)).alias(f"_p0_{c}"),
            F.max(f"_r_{c}").alias(f"_r_{c}"),
            F.min(f"_lo_{c}").alias(f"_lo0_{c}"),
            F.max(f"_hi_{c}").alias(f"_hi0_{c}"),
            F.min_by(f"_first_{c}", SEGMENT).alias(f"_f0_{c}"),
        ]
    return early.groupBy(u, "cutoff_cycle").agg(*aggs)


def legacy_features(
    df: DataFrame,
    manifest: DataFrame,
    cols: Sequence[str],
    w: int,
    u: str = UNIT,
    o: str = ORDER,
    gapless: bool = False,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """The older eight groups, computed as if short windows were padded with zeros."""
    base = features_at(df, manifest, cols, w, u, o, gapless, segment_rows)
    return zero_padded(base, cols, w, keep=manifest.columns)


def zero_padded(features: DataFrame, cols: Sequence[str], w: int, keep: Sequence[str]) -> DataFrame:
    """Rewrite windowed features as statistics of the zero-padded window of ``w`` rows.

    Padding adds ``w - n`` zeros in front, so every statistic follows from the
    observed count, mean, variance and slope; no window is built.
    """
    n = F.col("history_length")
    full = n >= w
    size = F.lit(float(w))
    out: list[Column] = []
    for c in cols:
        mean, std, slope = F.col(f"{c}_mean"), F.col(f"{c}_std"), F.col(f"{c}_slope")
        padded_mean = n * mean / size
        second = n * (std * std + mean * mean) / size
        padded_std = F.sqrt(F.greatest(second - padded_mean * padded_mean, F.lit(0.0)))
        # sum of (own index) * x over the observed rows, then shifted by the padding
        own = n * slope * _time_variance(n) + n * mean * (n - 1.0) / 2.0
        shifted = own + (size - n) * n * mean
        padded_slope = (
            (shifted - (size - 1.0) / 2.0 * n * mean) / (size * _time_variance(size))
            if w > 1
            else F.lit(None).cast("double")
        )
        out += [
            F.col(f"{c}_latest").alias(f"{c}_last"),
            F.when(full, mean).otherwise(padded_mean).alias(f"{c}_mean"),
            F.when(full, std).otherwise(padded_std).alias(f"{c}_std"),
            F.when(full, F.col(f"{c}_min")).otherwise(F.least(F.col(f"{c}_min"), F.lit(0.0))).alias(f"{c}_min"),
            F.when(full, F.col(f"{c}_max")).otherwise(F.greatest(F.col(f"{c}_max"), F.lit(0.0))).alias(f"{c}_max"),
            F.when(full, slope).otherwise(padded_slope).alias(f"{c}_slope"),
        ]
        for k in RECENT:
            recent = F.when(n >= k, F.col(f"{c}_last{k}_mean")).otherwise(n * mean / float(k))
            out.append((recent if w >= k else F.col(f"{c}_latest")).alias(f"{c}_last{k}"))
    return features.select(*keep, *out, "engine_age", "history_length")
