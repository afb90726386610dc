"""Sensor sensitivity: occlusion of features and of window positions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .models import predict, score_sequences
from .quantiles import exact_quantiles
from .segments import ORDER, SEGMENT_ROWS, UNIT, attach_units, positioned

NEAR = 13
FAR = 50


def _occluded(sensor: str, mean: Column) -> dict[str, Column]:
    """Features of a series that equals its own prefix mean everywhere."""
    zero = F.lit(0.0)
    return {
        f"{sensor}_latest": mean,
        f"{sensor}_mean": mean,
        f"{sensor}_std": zero,
        f"{sensor}_min": mean,
        f"{sensor}_max": mean,
        f"{sensor}_slope": zero,
        f"{sensor}_delta": zero,
        f"{sensor}_last5_mean": mean,
        f"{sensor}_last10_mean": mean,
    }


def occlude(
    features: DataFrame,
    sensors: Sequence[str],
    model,
    u: str = UNIT,
    y: str = "true_raw_rul",
    keep: Sequence[str] = ("fraction",),
) -> DataFrame:
    """Predictions with one sensor replaced by its mean up to the cutoff, per sensor.

    ``features`` come from ``features_at``; the replacement mean is
    ``<sensor>_prefix_mean`` when present (windowed features), else the mean
    over the full history. The occluded features have a closed form, so no
    history is read again, and one scoring pass covers all sensors.
    """
    base = predict(features, model).withColumnRenamed("prediction", "prediction_baseline")
    names = F.explode(F.array(*[F.lit(s) for s in sensors]))
    spread = base.withColumn("sensor", names)
    swapped = {}
    for s in sensors:
        own = f"{s}_prefix_mean" if f"{s}_prefix_mean" in features.columns else f"{s}_mean"
        for name, value in _occluded(s, F.col(own)).items():
            if name in features.columns:
                swapped[name] = F.when(F.col("sensor") == s, value).otherwise(F.col(name))
    occluded = predict(spread.withColumns(swapped), model).withColumnRenamed(
        "prediction", "prediction_occluded"
    )
    kept = [c for c in keep if c in features.columns]
    return occluded.select(
        "sensor", u, "cutoff_cycle", *kept, y, "prediction_baseline", "prediction_occluded"
    ).withColumn("delta", F.col("prediction_occluded") - F.col("prediction_baseline"))


def occlusion_summary(deltas: DataFrame, y: str = "true_raw_rul") -> DataFrame:
    """Per sensor: mean absolute change, RMSE change, worsened shares.

    ``overpredicted_and_worsened_share`` divides by all rows.
    """
    base = F.col("prediction_baseline") - F.col(y)
    occl = F.col("prediction_occluded") - F.col(y)
    worse = F.col("delta") > 0
    return deltas.groupBy("sensor").agg(
        F.avg(F.abs("delta")).alias("mean_abs_delta"),
        (F.sqrt(F.avg(occl * occl)) - F.sqrt(F.avg(base * base))).alias("rmse_delta"),
        F.avg(worse.cast("double")).alias("worsened_share"),
        F.avg((worse & (base > 0)).cast("double")).alias("overpredicted_and_worsened_share"),
    )


def occlusion_by_fraction(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("sensor", "fraction").agg(
        F.avg(F.abs("delta")).alias("mean_abs_delta"), F.avg("delta").alias("mean_delta")
    )


def top_sensors(deltas: DataFrame, k: int = 3) -> DataFrame:
    """Most sensitive sensors per lifecycle fraction."""
    order = Window.partitionBy("fraction").orderBy(F.desc("mean_abs_delta"), "sensor")
    ranked = occlusion_by_fraction(deltas).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k)


def alignment_check(
    base: DataFrame, deltas: DataFrame, sensors: int, u: str = UNIT
) -> DataFrame:
    """Every checkpoint occurs exactly once per sensor."""
    keys = [u, "cutoff_cycle"]
    expected = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_base"))
    found = deltas.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), F.count_distinct("sensor").alias("_sensors")
    )
    joined = expected.join(found, keys, "full_outer")
    good = (F.col("_base") == 1) & (F.col("_rows") == sensors) & (F.col("_sensors") == sensors)
    return joined.agg(
        F.count(F.lit(1)).alias("checkpoints"),
        F.count_if(~F.coalesce(good, F.lit(False))).alias("misaligned"),
    ).withColumn("passed", F.col("misaligned") == 0)


def _window_weight(w: int) -> Column:
    """In how many full windows of the unit a row occurs."""
    pos, last = F.col("_pos"), F.col("_last")
    return F.greatest(
        F.least(pos, last - pos + 1, F.lit(w).cast("long"), last - w + 1), F.lit(0).cast("long")
    )


def _long_rows(df, cols, u, o, gapless, segment_rows) -> DataFrame:
    rows = positioned(df, u, o, gapless, segment_rows).select(u, "_pos", *cols)
    last = rows.groupBy(u).agg(F.max("_pos").alias("_last"))
    return attach_units(rows, last, u, "_pos", segment_rows=segment_rows, last="_last")


def background_median(
    df: DataFrame,
    cols: Sequence[str],
    w: int,
    u: str = UNIT,
    o: str = ORDER,
    gapless: bool = False,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Median per sensor over all full windows; rows are weighted, windows never built."""
    rows = _long_rows(df, cols, u, o, gapless, segment_rows).withColumn("_weight", _window_weight(w))
    long = rows.filter(F.col("_weight") > 0).select(
        "_weight",
        F.explode(F.array(*[F.struct(F.lit(c).alias("sensor"), F.col(c).cast("double").alias("value")) for c in cols])).alias("_e"),
    ).select("_weight", "_e.*")
    return exact_quantiles(
        long, "value", [0.5], by=["sensor"], weight=F.col("_weight"), out="median"
    ).drop("prob")


def position_background(
    df: DataFrame,
    cols: Sequence[str],
    w: int,
    u: str = UNIT,
    o: str = ORDER,
    gapless: bool = False,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Median per window position and sensor over all full windows."""
    rows = _long_rows(df, cols, u, o, gapless, segment_rows).filter(F.col("_last") >= w)
    low = F.greatest(F.lit(1).cast("long"), F.col("_pos") - (F.col("_last") - w))
    places = rows.withColumn("position", F.explode(F.sequence(low, F.least(F.lit(w).cast("long"), F.col("_pos")))))
    long = places.select(
        "position",
        F.explode(F.array(*[F.struct(F.lit(c).alias("sensor"), F.col(c).cast("double").alias("value")) for c in cols])).alias("_e"),
    ).select("position", "_e.*")
    return exact_quantiles(long, "value", [0.5], by=["position", "sensor"], out="median").drop("prob")


def _background_row(background: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with the medians in sensor order."""
    picks = [F.max(F.when(F.col("sensor") == c, F.col("median"))).cast("float") for c in cols]
    return background.agg(F.array(*picks).alias("_bg"))


def median_attribution(
    seqs: DataFrame,
    background: DataFrame,
    cols: Sequence[str],
    predict_batch: Callable[[np.ndarray, np.ndarray], np.ndarray],
    w: int,
    u: str = UNIT,
) -> DataFrame:
    """Per window and sensor: prediction minus prediction with the sensor at its median.

    Also gives the gap between the summed attributions and the all-median change.
    """
    k = len(cols)
    wide = seqs.crossJoin(F.broadcast(_background_row(background, cols)))
    trial = F.explode(F.sequence(F.lit(-1), F.lit(k)))
    spread = wide.withColumn("_trial", trial)
    replaced = F.transform(
        "seq",
        lambda row: F.transform(
            row,
            lambda x, i: F.when(
                (F.col("_trial") == k) | (i == F.col("_trial")), F.element_at("_bg", (i + 1).cast("int"))
            ).otherwise(x),
        ),
    )
    scored = score_sequences(
        spread.withColumn("seq", replaced).select(u, "end_cycle", "_trial", "seq", "mask"), predict_batch, w
    )
    keys = [u, "end_cycle"]
    base = F.max(F.when(F.col("_trial") == -1, F.col("prediction")))
    empty = F.max(F.when(F.col("_trial") == k, F.col("prediction")))
    single = F.struct(
        *[F.max(F.when(F.col("_trial") == i, F.col("prediction"))).alias(c) for i, c in enumerate(cols)]
    )
    per = scored.groupBy(*keys).agg(base.alias("_base"), empty.alias("_empty"), single.alias("_s"))
    deltas = {c: F.col("_base") - F.col(f"_s.{c}") for c in cols}
    total = sum(deltas.values(), F.lit(0.0))
    gap = F.abs(total - (F.col("_base") - F.col("_empty")))
    cells = F.explode(
        F.array(*[F.struct(F.lit(c).alias("sensor"), d.alias("attribution")) for c, d in deltas.items()])
    )
    return per.select(*keys, F.col("_base").alias("prediction"), gap.alias("gap"), cells.alias("_c")).select(
        *keys, "prediction", "gap", "_c.*"
    )


def attribution_summary(attributions: DataFrame, groups: DataFrame, u: str = UNIT) -> DataFrame:
    """Mean, mean absolute and spread of attributions per target group and sensor."""
    return attributions.join(groups.select(u, "group"), u).groupBy("group", "sensor").agg(
        F.count(F.lit(1)).alias("units"),
        F.avg("attribution").alias("mean_attribution"),
        F.avg(F.abs("attribution")).alias("mean_abs_attribution"),
        F.stddev_pop("attribution").alias("std_attribution"),
        F.avg("gap").alias("mean_gap"),
    )


def position_attribution(
    seqs: DataFrame,
    background: DataFrame,
    cols: Sequence[str],
    predict_batch: Callable[[np.ndarray, np.ndarray], np.ndarray],
    w: int,
    u: str = UNIT,
) -> DataFrame:
    """Prediction change when one window row is set to the medians of its position.

    ``background`` is the table of ``position_background``: ``w`` lines per sensor.
    """
    picks = [F.max(F.when(F.col("sensor") == c, F.col("median"))).cast("float") for c in cols]
    rows = background.groupBy("position").agg(F.array(*picks).alias("_bg"))
    filled = rows.unionByName(
        background.sparkSession.createDataFrame([(0,)], "position long").withColumn(
            "_bg", F.lit(None).cast("array<float>")
        )
    )
    spread = seqs.crossJoin(F.broadcast(filled))
    replaced = F.transform(
        "seq", lambda row, i: F.when(i + 1 == F.col("position"), F.col("_bg")).otherwise(row)
    )
    scored = score_sequences(
        spread.withColumn("seq", replaced).select(u, "end_cycle", "position", "seq", "mask"), predict_batch, w
    )
    keys = [u, "end_cycle"]
    base = scored.filter(F.col("position") == 0).select(*keys, F.col("prediction").alias("_base"))
    return scored.filter(F.col("position") > 0).join(base, keys).select(
        *keys, "position", (F.col("_base") - F.col("prediction")).alias("attribution")
    )


def target_groups(
    errors: DataFrame, w: int, history: str = "observed_cycles", u: str = UNIT
) -> DataFrame:
    """Late misses and accurate units among those with a full window."""
    group = F.when(F.col("error") > FAR, "late-miss").when(F.abs("error") < NEAR, "accurate")
    return errors.filter(F.col(history) >= w).select(u, group.alias("group"), "error").filter(
        F.col("group").isNotNull()
    )
