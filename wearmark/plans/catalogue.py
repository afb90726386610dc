"""Registered queries over the fleet views, with oracle SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import rounded, wall_micros
from ..operators import (
    boosting,
    checkpoints,
    conformal,
    errors,
    evaluate,
    features,
    fingerprint,
    leastsquares,
    models,
    profile,
    quality,
    regimes,
    scaling,
    selection,
    sensitivity,
    serving,
    sketches,
    splits,
    target,
    windows,
)
from ..operators.segments import attach_units, tasks_for
from ..session import new_table_path
from ..sources import manifests, sinks, text
from ..sources.fleets import SETTINGS, events_fleet, supplier_fleet, supplier_rows, table
from ..streaming import scorer
from . import flows
from .fragments import COMMON, WINDOWS, metric_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

COLS = ["sensor_1", "sensor_2", "sensor_3"]
ALL_SENSORS = [*COLS, "sensor_4"]
W = 30
LEGACY_W = 45
FOLDS = 4


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = COMMON + sql
        return fn

    return register


def rounding(df: DataFrame, names: Sequence[str] | None = None, digits: int = 6) -> DataFrame:
    """Round the double columns (or the named ones) for comparison."""
    names = names or [f.name for f in df.schema if f.dataType.simpleString() == "double"]
    return df.withColumns({n: rounded(n, digits) for n in names})


# ---- formula predictors: the same arithmetic is written in the oracle ----

MIXED = models.FormulaModel(
    66.0,
    {
        "engine_age": -0.93,
        "sensor_1_mean": 0.0217,
        "sensor_1_std": 0.1317,
        "sensor_2_latest": 0.0113,
        "sensor_2_slope": 0.7391,
    },
)
CANDIDATES = {
    "age": models.FormulaModel(66.0, {"engine_age": -0.93, "sensor_1_std": 0.1317}),
    "mixed": MIXED,
    "shallow": models.FormulaModel(52.0, {"engine_age": -0.61, "sensor_2_std": 0.1931}),
}


def raw_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as an unchecked trajectory: the cycle is the hour, so cycles repeat."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("unit_id"),
        F.floor(wall_micros("ts") / 3_600_000_000).alias("cycle"),
        F.col("value").alias("sensor_1"),
        F.get_json_object("props", "$.k").cast("double").alias("sensor_2"),
        F.lit(1.0).alias("sensor_4"),
        F.col("event_id").alias("row_idx"),
    )


def event_lifetimes(spark: SparkSession, sf: str) -> DataFrame:
    """Lifetimes of the events fleet straight from row counts (cycles are gapless)."""
    return (
        table(spark, sf, "events")
        .groupBy(F.col("user_id").alias("unit_id"))
        .agg(F.count(F.lit(1)).alias("lifetime"))
    )


def event_manifest(spark, sf, fractions=checkpoints.BALANCED_FRACTIONS) -> DataFrame:
    return checkpoints.checkpoint_manifest(event_lifetimes(spark, sf), fractions)


def split3(spark, sf) -> DataFrame:
    return splits.split_units(event_lifetimes(spark, sf), splits.THREE_WAY)


def dev_folds(spark, sf) -> DataFrame:
    roles = split3(spark, sf)
    dev = roles.filter(F.col("role") != "calibration").select("unit_id")
    return splits.group_folds(dev, FOLDS, strict=False)


def inner_stop():
    """A seventh of the training units stop early, at least one."""
    return F.greatest(F.floor(F.col("_n") / 7), F.lit(1))


def inner_roles(assignments: DataFrame) -> DataFrame:
    return splits.inner_split(assignments, inner_stop())


def event_features(spark, sf, w=W, cols=("sensor_1", "sensor_2")) -> DataFrame:
    return features.features_at(
        events_fleet(spark, sf), event_manifest(spark, sf), list(cols), w, gapless=True
    )


def event_predictions(spark, sf) -> DataFrame:
    return models.predict(event_features(spark, sf), MIXED).select(
        "unit_id", "full_lifetime", "cutoff_cycle", "true_raw_rul", "fraction", "prediction"
    )


def candidate_predictions(spark, sf) -> DataFrame:
    """All candidates scored from one feature table, as a stack of columns."""
    base = event_features(spark, sf)
    for name, model in CANDIDATES.items():
        base = models.predict(base, model).withColumnRenamed("prediction", f"_{name}")
    cells = F.explode(
        F.array(
            *[F.struct(F.lit(n).alias("candidate_id"), F.col(f"_{n}").alias("prediction")) for n in CANDIDATES]
        )
    )
    return base.select("unit_id", "cutoff_cycle", "true_raw_rul", "fraction", cells.alias("_c")).select(
        "_c.*", "unit_id", "cutoff_cycle", "true_raw_rul", "fraction"
    )


def fold_predictions(spark, sf) -> DataFrame:
    return candidate_predictions(spark, sf).join(dev_folds(spark, sf), "unit_id")


def fold_table(spark, sf) -> DataFrame:
    return evaluate.fold_rows(fold_predictions(spark, sf))


def summary(spark, sf) -> DataFrame:
    return selection.cv_summary(fold_table(spark, sf))


def calibration(spark, sf) -> DataFrame:
    roles = split3(spark, sf).filter(F.col("role") == "calibration")
    return event_predictions(spark, sf).join(roles.select("unit_id"), "unit_id")


def unit_scores(spark, sf) -> DataFrame:
    return conformal.cluster_scores(calibration(spark, sf))


def row_scores(spark, sf) -> DataFrame:
    return calibration(spark, sf).select(
        "unit_id", F.abs(F.col("prediction") - F.col("true_raw_rul")).alias("score")
    )


def terminal_predictions(spark, sf) -> DataFrame:
    """Units cut at 65 % of life: observed history, true remaining life, prediction."""
    return (
        event_predictions(spark, sf)
        .filter(F.col("fraction") == 0.65)
        .select(
            "unit_id",
            F.col("cutoff_cycle").alias("observed_cycles"),
            F.col("true_raw_rul").alias("true_rul"),
            "prediction",
            F.col("full_lifetime").alias("implied_failure_cycle"),
        )
    )


def validation_predictions(spark, sf) -> DataFrame:
    roles = split3(spark, sf).filter(F.col("role") == "validation")
    return (
        event_predictions(spark, sf)
        .join(roles.select("unit_id"), "unit_id")
        .select(
            "unit_id",
            F.col("cutoff_cycle").alias("observed_cycles"),
            F.col("true_raw_rul").alias("true_rul"),
            "prediction",
        )
    )


def samples(spark, sf) -> DataFrame:
    """Official and validation samples from one scored table: a row may be in both."""
    scored = event_predictions(spark, sf).join(split3(spark, sf), "unit_id")
    tags = F.array_compact(
        F.array(
            F.when(F.col("fraction") == 0.65, F.lit("official")),
            F.when(F.col("role") == "validation", F.lit("validation")),
        )
    )
    return scored.select(
        F.explode(tags).alias("sample"),
        "unit_id",
        F.col("cutoff_cycle").alias("observed_cycles"),
        F.col("true_raw_rul").alias("true_rul"),
        "prediction",
    )


# ---- fleet views -------------------------------------------------------------


@query("SELECT * REPLACE (round(sensor_3, 6) AS sensor_3) FROM ev")
def fleet_view_events(spark, sf):
    return rounding(events_fleet(spark, sf), ["sensor_3"])


@query("SELECT * FROM sup")
def fleet_view_suppliers(spark, sf):
    return supplier_fleet(spark, sf)


# ---- quality -----------------------------------------------------------------

QUALITY_SQL = """, facts AS (
  SELECT sum((cycle IS NULL)::INT + (sensor_1 IS NULL)::INT + (sensor_2 IS NULL)::INT)::BIGINT AS missing,
         sum((isinf(sensor_1))::INT + (isinf(sensor_2))::INT)::BIGINT AS infinite,
         count(*) - count(DISTINCT (unit_id, cycle)) AS extra,
         (SELECT count(*) FROM (SELECT cycle - lag(cycle) OVER (PARTITION BY unit_id ORDER BY row_idx) AS step
                                FROM raw) WHERE step < 1) AS breaks,
         count(DISTINCT unit_id) AS units, min(unit_id) AS first, max(unit_id) AS final
  FROM raw
), report AS (
  SELECT 'column_count' AS "check", true AS passed, '5' AS observed
  UNION ALL SELECT 'all_numeric', true, '0'
  UNION ALL SELECT 'no_missing', missing = 0, missing::VARCHAR FROM facts
  UNION ALL SELECT 'no_infinite', infinite = 0, infinite::VARCHAR FROM facts
  UNION ALL SELECT 'no_empty_column', true, '0'
  UNION ALL SELECT 'no_duplicate_cycle', extra = 0, extra::VARCHAR FROM facts
  UNION ALL SELECT 'cycles_increase', breaks = 0, breaks::VARCHAR FROM facts
  UNION ALL SELECT 'ids_start_at_one', first = 1, first::VARCHAR FROM facts
  UNION ALL SELECT 'ids_contiguous', units = final, units::VARCHAR FROM facts
  UNION ALL SELECT 'unit_count', units = 100, units::VARCHAR FROM facts
)
"""


@query(QUALITY_SQL + "SELECT * FROM report")
def quality_report(spark, sf):
    return quality.validate_trajectories(raw_events(spark, sf), expected=100)


@query(QUALITY_SQL + "SELECT bool_and(passed) AS passed, count(*) FILTER (NOT passed) AS failed FROM report")
def quality_verdict(spark, sf):
    return quality.report_passed(quality.validate_trajectories(raw_events(spark, sf), expected=100))


@query(
    """SELECT * FROM (
  SELECT 'sensor_1' AS "column", count(sensor_1) AS present, 0::BIGINT AS missing, 0::BIGINT AS infinite,
         min(sensor_1) AS low, max(sensor_1) AS high, min(sensor_1) = max(sensor_1) AS is_constant,
         false AS is_empty FROM ev
  UNION ALL SELECT 'sensor_2', count(sensor_2), 0, 0, min(sensor_2), max(sensor_2),
         min(sensor_2) = max(sensor_2), false FROM ev
  UNION ALL SELECT 'sensor_4', count(sensor_4), 0, 0, min(sensor_4), max(sensor_4), true, false FROM ev)"""
)
def column_profile(spark, sf):
    return quality.column_profile(events_fleet(spark, sf), ["sensor_1", "sensor_2", "sensor_4"])


@query(
    """SELECT "column", low FROM (
  SELECT 'sensor_' || unnest([1, 2, 3, 4]) AS "column",
         unnest([min(sensor_1), min(sensor_2), min(sensor_3), min(sensor_4)]) AS low,
         unnest([max(sensor_1), max(sensor_2), max(sensor_3), max(sensor_4)]) AS high FROM ev)
WHERE low = high"""
)
def constant_columns(spark, sf):
    return quality.constant_columns(events_fleet(spark, sf), ALL_SENSORS)


@query(
    "SELECT unit_id, cycle, count(*) - 1 AS extra_rows FROM raw GROUP BY unit_id, cycle HAVING count(*) > 1"
)
def duplicate_cycles(spark, sf):
    return quality.duplicate_rows(raw_events(spark, sf))


@query(
    """SELECT unit_id, count(*) FILTER (step < 1) AS breaks FROM (
  SELECT unit_id, cycle - lag(cycle) OVER (PARTITION BY unit_id ORDER BY row_idx) AS step FROM raw)
GROUP BY unit_id"""
)
def cycle_order(spark, sf):
    return quality.order_breaks(raw_events(spark, sf))


@query(
    """SELECT 'label_count' AS "check", count(*) = 100 AS passed, count(*)::VARCHAR AS observed FROM life
UNION ALL SELECT 'labels_positive_integers', bool_and(lifetime > 0), bool_and(lifetime > 0)::VARCHAR FROM life"""
)
def label_check(spark, sf):
    labels = event_lifetimes(spark, sf).withColumnRenamed("lifetime", "true_rul")
    return quality.validate_labels(labels, expected=100)


@query(
    """SELECT dataset, kind, expected_units, units, expected_units = units AS passed
FROM (VALUES ('FD001', 'train', 100), ('FD001', 'test', 100), ('FD002', 'train', 260), ('FD002', 'test', 259),
             ('FD003', 'train', 100), ('FD003', 'test', 100), ('FD004', 'train', 249), ('FD004', 'test', 248))
     e(dataset, kind, expected_units), (SELECT count(DISTINCT unit_id) AS units FROM raw)"""
)
def cardinality_check(spark, sf):
    units = raw_events(spark, sf).agg(F.count_distinct("unit_id").alias("units"))
    return quality.expected_units(spark).crossJoin(F.broadcast(units)).withColumn(
        "passed", F.col("expected_units") == F.col("units")
    )


# ---- profile -----------------------------------------------------------------


@query("SELECT * FROM life")
def lifetimes(spark, sf):
    return profile.lifetimes(events_fleet(spark, sf))


@query(
    """SELECT count(*) AS units, sum(rows)::BIGINT AS rows, min(l) AS min_lifetime, max(l) AS max_lifetime,
  round(avg(l), 6) AS mean_lifetime, median(l)::DOUBLE AS median_lifetime, round(stddev_samp(l), 6) AS std_lifetime
FROM (SELECT unit_id, max(cycle)::BIGINT AS l, count(*) AS rows FROM ev GROUP BY unit_id)"""
)
def fleet_summary(spark, sf):
    return rounding(profile.fleet_summary(events_fleet(spark, sf)))


@query(
    """SELECT 'sensor_' || i AS sensor, round(s, 4) AS std FROM (
  SELECT unnest([1, 2, 3, 4]) AS i,
         unnest([stddev_samp(sensor_1), stddev_samp(sensor_2), stddev_samp(sensor_3), stddev_samp(sensor_4)]) AS s
  FROM sup)"""
)
def sensor_std(spark, sf):
    return rounding(profile.sensor_std(supplier_fleet(spark, sf), ALL_SENSORS), digits=4)


@query(
    """SELECT sensor, round(std, 4) AS std, std > 1e-12 AS varying FROM (
  SELECT 'sensor_' || unnest([1, 2, 3, 4]) AS sensor,
         unnest([stddev_samp(sensor_1), stddev_samp(sensor_2), stddev_samp(sensor_3), stddev_samp(sensor_4)]) AS std
  FROM ev JOIN split2 USING (unit_id) WHERE role = 'train')"""
)
def varying_sensors(spark, sf):
    roles = splits.split_units(event_lifetimes(spark, sf))
    rows = splits.rows_for(events_fleet(spark, sf), roles, "train")
    return rounding(profile.varying_sensors(rows, ALL_SENSORS), ["std"], 4)


@query(
    """SELECT sensor, round(c, 6) + 0.0 AS corr FROM (
  SELECT 'sensor_' || unnest([1, 2, 3]) AS sensor,
         unnest([corr(sensor_1, rul), corr(sensor_2, rul), corr(sensor_3, rul)]) AS c FROM evr)"""
)
def sensor_rul_corr(spark, sf):
    return rounding(profile.sensor_target_corr(target.add_target(events_fleet(spark, sf)), ALL_SENSORS))


@query(
    """, c AS (
  SELECT corr(sensor_1, rul) AS r1, corr(sensor_2, rul) AS r2, corr(sensor_3, rul) AS r3,
         corr(sensor_1, sensor_2) AS c12, corr(sensor_1, sensor_3) AS c13, corr(sensor_2, sensor_3) AS c23 FROM evr
), top AS (
  SELECT s FROM (SELECT unnest(['sensor_1', 'sensor_2', 'sensor_3']) AS s, abs(unnest([r1, r2, r3])) AS r FROM c)
  ORDER BY r DESC, s LIMIT 5
), pairs AS (
  SELECT unnest(['sensor_1', 'sensor_2', 'sensor_3', 'sensor_1', 'sensor_2', 'sensor_1', 'sensor_3', 'sensor_2', 'sensor_3']) AS a,
         unnest(['sensor_1', 'sensor_2', 'sensor_3', 'sensor_2', 'sensor_1', 'sensor_3', 'sensor_1', 'sensor_3', 'sensor_2']) AS b,
         unnest([1, 1, 1, c12, c12, c13, c13, c23, c23]) AS corr FROM c
)
SELECT a, b, round(corr, 6) + 0.0 AS corr FROM pairs WHERE a IN (FROM top) AND b IN (FROM top)"""
)
def sensor_corr_matrix(spark, sf):
    rows = target.add_target(events_fleet(spark, sf))
    return rounding(profile.top_corr_matrix(rows, COLS, k=5))


@query(
    """SELECT 'setting_' || unnest([1, 2, 3]) AS setting,
  round(unnest([stddev_samp(setting_1), stddev_samp(setting_2), stddev_samp(setting_3)]), 6) AS std,
  unnest([count(DISTINCT setting_1), count(DISTINCT setting_2), count(DISTINCT setting_3)]) AS distinct_values
FROM sup"""
)
def setting_profile(spark, sf):
    return rounding(profile.distinct_and_std(supplier_fleet(spark, sf), SETTINGS))


@query(
    """SELECT count(*) AS count, round(avg(rul), 6) AS mean, round(stddev_samp(rul), 6) AS std,
  min(rul)::DOUBLE AS min, max(rul)::DOUBLE AS max, quantile_cont(rul::DOUBLE, 0.25) AS q25,
  quantile_cont(rul::DOUBLE, 0.5) AS q50, quantile_cont(rul::DOUBLE, 0.75) AS q75 FROM evr"""
)
def rul_describe(spark, sf):
    return rounding(profile.describe(target.add_target(events_fleet(spark, sf)), "rul"))


@query(
    """SELECT round(quantile_cont(sensor_2, 0.01), 4) AS q01, round(quantile_cont(sensor_2, 0.5), 4) AS q50,
  round(quantile_cont(sensor_2, 0.999), 4) AS q999 FROM sup"""
)
def price_quantiles(spark, sf):
    q = profile.exact_quantiles(supplier_fleet(spark, sf), "sensor_2", [0.01, 0.5, 0.999])
    return rounding(
        q.agg(
            *[
                F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n)
                for p, n in ((0.01, "q01"), (0.5, "q50"), (0.999, "q999"))
            ]
        ),
        digits=4,
    )


@query(
    """, r AS (SELECT min(lifetime)::DOUBLE AS low, max(lifetime)::DOUBLE AS high FROM life),
b AS (SELECT unnest(range(1, 16)) AS bin),
h AS (SELECT least(floor((lifetime - low) / (high - low) * 15) + 1, 15)::BIGINT AS bin, count(*) AS n
      FROM life, r GROUP BY 1)
SELECT b.bin, round(low + (high - low) / 15 * (b.bin - 1), 6) AS lower,
  round(low + (high - low) / 15 * b.bin, 6) AS upper, coalesce(n, 0) AS n
FROM b CROSS JOIN r LEFT JOIN h ON h.bin = b.bin"""
)
def lifetime_histogram(spark, sf):
    return rounding(profile.histogram(event_lifetimes(spark, sf), "lifetime", 15))


@query(
    """, o AS (SELECT *, row_number() OVER (ORDER BY lifetime, unit_id) AS r, count(*) OVER () AS n FROM life)
SELECT 'shortest' AS kind, unit_id, lifetime FROM o WHERE r = 1
UNION ALL SELECT 'middle', unit_id, lifetime FROM o WHERE r = n // 2 + 1
UNION ALL SELECT 'longest', unit_id, lifetime FROM o WHERE r = n"""
)
def representative_units(spark, sf):
    return profile.representative_units(event_lifetimes(spark, sf))


@query(
    """, o AS (SELECT *, row_number() OVER (ORDER BY lifetime, unit_id) AS r, count(*) OVER () AS n FROM life)
SELECT unit_id, cycle, sensor_1, sensor_2 FROM ev
WHERE unit_id IN (SELECT unit_id FROM o WHERE r = 1 OR r = n // 2 + 1 OR r = n)"""
)
def representative_trajectories(spark, sf):
    chosen = profile.representative_units(event_lifetimes(spark, sf))
    return profile.trajectories_of(events_fleet(spark, sf), chosen, ["sensor_1", "sensor_2"])


@query(
    """SELECT min(rul)::DOUBLE AS min, max(rul)::DOUBLE AS max, round(avg(rul), 6) AS mean,
  count(*) FILTER (rul > 45) AS n_above, count(*) FILTER (rul = 0) AS n_zero, median(rul)::DOUBLE AS median FROM evr"""
)
def target_distribution(spark, sf):
    return rounding(profile.target_distribution(target.add_target(events_fleet(spark, sf))))


@query(
    """SELECT count(*) AS samples, min(true_raw_rul) AS min_raw_rul, max(true_raw_rul) AS max_raw_rul,
  min(cutoff_cycle) AS min_cutoff, max(cutoff_cycle) AS max_cutoff,
  (SELECT string_agg(printf('%g', fraction), ',' ORDER BY fraction) FROM fractions) AS fractions,
  count(DISTINCT unit_id) AS units, 5::BIGINT AS samples_per_unit FROM man"""
)
def manifest_summary(spark, sf):
    s = profile.manifest_summary(event_manifest(spark, sf))
    return s.withColumn(
        "fractions", F.array_join(F.transform("fractions", lambda f: f.cast("string")), ",")
    )


@query(
    "SELECT count(*) FILTER (least(cycle, 30) < 30) AS padded, count(*) AS windows FROM ev"
)
def padded_window_count(spark, sf):
    rows = events_fleet(spark, sf).select(F.least(F.col("cycle"), F.lit(W)).alias("n_observed"))
    return profile.padded_count(rows, W)


# ---- targets -----------------------------------------------------------------


@query("SELECT unit_id, cycle, rul FROM evr")
def raw_rul(spark, sf):
    return target.add_target(events_fleet(spark, sf)).select("unit_id", "cycle", "rul")


@query(
    """SELECT unit_id, cycle, least(lifetime - cycle, 45)::BIGINT AS rul
FROM sup JOIN suplife USING (unit_id)"""
)
def capped_rul(spark, sf):
    return target.add_target(supplier_fleet(spark, sf), "capped", 45).select("unit_id", "cycle", "rul")


@query(
    """SELECT unit_id, observed_cycles, true_rul, observed_cycles + true_rul AS implied_failure_cycle FROM cuts"""
)
def implied_failure_cycle(spark, sf):
    cuts = event_manifest(spark, sf).filter(F.col("fraction") == 0.65)
    fleet = events_fleet(spark, sf).select("unit_id", "cycle")
    seen = attach_units(fleet, cuts.select("unit_id", "cutoff_cycle")).filter(
        F.col("cycle") <= F.col("cutoff_cycle")
    )
    labels = cuts.select("unit_id", F.col("true_raw_rul").alias("true_rul"))
    return target.implied_failure_cycle(target.observed_history(seen), labels)


# ---- splits ------------------------------------------------------------------


@query("SELECT * FROM split2")
def split_two_way(spark, sf):
    return splits.split_units(event_lifetimes(spark, sf))


@query("SELECT * FROM split3")
def split_three_way(spark, sf):
    return split3(spark, sf)


@query("SELECT * FROM dev")
def development_units(spark, sf):
    roles = split3(spark, sf)
    return splits.development_units(roles, roles.filter(F.col("role") == "calibration"))


@query("SELECT unit_id, fold::INT AS fold FROM folds")
def group_folds(spark, sf):
    return dev_folds(spark, sf)


@query("SELECT unit_id, fold::INT AS fold, role FROM assigned")
def fold_assignments(spark, sf):
    return splits.fold_assignments(dev_folds(spark, sf), FOLDS)


@query("SELECT unit_id, fold::INT AS fold, role FROM inner_roles")
def nested_inner_split(spark, sf):
    return inner_roles(splits.fold_assignments(dev_folds(spark, sf), FOLDS))


@query(
    """, rows AS (SELECT unit_id, cycle, sensor_1 FROM ev JOIN split3 USING (unit_id) WHERE role = 'validation')
SELECT * FROM rows"""
)
def rows_for_role(spark, sf):
    rows = splits.rows_for(events_fleet(spark, sf), split3(spark, sf), "validation")
    return rows.select("unit_id", "cycle", "sensor_1")


@query(
    """SELECT "check", n = 0 AS passed, n AS offending FROM (
  SELECT 'roles_disjoint' AS "check", count(*) AS n FROM (
    SELECT unit_id, fold FROM assigned GROUP BY ALL HAVING count(DISTINCT role) > 1)
  UNION ALL SELECT 'all_units_assigned', count(*) FROM (SELECT unit_id FROM dev EXCEPT SELECT unit_id FROM assigned)
  UNION ALL SELECT 'no_unknown_units', count(*) FROM (SELECT unit_id FROM assigned EXCEPT SELECT unit_id FROM dev)
  UNION ALL SELECT 'calibration_untouched', count(*) FROM (
    SELECT unit_id FROM assigned WHERE role = 'outer_train'
    INTERSECT SELECT unit_id FROM split3 WHERE role = 'calibration'))"""
)
def split_guards(spark, sf):
    roles = split3(spark, sf)
    folds = dev_folds(spark, sf)
    return splits.check_assignments(
        splits.fold_assignments(folds, FOLDS),
        roles.filter(F.col("role") != "calibration").select("unit_id"),
        roles.filter(F.col("role") == "calibration").select("unit_id"),
    )


@query("SELECT unit_id FROM split3 WHERE role IN ('train', 'validation')")
def final_fit_units(spark, sf):
    return splits.final_fit_units(split3(spark, sf))


@query(
    """SELECT count(*) AS ids, sha256('[' || string_agg(unit_id::VARCHAR, ',' ORDER BY unit_id) || ']') AS sha256
FROM dev"""
)
def id_set_hash(spark, sf):
    roles = split3(spark, sf)
    return fingerprint.id_set_hash(roles.filter(F.col("role") != "calibration"))


# ---- checkpoints -------------------------------------------------------------


@query("SELECT * FROM man")
def checkpoint_manifest(spark, sf):
    return checkpoints.checkpoint_manifest(profile.lifetimes(events_fleet(spark, sf)))


@query(
    """SELECT unit_id, lifetime AS full_lifetime,
  least(greatest(round_even(fraction * lifetime, 0)::BIGINT, 1), lifetime - 1) AS cutoff_cycle,
  lifetime - least(greatest(round_even(fraction * lifetime, 0)::BIGINT, 1), lifetime - 1) AS true_raw_rul, fraction
FROM suplife CROSS JOIN late_fractions"""
)
def supplier_checkpoints(spark, sf):
    counted = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_suppkey").alias("unit_id"))
        .agg(F.count(F.lit(1)).alias("lifetime"))
    )
    return checkpoints.checkpoint_manifest(counted, checkpoints.LATE_FRACTIONS)


@query(
    """SELECT "check", n = 0 AS passed, n AS offending FROM (
  SELECT 'cutoff_at_least_one' AS "check", count(*) FILTER (cutoff_cycle < 1) AS n FROM man
  UNION ALL SELECT 'cutoff_before_end', count(*) FILTER (cutoff_cycle >= full_lifetime) FROM man
  UNION ALL SELECT 'rul_identity', count(*) FILTER (true_raw_rul <> full_lifetime - cutoff_cycle) FROM man
  UNION ALL SELECT 'cutoffs_unique', count(*) - count(DISTINCT (unit_id, cutoff_cycle)) FROM man)"""
)
def manifest_checks(spark, sf):
    return checkpoints.check_manifest(event_manifest(spark, sf))


@query(
    """SELECT man.*, fold::INT AS fold, role FROM man JOIN assigned USING (unit_id) WHERE role = 'outer_eval'"""
)
def fold_manifests(spark, sf):
    assignments = splits.fold_assignments(dev_folds(spark, sf), FOLDS)
    return checkpoints.manifests_by_role(event_lifetimes(spark, sf), assignments)


@query("SELECT unit_id, lifetime AS cutoff_cycle FROM life")
def terminal_manifest(spark, sf):
    return checkpoints.terminal_manifest(events_fleet(spark, sf))


@query(
    """SELECT *, 'left' AS side FROM (SELECT * FROM man EXCEPT ALL SELECT * FROM latman)
UNION ALL SELECT *, 'right' AS side FROM (SELECT * FROM latman EXCEPT ALL SELECT * FROM man)"""
)
def manifest_diff(spark, sf):
    return checkpoints.manifest_diff(
        event_manifest(spark, sf), event_manifest(spark, sf, checkpoints.LATE_FRACTIONS)
    )


@query(
    """SELECT unit_id, full_lifetime, cutoff_cycle + 20 AS cutoff_cycle, true_raw_rul, fraction
FROM man WHERE cutoff_cycle + 20 > full_lifetime"""
)
def cutoff_guard(spark, sf):
    """Cutoffs moved 20 cycles ahead: those beyond the history must be reported."""
    manifest = event_manifest(spark, sf).withColumn("cutoff_cycle", F.col("cutoff_cycle") + 20)
    return windows.check_cutoffs(manifest, events_fleet(spark, sf))


# ---- scaling and regimes -----------------------------------------------------

SCALER_SQL = """
  SELECT 'sensor_' || unnest([1, 2, 3, 4]) AS "column", count(*) AS n,
         unnest([avg(sensor_1), avg(sensor_2), avg(sensor_3), avg(sensor_4)]) AS mean,
         unnest([stddev_pop(sensor_1), stddev_pop(sensor_2), stddev_pop(sensor_3), stddev_pop(sensor_4)]) AS scale
"""


@query(
    f"""SELECT "column", n, round(mean, 4) AS mean, round(CASE WHEN scale < 1e-9 THEN 1 ELSE scale END, 4) AS scale
FROM ({SCALER_SQL} FROM ev JOIN split2 USING (unit_id) WHERE role = 'train')"""
)
def scaler_params(spark, sf):
    roles = splits.split_units(event_lifetimes(spark, sf))
    rows = splits.rows_for(events_fleet(spark, sf), roles, "train")
    return rounding(scaling.fit_scaler(rows, ALL_SENSORS), digits=4)


@query(
    """SELECT unit_id, cycle, round((sensor_1 - m1) / d1, 6) + 0.0 AS sensor_1,
  round((sensor_2 - m2) / d2, 6) + 0.0 AS sensor_2
FROM (SELECT *, avg(sensor_1) OVER () AS m1, stddev_pop(sensor_1) OVER () AS d1,
        avg(sensor_2) OVER () AS m2, stddev_pop(sensor_2) OVER () AS d2 FROM sup)"""
)
def scaled_rows(spark, sf):
    fleet = supplier_fleet(spark, sf)
    cols = ["sensor_1", "sensor_2"]
    scaled = scaling.apply_scaler(fleet, scaling.fit_scaler(fleet, cols), cols)
    return rounding(scaled.select("unit_id", "cycle", *cols))


@query(
    f"""SELECT fold::INT AS fold, role, "column", n, round(mean, 4) AS mean,
  round(CASE WHEN scale < 1e-9 THEN 1 ELSE scale END, 4) AS scale FROM (
  {SCALER_SQL}, fold, role FROM ev JOIN assigned USING (unit_id) WHERE role = 'outer_train' GROUP BY fold, role)"""
)
def fold_scaler_params(spark, sf):
    assignments = splits.fold_assignments(dev_folds(spark, sf), FOLDS)
    return rounding(scaling.fold_scalers(events_fleet(spark, sf), assignments, ALL_SENSORS), digits=4)


@query(
    """, p AS (SELECT setting_2, avg(sensor_1) AS m1, stddev_pop(sensor_1) AS d1, avg(sensor_3) AS m3,
  stddev_pop(sensor_3) AS d3 FROM sup GROUP BY setting_2)
SELECT unit_id, cycle, setting_2::INT AS regime, round((sensor_1 - m1) / d1, 6) + 0.0 AS sensor_1,
  round((sensor_3 - m3) / d3, 6) + 0.0 AS sensor_3,
  (setting_2 = 1)::INT::DOUBLE AS regime_1, (setting_2 = 3)::INT::DOUBLE AS regime_3
FROM sup JOIN p USING (setting_2)"""
)
def regime_scaled_rows(spark, sf):
    fleet = supplier_fleet(spark, sf).withColumn("regime", F.col("setting_2").cast("int"))
    cols = ["sensor_1", "sensor_3"]
    scaled = scaling.apply_scaler(fleet, scaling.fit_scaler(fleet, cols, ["regime"]), cols, ["regime"])
    hot = regimes.one_hot_regime(scaled, 4)
    return rounding(hot.select("unit_id", "cycle", "regime", *cols, "regime_1", "regime_3"))


@query()
def kmeans_regimes(spark, sf):
    """Ten starts, the regimes of the best one."""
    fleet = supplier_fleet(spark, sf)
    model = regimes.fit_regimes(fleet, SETTINGS, k=6)
    labelled = regimes.assign_regime(fleet, model, SETTINGS)
    return labelled.groupBy("regime").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("setting_1").alias("setting_1"), F.avg("setting_2").alias("setting_2")
    )


@query(
    """SELECT unit_id, cycle, round((sensor_1 - m1) / d1, 6) + 0.0 AS sensor_1,
  round((sensor_2 - m2) / d2, 6) + 0.0 AS sensor_2
FROM (SELECT *, avg(sensor_1) OVER () AS m1, stddev_pop(sensor_1) OVER () AS d1,
        avg(sensor_2) OVER () AS m2, stddev_pop(sensor_2) OVER () AS d2 FROM ev)"""
)
def variant_matrix_a(spark, sf):
    fleet = events_fleet(spark, sf)
    pre = regimes.fit_variant(fleet, "A", ["sensor_1", "sensor_2"], SETTINGS)
    return rounding(regimes.variant_matrix(fleet, pre).select("unit_id", "cycle", *pre.inputs))


@query(
    """SELECT unit_id, cycle, round((sensor_1 - m1) / d1, 6) + 0.0 AS sensor_1,
  round((setting_1 - m2) / d2, 6) + 0.0 AS setting_1
FROM (SELECT *, avg(sensor_1) OVER () AS m1, stddev_pop(sensor_1) OVER () AS d1,
        avg(setting_1) OVER () AS m2, stddev_pop(setting_1) OVER () AS d2 FROM sup)"""
)
def variant_matrix_b(spark, sf):
    fleet = supplier_fleet(spark, sf)
    pre = regimes.fit_variant(fleet, "B", ["sensor_1"], ["setting_1"])
    return rounding(regimes.variant_matrix(fleet, pre).select("unit_id", "cycle", *pre.inputs))


def _variant(spark, sf, variant: str) -> DataFrame:
    pre = regimes.fit_variant(supplier_rows(spark, sf), variant, ALL_SENSORS, SETTINGS, k=6)
    return regimes.variant_matrix(supplier_fleet(spark, sf), pre).select("unit_id", "cycle", *pre.inputs)


@query()
def variant_matrix_c(spark, sf):
    return _variant(spark, sf, "C")


@query()
def variant_matrix_d(spark, sf):
    return _variant(spark, sf, "D")


# ---- windows -----------------------------------------------------------------


def _window_sums(seqs: DataFrame, *extra: str) -> DataFrame:
    def total(i: int):
        return F.aggregate("seq", F.lit(0.0), lambda acc, row: acc + F.get(row, F.lit(i)).cast("double"))

    return seqs.select(
        "unit_id",
        "end_cycle",
        *extra,
        F.size("seq").alias("rows"),
        F.round(total(0), 3).alias("s1"),
        F.round(total(1), 3).alias("s2"),
    )


@query(
    """SELECT unit_id, end_cycle, lifetime - end_cycle AS rul, 30 AS rows, round(s1, 3) AS s1, round(s2, 3) AS s2
FROM padded_windows WHERE n_observed = 30"""
)
def full_windows(spark, sf):
    rows = target.add_target(events_fleet(spark, sf))
    seqs = windows.sequence_windows(rows, ["sensor_1", "sensor_2"], W, pad=False, keep=["rul"], gapless=True)
    return _window_sums(seqs, "rul")


@query(
    """SELECT unit_id, end_cycle, n_observed::INT AS n_observed, n_observed < 30 AS padded, 30 AS rows,
  round(s1, 3) AS s1, round(s2, 3) AS s2 FROM padded_windows"""
)
def padded_windows(spark, sf):
    seqs = windows.sequence_windows(events_fleet(spark, sf), ["sensor_1", "sensor_2"], W, gapless=True)
    return _window_sums(seqs, "n_observed", "padded")


@query(
    """SELECT unit_id, end_cycle, repeat('0', (30 - n_observed)::INT) || repeat('1', n_observed::INT) AS mask
FROM padded_windows"""
)
def window_masks(spark, sf):
    seqs = windows.sequence_windows(events_fleet(spark, sf), ["sensor_1"], W, gapless=True)
    mask = F.array_join(F.transform("mask", lambda m: m.cast("int").cast("string")), "")
    return seqs.select("unit_id", "end_cycle", mask.alias("mask"))


@query(
    """SELECT unit_id, end_cycle, lifetime AS n_cycles, n_observed::INT AS n_observed, lifetime < 30 AS padded,
  30 AS rows, round(s1, 3) AS s1, round(s2, 3) AS s2 FROM padded_windows WHERE end_cycle = lifetime"""
)
def terminal_windows(spark, sf):
    seqs = windows.terminal_windows(events_fleet(spark, sf), ["sensor_1", "sensor_2"], W, gapless=True)
    return _window_sums(seqs, "n_cycles", "n_observed", "padded")


@query("SELECT unit_id, count(*) AS full_windows FROM padded_windows WHERE n_observed = 30 GROUP BY unit_id")
def full_window_counts(spark, sf):
    seqs = windows.sequence_windows(events_fleet(spark, sf), ["sensor_1"], W, gapless=True)
    kept = windows.full_windows_only(seqs, W)
    return kept.groupBy("unit_id").agg(F.count(F.lit(1)).alias("full_windows"))


# ---- features ----------------------------------------------------------------


def _feature_list(cols, totals: bool = False) -> str:
    parts = []
    for c in cols:
        for g in features.GROUPS:
            if g == "mean" and totals:
                parts.append(f"round({c}_mean * history_length, 4) AS {c}_total")
            else:
                parts.append(f"round({c}_{g}, 6) + 0.0 AS {c}_{g}")
    return ", ".join(parts)


def with_totals(df: DataFrame, cols) -> DataFrame:
    """Means over many rows as exact totals: a mean of two-decimal values can sit on a rounding edge."""
    totals = {f"{c}_total": F.round(F.col(f"{c}_mean") * F.col("history_length"), 4) for c in cols}
    return df.withColumns(totals).drop(*[f"{c}_mean" for c in cols])


@query(
    f"""SELECT unit_id, cycle, {_feature_list(["sensor_1", "sensor_2"])}, cycle::DOUBLE AS engine_age,
  history_length::DOUBLE AS history_length FROM dense"""
)
def features_dense(spark, sf):
    return rounding(
        features.dense_features(events_fleet(spark, sf), ["sensor_1", "sensor_2"], W, gapless=True)
    )


@query(
    f"""SELECT unit_id, cycle, {_feature_list(["sensor_1", "sensor_2"], True)}, cycle::DOUBLE AS engine_age,
  history_length::DOUBLE AS history_length FROM full_dense"""
)
def features_dense_full_history(spark, sf):
    cols = ["sensor_1", "sensor_2"]
    dense = features.dense_features(events_fleet(spark, sf), cols, None, gapless=True)
    return rounding(with_totals(dense, cols))


@query(
    f"""SELECT unit_id, full_lifetime, cutoff_cycle, true_raw_rul, fraction, {_feature_list(["sensor_1", "sensor_2"])},
  engine_age, history_length::DOUBLE AS history_length FROM feats"""
)
def features_at_checkpoints(spark, sf):
    return rounding(event_features(spark, sf))


@query(
    f"""SELECT unit_id, full_lifetime, cutoff_cycle, true_raw_rul, fraction, {_feature_list(["sensor_1", "sensor_2"], True)},
  engine_age, history_length::DOUBLE AS history_length FROM full_feats"""
)
def features_at_checkpoints_full(spark, sf):
    return rounding(with_totals(event_features(spark, sf, w=None), ["sensor_1", "sensor_2"]))


@query(
    """, supd AS (
  SELECT unit_id, cycle, avg(sensor_1) OVER f AS m, stddev_pop(sensor_1) OVER f AS d,
         min(sensor_1) OVER f AS lo, max(sensor_1) OVER f AS hi, CASE WHEN cycle > 1 THEN regr_slope(sensor_1, cycle::DOUBLE) OVER f ELSE 0 END AS k
  FROM sup WINDOW f AS (PARTITION BY unit_id ORDER BY cycle ROWS BETWEEN 89 PRECEDING AND CURRENT ROW))
SELECT unit_id, round(sum(m), 3) AS mean_sum, round(sum(d), 3) AS std_sum, round(sum(lo), 3) AS min_sum,
  round(sum(hi), 3) AS max_sum, round(sum(k), 4) + 0.0 AS slope_sum, count(*) AS rows FROM supd GROUP BY unit_id"""
)
def supplier_feature_sums(spark, sf):
    tasks = tasks_for(spark, table(spark, sf, "lineitem").count())
    fleet = supplier_fleet(spark, sf, tasks=tasks)
    dense = features.dense_features(fleet, ["sensor_1"], 90, gapless=True, tasks=tasks)
    return dense.groupBy("unit_id").agg(
        rounded(F.sum("sensor_1_mean"), 3).alias("mean_sum"),
        rounded(F.sum("sensor_1_std"), 3).alias("std_sum"),
        rounded(F.sum("sensor_1_min"), 3).alias("min_sum"),
        rounded(F.sum("sensor_1_max"), 3).alias("max_sum"),
        rounded(F.sum("sensor_1_slope"), 4).alias("slope_sum"),
        F.count(F.lit(1)).alias("rows"),
    )


@query(
    """SELECT unit_id, cutoff_cycle,
  round(max(x) FILTER (slot = 44), 6) AS sensor_1_last, round(avg(x), 6) AS sensor_1_mean,
  round(stddev_pop(x), 6) AS sensor_1_std, round(min(x), 6) AS sensor_1_min, round(max(x), 6) AS sensor_1_max,
  round(regr_slope(x, slot::DOUBLE), 6) + 0.0 AS sensor_1_slope,
  round(avg(x) FILTER (slot >= 40), 6) AS sensor_1_last5, round(avg(x) FILTER (slot >= 35), 6) AS sensor_1_last10
FROM legacy GROUP BY unit_id, cutoff_cycle"""
)
def features_legacy_padded(spark, sf):
    legacy = features.legacy_features(
        events_fleet(spark, sf), event_manifest(spark, sf), ["sensor_1"], LEGACY_W, gapless=True
    )
    names = [f"sensor_1_{g}" for g in features.LEGACY_GROUPS]
    return rounding(legacy.select("unit_id", "cutoff_cycle", *names))


# ---- evaluation --------------------------------------------------------------


@query("SELECT unit_id, cutoff_cycle, true_raw_rul, fraction, round(prediction, 6) + 0.0 AS prediction FROM pred")
def manifest_predictions(spark, sf):
    scored = evaluate.evaluate_manifest(
        events_fleet(spark, sf), event_manifest(spark, sf), MIXED, ["sensor_1", "sensor_2"], W, gapless=True
    )
    return rounding(scored.select("unit_id", "cutoff_cycle", "true_raw_rul", "fraction", "prediction"))


@query(f"SELECT fraction, {metric_sql('true_raw_rul', 'prediction')} FROM pred GROUP BY fraction")
def eval_metrics(spark, sf):
    return metric_rounding(evaluate.metrics(event_predictions(spark, sf), by=["fraction"]))


def metric_rounding(df: DataFrame, prefixes: Sequence[str] = ("",)) -> DataFrame:
    six = [
        f"{p}{m}" for p in prefixes for m in ("rmse", "mae", "r2", "score_mean", "bias", "prediction_std")
    ]
    four = [f"{p}score_total" for p in prefixes]
    return rounding(rounding(df, six), four, 4)


@query(
    """SELECT candidate_id, fold::INT AS fold, unit_id, n_checkpoints, round(rmse, 6) AS rmse, round(mae, 6) AS mae,
  round(score_sum, 6) AS score_sum, round(bias, 6) + 0.0 AS bias FROM unit_rows"""
)
def eval_per_unit(spark, sf):
    return rounding(evaluate.per_unit_metrics(fold_predictions(spark, sf)))


@query(
    """SELECT candidate_id, fold::INT AS fold, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(r2, 6) + 0.0 AS r2,
  round(score_total, 4) AS score_total, round(score_per_unit, 4) AS score_per_unit, units,
  round(bias, 6) + 0.0 AS bias FROM fold_table"""
)
def eval_fold_rows(spark, sf):
    rows = fold_table(spark, sf).select(
        "candidate_id", "fold", "rmse", "mae", "r2", "score_total", "score_per_unit", "units", "bias"
    )
    return rounding(rounding(rows, ["rmse", "mae", "r2", "bias"]), ["score_total", "score_per_unit"], 4)


@query(f"SELECT {metric_sql('true_rul', 'prediction')} FROM term")
def eval_terminal(spark, sf):
    cuts = event_manifest(spark, sf).filter(F.col("fraction") == 0.65)
    seen = attach_units(events_fleet(spark, sf), cuts.select("unit_id", "cutoff_cycle")).filter(
        F.col("cycle") <= F.col("cutoff_cycle")
    )
    labels = cuts.select("unit_id", F.col("true_raw_rul").alias("true_rul"))
    scored = evaluate.evaluate_terminal(
        seen.drop("cutoff_cycle"), labels, MIXED, ["sensor_1", "sensor_2"], W, gapless=True
    )
    return metric_rounding(evaluate.metrics(scored, "true_rul"))


@query(
    f"""SELECT {metric_sql('least(true_rul, 20)', 'prediction', 'clipped_')},
  {metric_sql('true_rul', 'prediction', 'raw_')} FROM term"""
)
def eval_clipped_and_raw(spark, sf):
    both = evaluate.clipped_and_raw_metrics(terminal_predictions(spark, sf), 20)
    return metric_rounding(both, ("clipped_", "raw_"))


@query(
    """SELECT unit_id, observed_cycles AS n_cycles, observed_cycles < 45 AS padded_short, true_rul,
  round(prediction, 4) AS prediction FROM term"""
)
def prediction_table(spark, sf):
    rows = terminal_predictions(spark, sf).withColumnRenamed("observed_cycles", "n_cycles")
    return evaluate.prediction_table(rows, LEGACY_W)


@query(
    """, m AS (SELECT candidate_id, fold, rmse, mae FROM fold_metrics)
SELECT candidate_id, fold::INT AS fold, metric, round(value, 6) AS actual,
  round(CASE WHEN metric = 'mae' AND fold = 1 THEN value + 1 ELSE value END, 6) AS recorded,
  NOT (metric = 'mae' AND fold = 1) AS passed
FROM (SELECT candidate_id, fold, 'rmse' AS metric, rmse AS value FROM m
      UNION ALL SELECT candidate_id, fold, 'mae', mae FROM m)"""
)
def falsify_metrics(spark, sf):
    """Stored metrics with a planted error in fold 1 must be caught by recomputation."""
    predictions = fold_predictions(spark, sf)
    stored = fold_table(spark, sf).withColumn(
        "mae", F.when(F.col("fold") == 1, F.col("mae") + 1).otherwise(F.col("mae"))
    )
    checked = evaluate.falsify(predictions, stored, ["candidate_id", "fold"], ["rmse", "mae"])
    return rounding(checked.drop("gap"))


# ---- selection ---------------------------------------------------------------


@query(
    """SELECT 'extra' AS candidate_id, unnest([1, 2, 3, 4])::INT AS fold, 0::BIGINT AS rows, 'missing' AS problem
UNION ALL SELECT 'age', 1::INT, 2, 'repeated'"""
)
def cv_completeness(spark, sf):
    """One declared candidate without rows and one repeated fold must be reported."""
    rows = fold_table(spark, sf).select("candidate_id", "fold")
    rows = rows.unionByName(rows.filter((F.col("candidate_id") == "age") & (F.col("fold") == 1)))
    declared = spark.createDataFrame([(c,) for c in [*CANDIDATES, "extra"]], "candidate_id string")
    return selection.cv_gaps(rows, declared, FOLDS)


@query("SELECT * FROM summary")
def cv_summary(spark, sf):
    return summary(spark, sf)


@query(
    """, best AS (SELECT candidate_id AS b, score_per_unit_mean AS m, score_per_unit_std AS s FROM summary
  ORDER BY score_per_unit_mean, candidate_id LIMIT 1
), tied AS (
  SELECT summary.*, candidate_id = b OR coalesce(abs(m - score_per_unit_mean) <
    sqrt((score_per_unit_std ** 2 + s ** 2) / 4), false) AS tied FROM summary, best
)
SELECT candidate_id, tied,
  row_number() OVER (ORDER BY tied DESC, rmse_mean, abs(bias_mean), candidate_id) = 1 AS selected,
  row_number() OVER (ORDER BY rmse_mean, candidate_id) = 1 AS accuracy_champion FROM tied"""
)
def select_candidate(spark, sf):
    chosen = selection.select_candidate(summary(spark, sf), FOLDS)
    return chosen.select("candidate_id", "tied", "selected", "accuracy_champion")


@query(
    """SELECT candidate_id AS variant, round(score_per_unit_mean, 4) AS score_per_unit FROM summary
ORDER BY score_per_unit_mean, rmse_mean, abs(bias_mean), candidate_id LIMIT 1"""
)
def select_variant(spark, sf):
    rows = summary(spark, sf).select(
        F.col("candidate_id").alias("variant"),
        F.col("score_per_unit_mean").alias("score_per_unit"),
        F.col("rmse_mean").alias("rmse"),
        F.col("bias_mean").alias("bias"),
    )
    return selection.select_variant(rows).select("variant", "score_per_unit")


@query(
    """, rounds AS (SELECT candidate_id, fold, (floor(rmse * 7) + fold)::BIGINT AS best_iteration FROM fold_metrics)
SELECT candidate_id, round_even(median(best_iteration)::DOUBLE, 0)::BIGINT + 1 AS rounds, count(*) AS folds
FROM rounds GROUP BY candidate_id"""
)
def final_duration(spark, sf):
    """Best rounds derived from the fold errors stand in for recorded stopping rounds."""
    rounds = fold_table(spark, sf).select(
        "candidate_id", "fold", (F.floor(F.col("rmse") * 7) + F.col("fold")).alias("best_iteration")
    )
    return selection.final_rounds(rounds)


RUN_NOTES = (
    "'variant=w' || (15 * (p_size % 6 + 1)) || '_c' || "
    "(CASE p_partkey % 3 WHEN 0 THEN '45' WHEN 1 THEN '125' ELSE 'none' END) || '_' || "
    "(CASE p_partkey % 2 WHEN 0 THEN 'all' ELSE 'varying' END)"
)
BASELINE_RUN = {"window": "60", "cap": "125", "sensors": "all", "loss": "mse", "model": "gru"}


@query(
    """, runs AS (
  SELECT p_partkey AS run_id, (CASE p_size % 4 WHEN 0 THEN 'gru' WHEN 1 THEN 'lstm' WHEN 2 THEN 'xgboost' ELSE 'rf' END) AS model,
         (15 * (p_size % 6 + 1))::VARCHAR AS "window",
         (CASE p_partkey % 3 WHEN 0 THEN '45' WHEN 1 THEN '125' ELSE 'none' END) AS cap,
         (CASE p_partkey % 2 WHEN 0 THEN 'all' ELSE 'varying' END) AS sensors,
         (CASE p_partkey % 5 WHEN 0 THEN 'huber' WHEN 1 THEN '-' ELSE 'mse' END) AS loss
  FROM part
), changes AS (
  SELECT run_id, 1 AS place, 'window=' || "window" AS change FROM runs WHERE "window" <> '60'
  UNION ALL SELECT run_id, 2, 'cap=' || cap FROM runs WHERE cap <> '125'
  UNION ALL SELECT run_id, 3, 'sensors=varying' FROM runs WHERE sensors = 'varying'
  UNION ALL SELECT run_id, 4, 'loss=' || loss FROM runs WHERE loss <> 'mse'
  UNION ALL SELECT run_id, 5, 'model=' || model FROM runs WHERE model <> 'gru'
)
SELECT run_id, model, 'w' || "window" || '_c' || cap || '_' || sensors AS variant, loss, factor, n AS changed
FROM runs JOIN (SELECT run_id, string_agg(change, '; ' ORDER BY place) AS factor, count(*)::INT AS n
                FROM changes GROUP BY run_id) USING (run_id)"""
)
def ablation_labels(spark, sf):
    """Run notes composed from the part table, labelled by how they differ from a baseline run."""
    loss = F.when(F.col("p_partkey") % 5 == 0, F.lit(" loss=huber")).when(
        F.col("p_partkey") % 5 == 1, F.lit("")
    ).otherwise(F.lit(" loss=mse"))
    runs = table(spark, sf, "part").select(
        F.col("p_partkey").alias("run_id"),
        F.expr(
            "CASE p_size % 4 WHEN 0 THEN 'gru' WHEN 1 THEN 'lstm' WHEN 2 THEN 'xgboost' ELSE 'rf' END"
        ).alias("model"),
        F.concat(F.expr(RUN_NOTES), loss).alias("notes"),
    )
    labelled = selection.label_changes(selection.parse_runs(runs, "w30_c125_all"), BASELINE_RUN)
    return labelled.select("run_id", "model", "variant", "loss", "factor", "changed")


@query(
    """SELECT m || '_w' || w || '_s42' AS experiment_id, m AS model, w::INT AS "window", '' AS overrides
FROM (SELECT unnest(['mean', 'linear', 'forest', 'boosted']) AS m), (SELECT unnest([15, 30, 45]) AS w)
WHERE m || '_w' || w || '_s42' NOT IN (
  SELECT (CASE user_id % 2 WHEN 0 THEN 'mean' ELSE 'linear' END) || '_w' || (15 * (user_id % 3 + 1)) || '_s42' FROM events)
UNION ALL SELECT 'boosted_w30_maxDepth3_s42', 'boosted', 30, 'maxDepth=3'"""
)
def ablation_grid(spark, sf):
    """Finished ids are read from the events; the rest of the grid is left to run."""
    done = table(spark, sf, "events").select(
        F.concat(
            F.when(F.col("user_id") % 2 == 0, "mean").otherwise("linear"),
            F.lit("_w"),
            (15 * (F.col("user_id") % 3 + 1)).cast("string"),
            F.lit("_s42"),
        ).alias("experiment_id")
    ).distinct()
    return selection.ablation_grid(
        spark, (15, 30, 45), ("mean", "linear", "forest", "boosted"), [("boosted", 30, {"maxDepth": 3})], done
    )


@query(
    """SELECT candidate_id, sum(n)::BIGINT AS rows, sum(n - 1)::BIGINT AS repeated,
  sum(n) = 5 * (SELECT count(*) FROM life) AND sum(n - 1) = 0 AS passed
FROM (SELECT candidate_id, unit_id, cutoff_cycle, count(*) AS n FROM cand GROUP BY ALL) GROUP BY candidate_id"""
)
def prediction_count_check(spark, sf):
    predictions = candidate_predictions(spark, sf)
    expected = 5 * event_lifetimes(spark, sf).count()
    return selection.check_prediction_counts(
        predictions, ["candidate_id"], ["unit_id", "cutoff_cycle"], expected
    )


# ---- conformal ---------------------------------------------------------------


@query("SELECT unit_id, round(score, 6) AS score FROM cal_units")
def cluster_scores(spark, sf):
    return rounding(unit_scores(spark, sf))


@query("SELECT alpha, n, k, round(q, 6) AS q FROM unit_q")
def conformal_unit_q(spark, sf):
    return rounding(conformal.conformal_q(unit_scores(spark, sf)), ["q"])


@query("SELECT alpha, n, round(q, 6) AS q FROM row_q")
def conformal_row_q(spark, sf):
    return rounding(conformal.conformal_q(row_scores(spark, sf), rule="higher"), ["q"])


@query(
    """SELECT alpha, round(q, 6) AS q, round(avg((abs(prediction - true_rul) <= q + 1e-9)::INT), 6) AS coverage,
  count(*) AS rows,
  round(avg((abs(prediction - true_rul) <= q + 1e-9)::INT) FILTER (observed_cycles >= 45), 6) AS coverage_full_history,
  round(avg((abs(prediction - true_rul) <= q + 1e-9)::INT) FILTER (observed_cycles < 45), 6) AS coverage_short_history
FROM term CROSS JOIN unit_q GROUP BY alpha, q"""
)
def coverage_by_history(spark, sf):
    q = conformal.conformal_q(unit_scores(spark, sf)).withColumn("q", F.col("q") + 1e-9)
    rows = conformal.coverage(
        terminal_predictions(spark, sf), q, "true_rul", history="observed_cycles", w=LEGACY_W
    )
    return rounding(rows, ["q", "coverage", "coverage_full_history", "coverage_short_history"])


@query(
    f"""SELECT sample, alpha, round(q, 6) AS q,
  round(avg((abs(prediction - true_rul) <= q + 1e-9)::INT), 6) AS coverage, {metric_sql('true_rul', 'prediction - q', 'lb_')}
FROM samples CROSS JOIN row_q GROUP BY sample, alpha, q"""
)
def early_warning_metrics(spark, sf):
    q = conformal.conformal_q(row_scores(spark, sf), rule="higher").withColumn("q", F.col("q") + 1e-9)
    rows = conformal.early_warning_metrics(samples(spark, sf), q)
    return metric_rounding(rounding(rows, ["q", "coverage"]), ("lb_",))


@query(
    """SELECT sample, unit_id, true_rul, round(prediction, 6) + 0.0 AS prediction, alpha, round(q, 6) AS q,
  round(prediction - q, 6) + 0.0 AS lo, round(prediction + q, 6) + 0.0 AS hi, round(2 * q, 6) AS width
FROM samples CROSS JOIN unit_q WHERE alpha = 0.1::DOUBLE"""
)
def interval_table(spark, sf):
    q = conformal.conformal_q(unit_scores(spark, sf), [0.1])
    table_ = conformal.interval_table(
        {"official": terminal_predictions(spark, sf), "validation": validation_predictions(spark, sf)}, q
    )
    return rounding(table_)


@query(
    """SELECT count(*) AS n, round(avg(abs(prediction - true_raw_rul)), 6) AS mean,
  round(max(abs(prediction - true_raw_rul)), 6) AS max, round(median(abs(prediction - true_raw_rul)), 6) AS median FROM cal"""
)
def residual_summary(spark, sf):
    return rounding(conformal.residual_summary(calibration(spark, sf)))


@query(
    """SELECT alpha, round(avg((abs(prediction - true_raw_rul) <= q + 1e-9)::INT), 6) AS coverage, true AS passed
FROM cal CROSS JOIN row_q GROUP BY alpha"""
)
def coverage_guarantee(spark, sf):
    q = conformal.conformal_q(row_scores(spark, sf), rule="higher").withColumn("q", F.col("q") + 1e-9)
    rows = conformal.check_guarantee(conformal.coverage(calibration(spark, sf), q))
    return rounding(rows.select("alpha", "coverage", "passed"))


# ---- error analysis ----------------------------------------------------------


@query(
    """, b AS (SELECT * FROM (VALUES (0, 45), (45, 90), (90, 128), (128, 200), (200, NULL)) t(lower, upper))
SELECT lower, upper, count(*) AS n, round(avg(prediction - true_rul), 6) + 0.0 AS mean_signed_error,
  round(avg((prediction > true_rul)::INT), 6) AS overprediction_share, round(avg(abs(prediction - true_rul)), 6) AS mean_abs_error
FROM term JOIN b ON observed_cycles >= lower AND (upper IS NULL OR observed_cycles < upper) GROUP BY lower, upper"""
)
def error_profile_history(spark, sf):
    return rounding(errors.bucket_profile(terminal_predictions(spark, sf)))


@query(
    """, b AS (SELECT * FROM (VALUES
  ('observed_history', 0, 44, 'padded_observed_lt_window'), ('observed_history', 45, 127, 'observed_45_127'),
  ('observed_history', 128, NULL, 'observed_ge_128'), ('implied_lifetime', 0, 127, 'implied_lifetime_lt_128'),
  ('implied_lifetime', 128, NULL, 'implied_lifetime_ge_128'), ('true_rul_bin', 0, 29, 'true_rul_0_29'),
  ('true_rul_bin', 30, 59, 'true_rul_30_59'), ('true_rul_bin', 60, 99, 'true_rul_60_99'),
  ('true_rul_bin', 100, NULL, 'true_rul_ge_100'), ('padded_vs_full', 0, 44, 'padded_observed_lt_45'),
  ('padded_vs_full', 45, NULL, 'full_observed_ge_45')) t(split, lo, hi, "group")
), e AS (
  SELECT term.*, error, abs_error, score_point FROM term JOIN errs USING (unit_id) WHERE sample = 'official'
)
SELECT split, "group", count(e.unit_id) AS count, round(avg(error), 6) + 0.0 AS mean_error,
  round(avg(abs_error), 6) AS mean_abs_error, round(sqrt(avg(error ** 2)), 6) AS rmse,
  round(sum(score_point), 4) AS score_sum, round(sum(score_point) / (SELECT sum(score_point) FROM e) * 100, 6) AS score_pct
FROM b LEFT JOIN e ON lo <= CASE split WHEN 'implied_lifetime' THEN implied_failure_cycle WHEN 'true_rul_bin' THEN e.true_rul
    ELSE e.observed_cycles END
  AND coalesce(hi, 9223372036854775807) >= CASE split WHEN 'implied_lifetime' THEN implied_failure_cycle WHEN 'true_rul_bin' THEN e.true_rul
    ELSE e.observed_cycles END
GROUP BY split, "group\""""
)
def error_profile_multi(spark, sf):
    rows = errors.multi_profile(terminal_predictions(spark, sf))
    return rounding(
        rounding(rows, ["mean_error", "mean_abs_error", "rmse", "score_pct"]), ["score_sum"], 4
    )


@query(
    """, b AS (SELECT unnest([0, 20, 40, 60, 80, 100, 125, 150]::DOUBLE[]) AS edge),
x AS (SELECT *, (SELECT max(edge) FROM b WHERE edge <= true_rul) AS lower FROM errs)
SELECT sample, lower, count(*) AS n, round(avg(error), 6) + 0.0 AS mean_error, round(sqrt(avg(error ** 2)), 6) AS rmse,
  round(avg(abs_error), 6) AS mae, round(avg((error > 0)::INT), 6) AS late_share, round(avg((abs_error < 13)::INT), 6) AS near_share
FROM x GROUP BY sample, lower"""
)
def rul_bucket_table(spark, sf):
    return rounding(
        errors.rul_bucket_table(samples(spark, sf), (0, 20, 40, 60, 80, 100, 125, 150), by=["sample"])
    )


@query(
    """SELECT sample, count(*) AS n, round(avg(error), 6) + 0.0 AS bias_mean, round(avg((abs_error < 13)::INT), 6) AS near_share,
  count(*) FILTER (error > 0) AS late, count(*) FILTER (error < 0) AS early, count(*) FILTER (error > 50) AS late_far,
  count(*) FILTER (error < -50) AS early_far, round(median(error), 6) + 0.0 AS bias_median FROM errs GROUP BY sample"""
)
def error_headline(spark, sf):
    return rounding(errors.error_headline(samples(spark, sf), ["sample"]))


@query(
    """SELECT sample, round(corr(true_rul::DOUBLE, error), 6) + 0.0 AS corr_true_rul,
  round(corr(observed_cycles::DOUBLE, error), 6) + 0.0 AS corr_history FROM errs GROUP BY sample"""
)
def error_correlation(spark, sf):
    return rounding(errors.error_correlation(samples(spark, sf), ["sample"]))


WORST_SQL = """SELECT sample, unit_id, observed_cycles, true_rul, round(error, 6) + 0.0 AS error,
  round(score_point, 6) AS score_point, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY sample ORDER BY {0} DESC, unit_id, observed_cycles) AS rank FROM errs)
WHERE rank <= 5"""


def _worst(spark, sf, on):
    rows = errors.worst_k(samples(spark, sf), "sample", 5, on, tie=["observed_cycles"])
    return rounding(
        rows.select(
            "sample", "unit_id", "observed_cycles", "true_rul", "error", "score_point",
            F.col("rank").cast("long").alias("rank"),
        )
    )


@query(WORST_SQL.format("abs_error"))
def worst_by_error(spark, sf):
    return _worst(spark, sf, "abs_error")


@query(WORST_SQL.format("score_point"))
def worst_by_score(spark, sf):
    return _worst(spark, sf, "score_point")


@query(
    """SELECT sample, round(coalesce(sum(score_point) FILTER (error > 0), 0) / sum(score_point), 6) AS late_share,
  round(coalesce(sum(score_point) FILTER (error > 50), 0) / sum(score_point), 6) AS far_late_share FROM errs GROUP BY sample"""
)
def late_share(spark, sf):
    return rounding(errors.late_share(samples(spark, sf), ["sample"]))


@query(
    """SELECT sample, unit_id, observed_cycles, round(error, 1) + 0.0 AS error FROM errs WHERE observed_cycles < 45"""
)
def padded_errors(spark, sf):
    return errors.padded_errors(samples(spark, sf), LEGACY_W)


@query(
    """SELECT sample, unit_id, observed_cycles, true_rul, round(prediction, 6) + 0.0 AS prediction,
  round(error, 6) + 0.0 AS error, round(score_point, 6) + 0.0 AS score_point FROM errs"""
)
def error_profile(spark, sf):
    return rounding(
        errors.error_profile(
            {"official": terminal_predictions(spark, sf), "validation": validation_predictions(spark, sf)}
        )
    )


# ---- sensitivity -------------------------------------------------------------

OCCLUSION_SQL = """, base AS (
  SELECT unit_id, cutoff_cycle, fraction, true_raw_rul, engine_age, sensor_1_mean AS a, sensor_1_std AS b,
         sensor_2_latest AS c, sensor_2_slope AS d, sensor_2_mean AS m2, sensor_1_mean AS m1
  FROM full_feats
), occ AS (
  SELECT *, 66.0 + (-0.93) * engine_age + 0.0217 * a + 0.1317 * b + 0.0113 * c + 0.7391 * d AS p0,
         66.0 + (-0.93) * engine_age + 0.0217 * m1 + 0.0113 * c + 0.7391 * d AS p1,
         66.0 + (-0.93) * engine_age + 0.0217 * a + 0.1317 * b + 0.0113 * m2 AS p2 FROM base
), deltas AS (
  SELECT 'sensor_1' AS sensor, fraction, true_raw_rul, p0, p1 FROM occ
  UNION ALL SELECT 'sensor_2', fraction, true_raw_rul, p0, p2 FROM occ
), by_fraction AS (
  SELECT sensor, fraction, avg(abs(p1 - p0)) AS mean_abs_delta, avg(p1 - p0) AS mean_delta FROM deltas GROUP BY ALL
)
"""


def occlusion_deltas(spark, sf) -> DataFrame:
    return sensitivity.occlude(event_features(spark, sf, w=None), ["sensor_1", "sensor_2"], MIXED)


@query(
    OCCLUSION_SQL
    + """SELECT sensor, round(avg(abs(p1 - p0)), 6) AS mean_abs_delta,
  round(sqrt(avg((p1 - true_raw_rul) ** 2)) - sqrt(avg((p0 - true_raw_rul) ** 2)), 6) + 0.0 AS rmse_delta,
  round(avg((p1 - p0 > 0)::INT), 6) AS worsened_share,
  round(avg((p1 - p0 > 0 AND p0 > true_raw_rul)::INT), 6) AS overpredicted_and_worsened_share
FROM deltas GROUP BY sensor"""
)
def occlusion_summary(spark, sf):
    return rounding(sensitivity.occlusion_summary(occlusion_deltas(spark, sf)))


@query(
    OCCLUSION_SQL
    + """SELECT sensor, fraction, round(mean_abs_delta, 6) AS mean_abs_delta, round(mean_delta, 6) + 0.0 AS mean_delta
FROM by_fraction"""
)
def occlusion_by_fraction(spark, sf):
    return rounding(sensitivity.occlusion_by_fraction(occlusion_deltas(spark, sf)))


@query(
    OCCLUSION_SQL
    + """SELECT fraction, sensor, round(mean_abs_delta, 6) AS mean_abs_delta FROM (
  SELECT *, row_number() OVER (PARTITION BY fraction ORDER BY mean_abs_delta DESC, sensor) AS r FROM by_fraction)
WHERE r <= 3"""
)
def occlusion_top_sensors(spark, sf):
    top = sensitivity.top_sensors(occlusion_deltas(spark, sf), 3)
    return rounding(top.select("fraction", "sensor", "mean_abs_delta"))


@query("SELECT count(*) AS checkpoints, 0::BIGINT AS misaligned, true AS passed FROM man")
def occlusion_alignment(spark, sf):
    return sensitivity.alignment_check(event_manifest(spark, sf), occlusion_deltas(spark, sf), 2)


@query(
    """, w AS (
  SELECT unit_id, greatest(least(cycle, lifetime - cycle + 1, 30, lifetime - 29), 0) AS f, sensor_1, sensor_2, sensor_3 FROM evr
), long AS (
  SELECT 'sensor_1' AS sensor, sensor_1 AS x, f FROM w UNION ALL SELECT 'sensor_2', sensor_2, f FROM w
  UNION ALL SELECT 'sensor_3', sensor_3, f FROM w
), rep AS (SELECT sensor, x, unnest(range(0, f)) FROM long WHERE f > 0)
SELECT sensor, round(median(x), 6) AS median FROM rep GROUP BY sensor"""
)
def background_median(spark, sf):
    return rounding(sensitivity.background_median(events_fleet(spark, sf), COLS, W, gapless=True))


@query(
    """, p AS (
  SELECT unnest(range(greatest(1, cycle - (lifetime - 8)), least(8, cycle) + 1)) AS position, sensor_1, sensor_2
  FROM evr WHERE lifetime >= 8
)
SELECT position, 'sensor_1' AS sensor, round(median(sensor_1), 6) AS median FROM p GROUP BY position
UNION ALL SELECT position, 'sensor_2', round(median(sensor_2), 6) FROM p GROUP BY position"""
)
def position_background(spark, sf):
    return rounding(
        sensitivity.position_background(events_fleet(spark, sf), ["sensor_1", "sensor_2"], 8, gapless=True)
    )


def _trend_scorer(x, mask):
    """Fixed sequence scorer: observed mean plus a recency-weighted sum."""
    seen = mask.sum(axis=1)
    level = (x[:, :, 0].astype("float64") * mask).sum(axis=1) / seen
    recent = x[:, -5:, 1].astype("float64").sum(axis=1)
    return 40.0 + 0.4937 * level + 0.01 * recent


@query(
    """, t AS (
  SELECT evr.*, 30 - (lifetime - cycle) AS slot FROM evr WHERE rul < 30
), m AS (SELECT unit_id, avg(sensor_1) AS level, sum(sensor_2) FILTER (slot > 25) AS recent FROM t GROUP BY unit_id)
SELECT unit_id, lifetime AS end_cycle, round(40 + 0.4937 * level + 0.01 * recent, 2) AS prediction FROM m JOIN life USING (unit_id)"""
)
def sequence_scoring(spark, sf):
    seqs = windows.terminal_windows(events_fleet(spark, sf), ["sensor_1", "sensor_2"], W, gapless=True)
    scored = models.score_sequences(seqs.select("unit_id", "end_cycle", "seq", "mask"), _trend_scorer, W)
    return scored.withColumn("prediction", F.round("prediction", 2))


def _terminal_full(spark, sf):
    seqs = windows.terminal_windows(events_fleet(spark, sf), ["sensor_1", "sensor_2"], W, gapless=True)
    return windows.full_windows_only(seqs, W)


@query()
def median_attribution(spark, sf):
    cols = ["sensor_1", "sensor_2"]
    background = sensitivity.background_median(events_fleet(spark, sf), cols, W, gapless=True)
    found = sensitivity.median_attribution(_terminal_full(spark, sf), background, cols, _trend_scorer, W)
    groups = sensitivity.target_groups(
        errors.with_errors(terminal_predictions(spark, sf)), W
    )
    return sensitivity.attribution_summary(found, groups)


@query()
def position_attribution(spark, sf):
    cols = ["sensor_1", "sensor_2"]
    background = sensitivity.position_background(events_fleet(spark, sf), cols, W, gapless=True)
    found = sensitivity.position_attribution(_terminal_full(spark, sf), background, cols, _trend_scorer, W)
    return found.groupBy("position").agg(F.avg("attribution").alias("attribution"))


@query(
    """SELECT unit_id, CASE WHEN error > 50 THEN 'late-miss' ELSE 'accurate' END AS "group", round(error, 6) + 0.0 AS error
FROM errs WHERE sample = 'official' AND observed_cycles >= 30 AND (error > 50 OR abs_error < 13)"""
)
def target_groups(spark, sf):
    return rounding(sensitivity.target_groups(errors.with_errors(terminal_predictions(spark, sf)), W))


# ---- models ------------------------------------------------------------------

TREE = {"maxIter": 6, "maxDepth": 3}


def _train_rows(spark, sf, cols=("sensor_1", "sensor_2")):
    roles = splits.split_units(event_lifetimes(spark, sf))
    members = attach_units(events_fleet(spark, sf), roles)
    dense = features.dense_features(
        target.add_target(members), list(cols), W, keep=["rul", "role"], gapless=True
    )
    return flows.written(dense, "train_rows")


@query(
    """, m AS (SELECT avg(rul) AS mean FROM evr JOIN split2 USING (unit_id) WHERE role = 'train')
SELECT unit_id, cycle, rul, round(mean, 6) AS prediction FROM evr JOIN split2 USING (unit_id), m WHERE role = 'validation'"""
)
def fit_mean(spark, sf):
    roles = splits.split_units(event_lifetimes(spark, sf))
    rows = target.add_target(attach_units(events_fleet(spark, sf), roles))
    model = models.fit_model("mean", rows.filter(F.col("role") == "train"), [])
    scored = models.predict(rows.filter(F.col("role") == "validation"), model)
    return rounding(scored.select("unit_id", "cycle", "rul", "prediction"))


@query(
    """, v AS (SELECT rul, engine_age FROM (SELECT rul, cycle::DOUBLE AS engine_age, role FROM evr JOIN split2 USING (unit_id)) WHERE role = 'train'),
m AS (SELECT regr_slope(rul, engine_age) AS b, regr_intercept(rul, engine_age) AS a FROM v)
SELECT unit_id, cycle, round(a + b * cycle, 4) + 0.0 AS prediction FROM evr JOIN split2 USING (unit_id), m WHERE role = 'validation'"""
)
def fit_linear_on_age(spark, sf):
    roles = splits.split_units(event_lifetimes(spark, sf))
    rows = target.add_target(attach_units(events_fleet(spark, sf), roles)).withColumn(
        "engine_age", F.col("cycle").cast("double")
    )
    model = models.fit_model("linear", rows.filter(F.col("role") == "train"), ["engine_age"])
    scored = models.predict(rows.filter(F.col("role") == "validation"), model)
    return rounding(scored.select("unit_id", "cycle", "prediction"), digits=4)


def _fit_and_score(spark, sf, name, params=None):
    rows = _train_rows(spark, sf)
    inputs = features.feature_names(["sensor_1", "sensor_2"])
    model = models.fit_model(name, rows.filter(F.col("role") == "train"), inputs, params)
    held = models.predict(rows.filter(F.col("role") == "validation"), model)
    return evaluate.metrics(held, "rul")


@query()
def fit_linear(spark, sf):
    return _fit_and_score(spark, sf, "linear")


@query()
def fit_forest(spark, sf):
    return _fit_and_score(spark, sf, "forest", {"numTrees": 10, "maxDepth": 6})


@query()
def fit_boosted(spark, sf):
    return _fit_and_score(spark, sf, "boosted", TREE)


@query()
def boosted_best_iteration(spark, sf):
    """Up to 500 rounds of depth 6, ended by a patience of 30 rounds on the monitor rows."""
    rows = _train_rows(spark, sf)
    inputs = features.feature_names(["sensor_1", "sensor_2"])
    stop = rows.filter(F.col("role") == "validation")
    # both kinds of rows come from the same scans
    fit = boosting.Fit(F.col("role") == "train", F.col("role") == "validation")
    found = boosting.boost_many(rows, inputs, [fit], {"stepSize": 0.3})[0]
    return stop.agg(F.count(F.lit(1)).alias("monitor_rows")).select(
        "monitor_rows",
        F.lit(found.best_iteration).alias("best_iteration"),
        F.lit(found.rounds_fitted).alias("rounds_fitted"),
        F.lit(found.losses[found.best_iteration]).alias("best_loss"),
    )


@query()
def final_fit(spark, sf):
    roles = split3(spark, sf)
    fleet = target.add_target(events_fleet(spark, sf))
    dense = features.dense_features(fleet, ["sensor_1", "sensor_2"], W, keep=["rul"], gapless=True)
    inputs = features.feature_names(["sensor_1", "sensor_2"])
    # the learner reads its rows several times
    model = models.fit_final(flows.written(dense, "final_rows"), roles, "boosted", inputs, TREE)
    loaded = models.load_model(models.save_model(model, new_table_path(spark, "model"), spark), "boosted", spark)
    scored = models.predict(event_features(spark, sf), loaded)
    return scored.select("unit_id", "cutoff_cycle", "true_raw_rul", "fraction", "prediction")


@query()
def nested_cv_boosted(spark, sf):
    candidates = [
        flows.Candidate("boosted_w30", "boosted", W, {"maxIter": 4, "maxDepth": 3}),
        flows.Candidate("linear_w30", "linear", W),
        flows.Candidate("mean_w30", "mean", W),
    ]
    rows, _ = flows.nested_cv(
        events_fleet(spark, sf),
        dev_folds(spark, sf),
        FOLDS,
        candidates,
        ["sensor_1", "sensor_2"],
        inner_stop(),
    )
    return rows.drop("training_time")


@query()
def group_cv_linear(spark, sf):
    candidates = [
        flows.Candidate("mean_w30", "mean", W),
        flows.Candidate("linear_w30", "linear", W),
    ]
    rows, _ = flows.group_cv(
        events_fleet(spark, sf), dev_folds(spark, sf), FOLDS, candidates, ["sensor_1", "sensor_2"]
    )
    return rows.drop("training_time")


@query(
    """, t AS (
  SELECT g.fold, cycle::DOUBLE AS a, sensor_1 AS b, rul::DOUBLE AS y
  FROM (SELECT unnest(range(1, 5)) AS fold) g JOIN folds ON folds.fold <> g.fold JOIN evr USING (unit_id)
), m AS (
  SELECT fold, count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb,
         covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_ FROM t GROUP BY fold
), s AS (
  SELECT *, (ay * vb - by_ * ab) / (va * vb - ab * ab) AS wa, (by_ * va - ay * ab) / (va * vb - ab * ab) AS wb FROM m
), held AS (
  SELECT folds.fold, rul - (my - wa * ma - wb * mb + wa * cycle + wb * sensor_1) AS e FROM evr JOIN folds USING (unit_id)
  JOIN s ON s.fold = folds.fold
)
SELECT s.fold::INT AS fold, n, round(my, 6) AS mean_label, round(my - wa * ma - wb * mb, 6) AS intercept,
  round(wa, 6) AS weight_age, round(wb, 6) AS weight_sensor, round(rmse, 6) AS rmse
FROM s JOIN (SELECT fold, sqrt(avg(e * e)) AS rmse FROM held GROUP BY fold) h ON h.fold = s.fold"""
)
def cv_least_squares(spark, sf):
    """Every fold's least squares from one scan, and its error on the units it did not see."""
    rows = target.add_target(attach_units(events_fleet(spark, sf), dev_folds(spark, sf)))
    rows = rows.select("fold", "rul", F.col("cycle").cast("double").alias("age"), "sensor_1")
    inputs = ["age", "sensor_1"]
    fits = leastsquares.fold_models(rows, inputs)
    held = leastsquares.predict_held_out(rows, fits, inputs)
    errors_ = held.groupBy("fold").agg(F.sqrt(F.avg((F.col("prediction") - F.col("rul")) ** 2)).alias("rmse"))
    return rounding(
        fits.join(F.broadcast(errors_), "fold").select(
            "fold",
            "n",
            "mean_label",
            "intercept",
            F.get("weights", F.lit(0)).alias("weight_age"),
            F.get("weights", F.lit(1)).alias("weight_sensor"),
            "rmse",
        )
    )


def _grid(spark, sf, points) -> DataFrame:
    results, _ = flows.run_grid(
        events_fleet(spark, sf),
        splits.split_units(event_lifetimes(spark, sf)),
        ["sensor_1", "sensor_2"],
        points,
        new_table_path(spark, "grid"),
    )
    return results.drop("training_time")


@query(
    f""", points AS (
  SELECT w, c, 'mean_w' || w || CASE WHEN c IS NULL THEN '' ELSE '_cap' || c END || '_s42' AS experiment_id
  FROM (VALUES (15, NULL), (30, NULL), (45, NULL), (30, 45), (30, 20)) v(w, c)
), fitted AS (
  SELECT experiment_id, any_value(w) AS w, any_value(c) AS c, avg(least(rul, coalesce(c, rul))) AS p
  FROM points, evr JOIN split2 USING (unit_id) WHERE role = 'train' GROUP BY experiment_id
), held AS (
  SELECT fitted.*, true_raw_rul AS y FROM latman JOIN split2 USING (unit_id), fitted WHERE role = 'validation'
)
SELECT experiment_id, 'mean' AS model, any_value(w)::INT AS "window",
  CASE WHEN any_value(c) IS NULL THEN 'none' ELSE 'cap=' || any_value(c) END AS overrides, {metric_sql("y", "p")}
FROM held GROUP BY experiment_id"""
)
def ablation_run(spark, sf):
    """A grid of windows and target caps, run side by side."""
    points = flows.grid_points((15, 30, 45), ("mean",), [("mean", 30, {"cap": 45}), ("mean", 30, {"cap": 20})])
    return metric_rounding(_grid(spark, sf, points))


@query()
def ablation_run_models(spark, sf):
    """A grid of learners, windows and learner settings, run side by side."""
    overrides = [("boosted", 30, {"maxIter": 6, "maxDepth": d}) for d in (3, 6)]
    overrides += [("forest", 30, {"numTrees": 10, "maxDepth": 6}), ("linear", 30, {"cap": 45})]
    return _grid(spark, sf, flows.grid_points((15, 30), ("mean", "linear"), overrides))


@query()
def variant_comparison(spark, sf):
    results, _ = flows.compare_variants(
        events_fleet(spark, sf),
        split3(spark, sf),
        ["sensor_1", "sensor_2"],
        SETTINGS,
        W,
        inner_stop(),
        params={"maxIter": 3, "maxDepth": 2},
    )
    return results.drop("training_time")


@query()
def model_benchmark(spark, sf):
    candidates = [
        flows.Candidate("mean_w30_s42", "mean", W),
        flows.Candidate("linear_w30_s42", "linear", W),
        flows.Candidate("boosted_w30_s42", "boosted", W, {"maxIter": 3, "maxDepth": 3}),
    ]
    rows = flows.run_benchmark(
        events_fleet(spark, sf), splits.split_units(event_lifetimes(spark, sf)), ["sensor_1", "sensor_2"],
        candidates, results_path=new_table_path(spark, "benchmark"),
    )
    return rows.drop("training_time")


# ---- serving -----------------------------------------------------------------

@query(
    """SELECT unit_id, 'v1' AS model_version, lifetime AS n_cycles_observed, lifetime < 60 AS history_is_padded,
  greatest(60 - lifetime, 0)::BIGINT AS n_padded_timesteps,
  round(p, 2) + 0.0 AS prediction_raw_rul, round(p - 9.5, 2) + 0.0 AS lo, round(p + 9.5, 2) + 0.0 AS hi,
  19.0::DOUBLE AS interval_width,
  CASE WHEN lifetime < 60 THEN 'Limited observed history: only ' || lifetime || ' cycles observed; window 60 -> '
    || (60 - lifetime) || ' timesteps padded.' END AS warning
FROM (SELECT unit_id, lifetime, 66.0 + (-0.93) * lifetime + 0.0217 * sensor_1_mean + 0.1317 * sensor_1_std
        + 0.0113 * sensor_2_latest + 0.7391 * sensor_2_slope AS p
      FROM full_dense JOIN life USING (unit_id) WHERE cycle = lifetime)"""
)
def serve_batch(spark, sf):
    return serving.serve_batch(
        events_fleet(spark, sf), MIXED, 9.5, ["sensor_1", "sensor_2"], 60, mode="full", gapless=True
    )


@query("SELECT count(*) AS units, count(*) FILTER (lifetime < 60) AS padded_units FROM life")
def fleet_padding(spark, sf):
    served = serving.serve_batch(
        events_fleet(spark, sf), MIXED, 9.5, ["sensor_1", "sensor_2"], 60, gapless=True
    )
    return serving.fleet_padding(served)


CAPPED = models.FormulaModel(48.0, {"engine_age": -0.31, "sensor_1_mean": 0.0371, "sensor_1_std": 0.0713})
CAPPED_SQL = """, t AS (
  SELECT unit_id, lifetime, sum(sensor_1) / 60 AS m,
         sqrt(sum(sensor_1 ** 2) / 60 - (sum(sensor_1) / 60) ** 2) AS d
  FROM evr WHERE rul < 60 GROUP BY unit_id, lifetime
), served AS (
  SELECT unit_id, lifetime AS n_cycles, lifetime < 60 AS padded_short,
         round(greatest(least(48.0 + (-0.31) * lifetime + 0.0371 * m + 0.0713 * d, 30), 0), 4) AS prediction FROM t
)
"""


@query(CAPPED_SQL + "SELECT * FROM served")
def capped_serving(spark, sf):
    return serving.serve_capped(events_fleet(spark, sf), CAPPED, ["sensor_1"], 60, 30, gapless=True)


@query(
    CAPPED_SQL
    + f"SELECT {metric_sql('least(lifetime % 50 + 1, 30)', 'prediction')} FROM served JOIN life USING (unit_id)"
)
def capped_serving_metrics(spark, sf):
    served = serving.serve_capped(events_fleet(spark, sf), CAPPED, ["sensor_1"], 60, 30, gapless=True)
    labels = event_lifetimes(spark, sf).select("unit_id", (F.col("lifetime") % 50 + 1).alias("true_rul"))
    return metric_rounding(serving.capped_metrics(served, labels, 30))


@query(CAPPED_SQL + "SELECT unit_id + 1 AS unit_id, n_cycles, padded_short, prediction FROM served")
def file_scoring(spark, sf):
    """Write the fleet as a trajectory text file, then score the file."""
    path = new_table_path(spark, "trajectory_text")
    fleet = events_fleet(spark, sf)
    fields = [(F.col("unit_id") + 1).cast("string"), F.col("cycle").cast("string")]
    fields += [F.col(c).cast("string") for c in [*SETTINGS, "sensor_1", "sensor_2"]]
    fleet.select(F.concat_ws("  ", *fields).alias("value")).write.text(path)
    served, _ = serving.score_file(spark, path, CAPPED, ["sensor_1"], 60, 30)
    return served


def _streamed(spark, sf, at):
    """Newest prediction of each unit after streaming the events ordered by ``at``, then event id."""
    source = (
        spark.readStream.schema(table(spark, sf, "events").schema)
        .option("pathGlobFilter", "*.parquet")
        .parquet(f"{sf}/events.parquet*")
    )
    rows = source.select(
        F.col("user_id").alias("unit_id"),
        at.alias("at"),
        "event_id",
        F.col("value").alias("sensor_1"),
        F.get_json_object("props", "$.k").cast("double").alias("sensor_2"),
    )
    scored = scorer.stream_scorer(rows, MIXED, ["sensor_1", "sensor_2"], W, order="at", tie="event_id")
    path = new_table_path(spark, "stream")
    scorer.run_available(scored, path, path + "-checkpoint")
    out = spark.read.parquet(path)
    return out.groupBy("unit_id").agg(
        F.max("engine_age").cast("long").alias("n_cycles"),
        rounded(F.max_by("prediction", "engine_age"), 4).alias("prediction"),
    )


@query(
    """SELECT unit_id, lifetime AS n_cycles, round(66.0 + (-0.93) * lifetime + 0.0217 * sensor_1_mean
    + 0.1317 * sensor_1_std + 0.0113 * sensor_2_latest + 0.7391 * sensor_2_slope, 4) + 0.0 AS prediction
FROM dense JOIN life USING (unit_id) WHERE cycle = lifetime"""
)
def stream_scorer(spark, sf):
    """Stream the events table to its end and keep the newest prediction of each unit."""
    return _streamed(spark, sf, wall_micros("ts"))


@query(
    f""", placed AS (
  SELECT user_id AS unit_id, value AS s1, json_extract_string(props, '$.k')::DOUBLE AS s2,
    count(*) OVER (PARTITION BY user_id) AS n,
    row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts) DESC, event_id DESC) AS back FROM events
), newest AS (SELECT * FROM placed WHERE back <= {W})
SELECT unit_id, n AS n_cycles, round(66.0 + (-0.93) * n + 0.0217 * avg(s1) + 0.1317 * stddev_pop(s1)
  + 0.0113 * max(s2) FILTER (back = 1) + 0.7391 * regr_slope(s2, -back), 4) + 0.0 AS prediction
FROM newest GROUP BY unit_id, n"""
)
def stream_scorer_ties(spark, sf):
    """The stream ordered by day only: ties are broken by event id and every row counts."""
    return _streamed(spark, sf, F.floor(wall_micros("ts") / 86_400_000_000))


# ---- fingerprints and sinks ---------------------------------------------------


@query(
    """SELECT unit_id, unnest([0.1, 0.5, 0.9]::DOUBLE[]) AS prob,
  unnest(quantile_disc(sensor_1, [0.1, 0.5, 0.9])) AS quantile, n
FROM (SELECT unit_id, sensor_1, count(sensor_1) OVER (PARTITION BY unit_id) AS n FROM ev) GROUP BY unit_id, n"""
)
def unit_sketch_quantiles(spark, sf):
    """Quantiles of every unit from its sketch, which has seen too few rows to be inexact."""
    return sketches.quantiles(sketches.unit_sketches(events_fleet(spark, sf), "sensor_1"), [0.1, 0.5, 0.9])


@query()
def fleet_sketch_quantiles(spark, sf):
    """Quantiles of sensors over the fleet and per returned-item code, merged from sketches per unit and code."""
    fleet = supplier_fleet(spark, sf)
    per_unit = sketches.unit_sketches(fleet, "sensor_2", ["unit_id", "setting_2"])
    coded = sketches.quantiles(sketches.merged(per_unit, ["setting_2"]), [0.25, 0.5, 0.75])
    whole = sketches.quantiles(sketches.merged(per_unit), [0.25, 0.5, 0.75])
    return coded.unionByName(whole.withColumn("setting_2", F.lit(None).cast("double")))


TREE_SQL = """, r AS (SELECT sha256(unit_id::VARCHAR) AS place,
    sha256(concat_ws(chr(31), unit_id, cycle, printf('%g', sensor_1), printf('%g', sensor_2))) AS h FROM ev
), counted AS (SELECT place[1:2] AS node, h, count(*) AS n FROM r GROUP BY ALL
), leaves AS (
  SELECT 2 AS level, node, sum(n)::BIGINT AS rows, sha256(string_agg(h || ':' || n, ',' ORDER BY h || ':' || n)) AS sha256
  FROM counted GROUP BY node
), middle AS (
  SELECT 1 AS level, node[1:1] AS node, sum(rows)::BIGINT AS rows, sha256(string_agg(node || ':' || sha256, ',' ORDER BY node)) AS sha256
  FROM leaves GROUP BY node[1:1]
), root AS (
  SELECT 0 AS level, '' AS node, sum(rows)::BIGINT AS rows, sha256(string_agg(node || ':' || sha256, ',' ORDER BY node)) AS sha256 FROM middle
), tree AS (FROM leaves UNION ALL FROM middle UNION ALL FROM root)
"""


def _hashed_events(spark, sf) -> DataFrame:
    return events_fleet(spark, sf).select("unit_id", "cycle", "sensor_1", "sensor_2")


@query(TREE_SQL + "SELECT level, node, rows, sha256 FROM tree")
def tree_hash(spark, sf):
    return fingerprint.tree_hash(_hashed_events(spark, sf), depth=2, by=["unit_id"])


@query(
    """, u AS (SELECT unit_id FROM ev GROUP BY unit_id HAVING max(cycle) % 7 = 0), leaf AS (
  SELECT DISTINCT sha256(unit_id::VARCHAR)[1:2] AS node FROM u
), sized AS (
  SELECT sha256(unit_id::VARCHAR)[1:2] AS node, count(*) AS n, count(*) FILTER (NOT (unit_id IN (FROM u) AND cycle = 3)) AS m
  FROM ev GROUP BY 1
)
SELECT 2 AS level, node, n AS rows_before, m AS rows_after FROM sized WHERE node IN (FROM leaf)"""
)
def tree_changes(spark, sf):
    """The third cycle of some units is taken away; the tree tells in which leaves."""
    rows = _hashed_events(spark, sf)
    lives = event_lifetimes(spark, sf).filter(F.col("lifetime") % 7 == 0).select("unit_id", F.lit(3).alias("cycle"))
    less = rows.join(lives, ["unit_id", "cycle"], "left_anti").select(*rows.columns)
    trees = [fingerprint.tree_hash(df, depth=2, by=["unit_id"]) for df in (rows, less)]
    return fingerprint.tree_changes(*trees).filter(F.col("level") == 2)


@query(
    """, h AS (SELECT ('0x' || substr(md5(concat_ws(chr(31), unit_id, cycle, printf('%g', sensor_1), printf('%g', sensor_2),
    printf('%g', round(sensor_2 / 7, 6)))), 1, 15))::BIGINT AS x FROM ev)
SELECT count(*) AS rows, bit_xor(x) AS row_xor, (sum(x) % 2305843009213693952)::BIGINT AS row_sum FROM h"""
)
def table_fingerprint(spark, sf):
    rows = events_fleet(spark, sf).select(
        "unit_id", "cycle", "sensor_1", "sensor_2", F.round(F.col("sensor_2") / 7, 6).alias("ratio")
    )
    return fingerprint.table_fingerprint(rows)


@query(
    """SELECT count(*) AS rows, sha256('unit_id,full_lifetime,cutoff_cycle,true_raw_rul,fraction' || chr(10) ||
  string_agg(concat_ws(',', unit_id, full_lifetime, cutoff_cycle, true_raw_rul, printf('%g', fraction)) || chr(10), ''
    ORDER BY unit_id, full_lifetime, cutoff_cycle, true_raw_rul)) AS sha256 FROM man"""
)
def manifest_hash(spark, sf):
    return fingerprint.canonical_hash(event_manifest(spark, sf))


@query("SELECT unnest(['balanced', 'late']) AS \"table\", unnest([true, false]) AS passed")
def verify_fingerprints(spark, sf):
    """The late manifest is compared with the record of the balanced one and must fail."""
    balanced = fingerprint.table_fingerprint(event_manifest(spark, sf))
    late = fingerprint.table_fingerprint(event_manifest(spark, sf, checkpoints.LATE_FRACTIONS))
    recorded = balanced.withColumn("table", F.explode(F.array(F.lit("balanced"), F.lit("late"))))
    fresh = balanced.withColumn("table", F.lit("balanced")).unionByName(late.withColumn("table", F.lit("late")))
    return fingerprint.verify_fingerprints(recorded, fresh)


@query("SELECT unit_id, lifetime FROM life")
def append_new_rows(spark, sf):
    """Two overlapping appends and a repeat leave every unit stored once."""
    path = new_table_path(spark, "append")
    life = event_lifetimes(spark, sf)
    sinks.append_new(life.filter(F.col("lifetime") % 3 != 0), path, ["unit_id"])
    sinks.append_new(life.filter(F.col("lifetime") % 2 == 0), path, ["unit_id"])
    return sinks.append_new(life, path, ["unit_id"])


@query(
    """SELECT unit_id, full_lifetime::INT AS full_lifetime, cutoff_cycle::INT AS cutoff_cycle,
  true_raw_rul::INT AS true_raw_rul, fraction FROM man"""
)
def manifest_csv_round_trip(spark, sf):
    path = manifests.write_manifest(event_manifest(spark, sf), new_table_path(spark, "manifest"))
    return manifests.read_manifest(spark, path)


@query("SELECT * FROM split3")
def split_round_trip(spark, sf):
    path = manifests.write_split(split3(spark, sf), new_table_path(spark, "split"))
    return manifests.read_split(spark, path).select("unit_id", "role")


@query("SELECT * FROM split3")
def split_json_round_trip(spark, sf):
    path = new_table_path(spark, "split_json")
    manifests.split_document(split3(spark, sf), seed=42).write.json(path)
    return manifests.read_split_json(spark, path)


@query(
    """SELECT role AS split, count(*) AS windows, count(*) FILTER (n_observed < 30) AS padded
FROM padded_windows JOIN split3 USING (unit_id) GROUP BY role"""
)
def sequence_dataset(spark, sf):
    """Window dataset written per role and read back."""
    rows = attach_units(events_fleet(spark, sf), split3(spark, sf)).withColumnRenamed("role", "split")
    seqs = windows.sequence_windows(rows, ["sensor_1", "sensor_2"], W, keep=["split"], gapless=True)
    root = new_table_path(spark, "sequences")
    path = sinks.write_sequences(seqs, sinks.variant_path(root, W, None, "all"), "split")
    stored = spark.read.parquet(path)
    return stored.groupBy("split").agg(
        F.count(F.lit(1)).alias("windows"), F.count_if("padded").alias("padded")
    )


@query(
    """SELECT candidate_id, fold::VARCHAR AS fold, '' AS notes, units::VARCHAR AS units FROM fold_table"""
)
def curated_results(spark, sf):
    return sinks.project_columns(fold_table(spark, sf), ["candidate_id", "fold", "notes", "units"])


@query("SELECT row_number() OVER (ORDER BY unit_id) AS unit_id, lifetime::INT AS true_rul FROM life")
def label_parts_round_trip(spark, sf):
    """A label folder of three unequal files keeps its line order."""
    path = new_table_path(spark, "label_parts")
    life = event_lifetimes(spark, sf)
    top = life.agg(F.max("unit_id").alias("_top"))
    share = F.col("unit_id") / F.col("_top")
    part = F.when(share < 0.05, "a").when(share < 0.3, "b").otherwise("c")
    lines = life.crossJoin(F.broadcast(top)).select(
        "unit_id", F.col("lifetime").cast("string").alias("value"), part.alias("part")
    )
    ordered = lines.repartitionByRange("part", "unit_id").sortWithinPartitions("part", "unit_id")
    ordered.select("value", "part").write.partitionBy("part").text(path)
    return text.read_labels(spark, path)


@query("SELECT unit_id, fold::INT AS fold, role FROM assigned")
def folds_round_trip(spark, sf):
    """Cross-validation assignments written per fold and read back."""
    path = manifests.write_folds(splits.fold_assignments(dev_folds(spark, sf), FOLDS), new_table_path(spark, "folds"))
    return manifests.read_folds(spark, path)


@query("SELECT unit_id, lifetime FROM life WHERE lifetime % 3 <> 0")
def append_rejects_duplicates(spark, sf):
    """An append that would store a key twice is rejected as a whole."""
    path = new_table_path(spark, "append")
    life = event_lifetimes(spark, sf)
    sinks.append_new(life.filter(F.col("lifetime") % 3 != 0), path, ["unit_id"], on_duplicate="fail")
    try:
        sinks.append_new(life, path, ["unit_id"], on_duplicate="fail")
    except ValueError:
        return spark.read.parquet(path)
    raise AssertionError("the second append was not rejected")


@query(
    """SELECT unit_id, role, full_lifetime, cutoff_cycle, true_raw_rul, fraction FROM man JOIN split3 USING (unit_id)
WHERE role = 'calibration'"""
)
def calibration_manifest(spark, sf):
    return checkpoints.manifests_by_role(event_lifetimes(spark, sf), split3(spark, sf), roles=("calibration",))


@query("SELECT unit_id, full_lifetime, cutoff_cycle, true_raw_rul, fraction, fold::INT AS fold FROM man JOIN folds USING (unit_id)")
def fold_manifest_union(spark, sf):
    """Manifests of the held-out units, fold by fold, stacked."""
    folds = dev_folds(spark, sf)
    parts = {
        f: checkpoints.checkpoint_manifest(
            event_lifetimes(spark, sf).join(folds.filter(F.col("fold") == f).select("unit_id"), "unit_id")
        )
        for f in range(1, FOLDS + 1)
    }
    return checkpoints.union_folds(parts)


@query(
    """SELECT "check", n = 0 AS passed, n AS offending FROM (
  SELECT 'roles_disjoint' AS "check", count(*) AS n FROM (SELECT unit_id FROM split3 GROUP BY ALL HAVING count(DISTINCT role) > 1)
  UNION ALL SELECT 'all_units_assigned', count(*) FROM (
    SELECT DISTINCT l_suppkey AS unit_id FROM lineitem EXCEPT SELECT unit_id FROM split3)
  UNION ALL SELECT 'no_unknown_units', count(*) FROM (
    SELECT unit_id FROM split3 EXCEPT SELECT l_suppkey FROM lineitem))"""
)
def split_against_frame(spark, sf):
    """The events split held against the units of another frame, which it does not cover."""
    frame = supplier_fleet(spark, sf)
    return splits.check_assignments(split3(spark, sf), frame.select("unit_id"))


@query(
    """SELECT unit_id, cutoff_cycle, true_raw_rul, fraction, round(2 * avg(sensor_1) + 0.5 * cutoff_cycle + count(*), 6) + 0.0 AS prediction
FROM man JOIN ev USING (unit_id) WHERE cycle <= cutoff_cycle AND cycle > cutoff_cycle - 30
GROUP BY unit_id, cutoff_cycle, true_raw_rul, fraction"""
)
def callable_evaluation(spark, sf):
    """Any Python scorer over the last rows before each checkpoint, behind a preprocessing step."""
    scored = evaluate.evaluate_with_callable(
        events_fleet(spark, sf).select("unit_id", "cycle", "sensor_1"),
        event_manifest(spark, sf),
        lambda history, cutoff: float(history["twice"].mean() + 0.5 * cutoff + len(history)),
        W,
        preprocess=lambda history: history.assign(twice=history["sensor_1"] * 2),
    )
    return rounding(
        scored.select("unit_id", "cutoff_cycle", "true_raw_rul", "fraction", "prediction"), ["prediction"]
    )


@query(
    f""", fit AS (SELECT f.fold AS fold, avg(rul) AS mean FROM evr JOIN folds h USING (unit_id)
  JOIN (SELECT DISTINCT fold FROM folds) f ON f.fold <> h.fold GROUP BY f.fold)
SELECT 'mean_w30' AS candidate_id, folds.fold::INT AS fold, {metric_sql('true_raw_rul', 'mean')}
FROM man JOIN folds USING (unit_id) JOIN fit ON fit.fold = folds.fold GROUP BY folds.fold"""
)
def resumed_cv(spark, sf):
    """A cross-validation that stops after two folds and is resumed in the same folder."""
    store = new_table_path(spark, "cv")
    candidates = [flows.Candidate("mean_w30", "mean", W)]
    folds, fleet = dev_folds(spark, sf), events_fleet(spark, sf)
    flows.group_cv(fleet, folds, 2, candidates, ["sensor_1"], store=store)
    _, predictions = flows.group_cv(fleet, folds, FOLDS, candidates, ["sensor_1"], store=store)
    return metric_rounding(evaluate.metrics(predictions, by=["candidate_id", "fold"]))


@query(
    """SELECT unit_id + 1 AS unit_id, cycle, setting_1, setting_2, setting_3, sensor_1, sensor_2 FROM ev"""
)
def trajectory_text_round_trip(spark, sf):
    path = new_table_path(spark, "text")
    fleet = events_fleet(spark, sf)
    fields = [(F.col("unit_id") + 1).cast("string"), F.col("cycle").cast("string")]
    fields += [F.col(c).cast("string") for c in [*SETTINGS, "sensor_1", "sensor_2"]]
    fleet.select(F.concat(F.concat_ws("   ", *fields), F.lit("  ")).alias("value")).write.text(path)
    return text.read_trajectories(spark, path, width=7).drop("row_idx")


@query("SELECT row_number() OVER (ORDER BY unit_id) AS unit_id, lifetime::INT AS true_rul FROM life")
def label_file_round_trip(spark, sf):
    path = new_table_path(spark, "labels")
    ordered = event_lifetimes(spark, sf).orderBy("unit_id")
    ordered.select(F.col("lifetime").cast("string").alias("value")).write.text(path)
    return text.read_labels(spark, path)


@query("SELECT count(*) AS rows, min(cycle) AS first_cycle, max(sensor_1) AS top FROM ev")
def canonical_upload(spark, sf):
    """A positional frame is renamed to the canonical layout."""
    fleet = events_fleet(spark, sf)
    loose = fleet.select("unit_id", "cycle", *SETTINGS, "sensor_1").toDF(*[str(i) for i in range(6)])
    named = text.canonical_columns(loose)
    return named.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("cycle").alias("first_cycle"),
        F.max("sensor_1").alias("top"),
    )


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Fleet, targets, checkpoints, history features, mean baseline, metrics per fraction."""
    fleet = events_fleet(spark, sf)
    mean = models.fit_model("mean", target.add_target(fleet), [])
    held = features.features_at(fleet, event_manifest(spark, sf), ["sensor_1", "sensor_2"], W, gapless=True)
    return evaluate.metrics(models.predict(held, mean), by=["fraction"])


@query(
    f""", m AS (SELECT avg(rul) AS mean FROM evr)
SELECT fraction, {metric_sql('true_raw_rul', 'mean')} FROM man, m GROUP BY fraction"""
)
def mean_baseline_by_fraction(spark, sf):
    return metric_rounding(flagship(spark, sf))
