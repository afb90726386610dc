"""Common table expressions shared by the oracle statements."""

from __future__ import annotations

SENSORS = ("sensor_1", "sensor_2", "sensor_3", "sensor_4")


def windowed_features(alias: str, cols, frame: str) -> str:
    """Feature columns over a named window frame ``frame`` for rows of ``alias``."""
    parts = []
    for c in cols:
        parts += [
            f"{c} AS {c}_latest",
            f"avg({c}) OVER {frame} AS {c}_mean",
            f"stddev_pop({c}) OVER {frame} AS {c}_std",
            f"min({c}) OVER {frame} AS {c}_min",
            f"max({c}) OVER {frame} AS {c}_max",
            f"CASE WHEN count(*) OVER {frame} > 1 THEN regr_slope({c}, cycle::DOUBLE) OVER {frame} ELSE 0 END AS {c}_slope",
            f"{c} - first_value({c}) OVER {frame} AS {c}_delta",
            f"CASE WHEN count(*) OVER {frame} >= 5 THEN avg({c}) OVER f5 ELSE {c} END AS {c}_last5_mean",
            f"CASE WHEN count(*) OVER {frame} >= 10 THEN avg({c}) OVER f10 ELSE {c} END AS {c}_last10_mean",
        ]
    return ",\n".join(parts)


WINDOWS = """
WINDOW f5 AS (PARTITION BY unit_id ORDER BY cycle ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
       f10 AS (PARTITION BY unit_id ORDER BY cycle ROWS BETWEEN 9 PRECEDING AND CURRENT ROW),
       f30 AS (PARTITION BY unit_id ORDER BY cycle ROWS BETWEEN 29 PRECEDING AND CURRENT ROW),
       f45 AS (PARTITION BY unit_id ORDER BY cycle ROWS BETWEEN 44 PRECEDING AND CURRENT ROW),
       fall AS (PARTITION BY unit_id ORDER BY cycle ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""

COMMON = f"""
WITH ev AS (
  SELECT user_id AS unit_id,
         row_number() OVER w AS cycle,
         hour(ts)::DOUBLE AS setting_1,
         (dayofweek(ts) + 1)::DOUBLE AS setting_2,
         (CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3
                          WHEN 'signup' THEN 4 WHEN 'view' THEN 5 ELSE 0 END)::DOUBLE AS setting_3,
         value AS sensor_1,
         json_extract(props, '$.k')::DOUBLE AS sensor_2,
         coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6, 0.0) AS sensor_3,
         1.0::DOUBLE AS sensor_4
  FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), sup AS (
  SELECT l_suppkey AS unit_id,
         row_number() OVER (PARTITION BY l_suppkey
           ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS cycle,
         month(l_shipdate)::DOUBLE AS setting_1,
         (CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 WHEN 'R' THEN 3 ELSE 0 END)::DOUBLE AS setting_2,
         (CASE l_linestatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END)::DOUBLE AS setting_3,
         l_quantity AS sensor_1, l_extendedprice AS sensor_2, l_discount AS sensor_3, l_tax AS sensor_4
  FROM lineitem
), raw AS (
  SELECT user_id AS unit_id, (epoch_us(ts) // 3600000000) AS cycle, value AS sensor_1,
         json_extract(props, '$.k')::DOUBLE AS sensor_2, 1.0::DOUBLE AS sensor_4, event_id AS row_idx
  FROM events
), life AS (
  SELECT unit_id, max(cycle)::BIGINT AS lifetime FROM ev GROUP BY unit_id
), suplife AS (
  SELECT unit_id, max(cycle)::BIGINT AS lifetime FROM sup GROUP BY unit_id
), evr AS (
  SELECT ev.*, lifetime, lifetime - cycle AS rul FROM ev JOIN life USING (unit_id)
), ranked AS (
  SELECT unit_id, row_number() OVER (ORDER BY md5(unit_id || ':42'), unit_id) AS rank,
         count(*) OVER () AS n FROM life
), split2 AS (
  SELECT unit_id, CASE WHEN rank <= round_even(n * 0.2::DOUBLE, 0) THEN 'validation' ELSE 'train' END AS role
  FROM ranked
), split3 AS (
  SELECT unit_id, CASE WHEN rank <= round_even(n * 0.15::DOUBLE, 0) THEN 'validation'
                       WHEN rank <= 2 * round_even(n * 0.15::DOUBLE, 0) THEN 'calibration'
                       ELSE 'train' END AS role
  FROM ranked
), dev AS (
  SELECT unit_id FROM split3 WHERE role <> 'calibration'
), folds AS (
  SELECT unit_id, ntile(4) OVER (ORDER BY md5(unit_id || ':42'), unit_id) AS fold FROM dev
), assigned AS (
  SELECT unit_id, f.fold AS fold,
         CASE WHEN folds.fold = f.fold THEN 'outer_eval' ELSE 'outer_train' END AS role
  FROM folds CROSS JOIN (SELECT unnest(range(1, 5)) AS fold) f
), inner_ranked AS (
  SELECT unit_id, fold,
         row_number() OVER (PARTITION BY fold ORDER BY md5(unit_id || ':' || (4200 + fold)), unit_id) AS rank,
         count(*) OVER (PARTITION BY fold) AS n
  FROM assigned WHERE role = 'outer_train'
), inner_roles AS (
  SELECT unit_id, fold, CASE WHEN rank <= n - greatest(n // 7, 1) THEN 'inner_fit' ELSE 'inner_stop' END AS role
  FROM inner_ranked
), fractions AS (
  SELECT unnest([0.25, 0.45, 0.65, 0.80, 0.95]::DOUBLE[]) AS fraction
), late_fractions AS (
  SELECT unnest([0.50, 0.65, 0.80, 0.90, 0.95]::DOUBLE[]) AS fraction
), man AS (
  SELECT unit_id, lifetime AS full_lifetime,
         least(greatest(round_even(fraction * lifetime, 0)::BIGINT, 1), lifetime - 1) AS cutoff_cycle,
         lifetime - least(greatest(round_even(fraction * lifetime, 0)::BIGINT, 1), lifetime - 1) AS true_raw_rul,
         fraction
  FROM life CROSS JOIN fractions
), latman AS (
  SELECT unit_id, lifetime AS full_lifetime,
         least(greatest(round_even(fraction * lifetime, 0)::BIGINT, 1), lifetime - 1) AS cutoff_cycle,
         lifetime - least(greatest(round_even(fraction * lifetime, 0)::BIGINT, 1), lifetime - 1) AS true_raw_rul,
         fraction
  FROM life CROSS JOIN late_fractions
), dense AS (
  SELECT unit_id, cycle,
         {windowed_features("ev", ("sensor_1", "sensor_2", "sensor_3"), "f30")},
         count(*) OVER f30 AS history_length
  FROM ev {WINDOWS}
), full_dense AS (
  SELECT unit_id, cycle,
         {windowed_features("ev", ("sensor_1", "sensor_2", "sensor_3"), "fall")},
         count(*) OVER fall AS history_length
  FROM ev {WINDOWS}
), feats AS (
  SELECT man.*, d.* EXCLUDE (unit_id, cycle), man.cutoff_cycle::DOUBLE AS engine_age
  FROM man JOIN dense d ON d.unit_id = man.unit_id AND d.cycle = man.cutoff_cycle
), full_feats AS (
  SELECT man.*, d.* EXCLUDE (unit_id, cycle), man.cutoff_cycle::DOUBLE AS engine_age
  FROM man JOIN full_dense d ON d.unit_id = man.unit_id AND d.cycle = man.cutoff_cycle
), pred AS (
  SELECT unit_id, full_lifetime, cutoff_cycle, true_raw_rul, fraction,
         66.0 + (-0.93) * engine_age + 0.0217 * sensor_1_mean + 0.1317 * sensor_1_std
               + 0.0113 * sensor_2_latest + 0.7391 * sensor_2_slope AS prediction
  FROM feats
), cand AS (
  SELECT 'age' AS candidate_id, unit_id, cutoff_cycle, true_raw_rul, fraction,
         66.0 + (-0.93) * engine_age + 0.1317 * sensor_1_std AS prediction FROM feats
  UNION ALL
  SELECT 'mixed', unit_id, cutoff_cycle, true_raw_rul, fraction,
         66.0 + (-0.93) * engine_age + 0.0217 * sensor_1_mean + 0.1317 * sensor_1_std
               + 0.0113 * sensor_2_latest + 0.7391 * sensor_2_slope FROM feats
  UNION ALL
  SELECT 'shallow', unit_id, cutoff_cycle, true_raw_rul, fraction,
         52.0 + (-0.61) * engine_age + 0.1931 * sensor_2_std FROM feats
), fold_pred AS (
  SELECT cand.*, fold FROM cand JOIN folds USING (unit_id)
), unit_rows AS (
  SELECT candidate_id, fold, unit_id, count(*) AS n_checkpoints,
         sqrt(avg((prediction - true_raw_rul) ** 2)) AS rmse,
         avg(abs(prediction - true_raw_rul)) AS mae,
         sum(CASE WHEN prediction - true_raw_rul < 0 THEN exp(-(prediction - true_raw_rul) / 13.0)
                  ELSE exp((prediction - true_raw_rul) / 10.0) END - 1) AS score_sum,
         avg(prediction - true_raw_rul) AS bias
  FROM fold_pred GROUP BY candidate_id, fold, unit_id
), fold_metrics AS (
  SELECT candidate_id, fold, sqrt(avg((prediction - true_raw_rul) ** 2)) AS rmse,
         avg(abs(prediction - true_raw_rul)) AS mae,
         1 - sum((prediction - true_raw_rul) ** 2) / (count(*) * var_pop(true_raw_rul)) AS r2,
         sum(CASE WHEN prediction - true_raw_rul < 0 THEN exp(-(prediction - true_raw_rul) / 13.0)
                  ELSE exp((prediction - true_raw_rul) / 10.0) END - 1) AS score_total,
         avg(prediction - true_raw_rul) AS bias
  FROM fold_pred GROUP BY candidate_id, fold
), fold_table AS (
  SELECT fold_metrics.*, score_per_unit, units FROM fold_metrics JOIN (
    SELECT candidate_id, fold, avg(score_sum) AS score_per_unit, count(*) AS units
    FROM unit_rows GROUP BY candidate_id, fold) USING (candidate_id, fold)
), summary AS (
  SELECT candidate_id, count(*) AS folds,
         round(avg(rmse), 4) AS rmse_mean, round(stddev_samp(rmse), 4) AS rmse_std,
         round(avg(mae), 4) AS mae_mean, round(stddev_samp(mae), 4) AS mae_std,
         round(avg(r2), 4) AS r2_mean, round(stddev_samp(r2), 4) AS r2_std,
         round(avg(score_total), 4) AS score_total_mean, round(stddev_samp(score_total), 4) AS score_total_std,
         round(avg(score_per_unit), 4) AS score_per_unit_mean,
         round(stddev_samp(score_per_unit), 4) AS score_per_unit_std,
         round(avg(bias), 4) + 0.0 AS bias_mean, round(stddev_samp(bias), 4) AS bias_std
  FROM fold_table GROUP BY candidate_id
), cal AS (
  SELECT pred.* FROM pred JOIN split3 USING (unit_id) WHERE role = 'calibration'
), cal_units AS (
  SELECT unit_id, max(abs(prediction - true_raw_rul)) AS score FROM cal GROUP BY unit_id
), alphas AS (
  SELECT unnest([0.1, 0.2, 0.3]::DOUBLE[]) AS alpha
), unit_q AS (
  SELECT alpha, n, k, score AS q FROM (
    SELECT alpha, n, least(greatest(ceil((n + 1) * (1.0::DOUBLE - alpha)), 1), n)::BIGINT AS k
    FROM alphas CROSS JOIN (SELECT count(*) AS n FROM cal_units)) a
  JOIN (SELECT score, row_number() OVER (ORDER BY score) AS r FROM cal_units) s ON s.r = a.k
), row_q AS (
  SELECT alpha, n, e AS q FROM (
    SELECT alpha, n, ceil((n - 1) * ((n + 1) * (1.0::DOUBLE - alpha) / n))::BIGINT + 1 AS k
    FROM alphas CROSS JOIN (SELECT count(*) AS n FROM cal)) a
  JOIN (SELECT abs(prediction - true_raw_rul) AS e,
               row_number() OVER (ORDER BY abs(prediction - true_raw_rul)) AS r FROM cal) s ON s.r = a.k
), cuts AS (
  SELECT unit_id, cutoff_cycle AS observed_cycles, true_raw_rul AS true_rul
  FROM man WHERE fraction = 0.65::DOUBLE
), term AS (
  SELECT pred.unit_id, observed_cycles, true_rul, observed_cycles + true_rul AS implied_failure_cycle, prediction
  FROM pred JOIN cuts ON cuts.unit_id = pred.unit_id AND cuts.observed_cycles = pred.cutoff_cycle
), val AS (
  SELECT pred.unit_id, cutoff_cycle AS observed_cycles, true_raw_rul AS true_rul, prediction
  FROM pred JOIN split3 USING (unit_id) WHERE role = 'validation'
), samples AS (
  SELECT 'official' AS sample, unit_id, observed_cycles, true_rul, prediction FROM term
  UNION ALL SELECT 'validation', unit_id, observed_cycles, true_rul, prediction FROM val
), errs AS (
  SELECT *, prediction - true_rul AS error, abs(prediction - true_rul) AS abs_error,
         CASE WHEN prediction - true_rul < 0 THEN exp(-(prediction - true_rul) / 13.0)
              ELSE exp((prediction - true_rul) / 10.0) END - 1 AS score_point
  FROM samples
), padded_windows AS (
  SELECT unit_id, cycle AS end_cycle, lifetime,
         count(*) OVER f30 AS n_observed,
         sum(sensor_1) OVER f30 AS s1, sum(sensor_2) OVER f30 AS s2
  FROM evr {WINDOWS}
), legacy_base AS (
  SELECT man.unit_id, man.cutoff_cycle, ev.cycle, ev.sensor_1 AS x,
         45 - (man.cutoff_cycle - ev.cycle) - 1 AS slot
  FROM man JOIN ev ON ev.unit_id = man.unit_id AND ev.cycle <= man.cutoff_cycle AND ev.cycle > man.cutoff_cycle - 45
), slots AS (
  SELECT DISTINCT unit_id, cutoff_cycle, s.slot FROM man CROSS JOIN (SELECT unnest(range(0, 45)) AS slot) s
), legacy AS (
  SELECT slots.unit_id, slots.cutoff_cycle, slots.slot, coalesce(x, 0.0) AS x
  FROM slots LEFT JOIN legacy_base b
    ON b.unit_id = slots.unit_id AND b.cutoff_cycle = slots.cutoff_cycle AND b.slot = slots.slot
)
"""


def metric_sql(y: str, p: str, prefix: str = "") -> str:
    e = f"(({p}) - ({y}))"
    return f"""
  round(sqrt(avg({e} ** 2)), 6) AS {prefix}rmse,
  round(avg(abs({e})), 6) AS {prefix}mae,
  round(1 - sum({e} ** 2) / (count(*) * var_pop(({y})::DOUBLE)), 6) + 0.0 AS {prefix}r2,
  round(sum(CASE WHEN {e} < 0 THEN exp(-{e} / 13.0) ELSE exp({e} / 10.0) END - 1), 4) AS {prefix}score_total,
  round(avg(CASE WHEN {e} < 0 THEN exp(-{e} / 13.0) ELSE exp({e} / 10.0) END - 1), 6) AS {prefix}score_mean,
  round(avg({e}), 6) + 0.0 AS {prefix}bias,
  round(stddev_pop({p}), 6) AS {prefix}prediction_std,
  count(*) AS {prefix}n"""
