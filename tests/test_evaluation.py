import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wearmark.operators import conformal, errors, evaluate, models, selection


def pairs(spark, y, p):
    return spark.createDataFrame(list(zip(map(float, y), map(float, p))), "true_raw_rul double, prediction double")


def test_metric_closed_forms(spark):
    m = evaluate.metrics(pairs(spark, [1, 2, 3], [1, 2, 4])).first()
    assert m["rmse"] == pytest.approx(math.sqrt(1 / 3)) and m["mae"] == pytest.approx(1 / 3)
    assert m["r2"] == pytest.approx(0.5)
    assert evaluate.metrics(pairs(spark, [5, 5], [4, 6])).first()["r2"] is None
    assert evaluate.metrics(pairs(spark, [1, 9], [1, 9])).first()["score_total"] == 0
    s = evaluate.metrics(pairs(spark, [10, 10], [12, 8])).first()
    assert s["score_total"] == pytest.approx(math.exp(0.2) + math.exp(2 / 13) - 2)


def test_clipped_and_raw(spark):
    df = pairs(spark, [10, 100], [10, 50]).withColumnRenamed("true_raw_rul", "true_rul")
    m = evaluate.clipped_and_raw_metrics(df, 50).first()
    assert m["clipped_rmse"] == 0 and m["raw_mae"] == 25


def test_manifest_evaluation_needs_every_line(spark, ramp):
    model = models.FormulaModel(0.0, {"f1_latest": 1.0})
    manifest = spark.createDataFrame([(4, 77), (3, 10), (1, 1)], "unit_id long, cutoff_cycle long")
    got = evaluate.evaluate_manifest(ramp, manifest, model, ["f1"], 30, gapless=True, segment_rows=32)
    assert {r["unit_id"]: r["prediction"] for r in got.collect()} == {4: 77.0, 3: 10.0, 1: 1.0}
    lost = manifest.unionByName(spark.createDataFrame([(99, 5)], manifest.schema))
    with pytest.raises(Exception, match="no prediction for unit 99"):
        evaluate.evaluate_manifest(ramp, lost, model, ["f1"], 30, gapless=True).collect()


def test_callable_sees_no_future_rows(spark, ramp):
    manifest = spark.createDataFrame([(4, 77), (2, 3), (4, 33)], "unit_id long, cutoff_cycle long")
    got = evaluate.evaluate_with_callable(
        ramp, manifest, lambda h, cutoff: h["f1"].max() * 1000 + len(h), 20,
        preprocess=lambda h: h.assign(f1=h["f1"] + 0), segment_rows=32,
    )
    assert {(r[0], r[1]): r["prediction"] for r in got.collect()} == {
        (4, 77): 77020.0, (2, 3): 3003.0, (4, 33): 33020.0
    }


def test_callable_gets_many_checkpoints_a_frame(spark, ramp):
    manifest = ramp.filter("cycle % 3 = 0").select("unit_id", F.col("cycle").alias("cutoff_cycle"))
    got = evaluate.evaluate_with_callable(ramp, manifest, lambda h, cutoff: h["f1"].sum() + 1000 * len(h), 20, segment_rows=32)
    assert "MapInPandas" in got._jdf.queryExecution().toString()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("7", before):  # checkpoints cross the borders of frames
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            rows = got.collect()
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        assert len(rows) == manifest.count()
        for r in rows:
            seen = range(max(1, r["cutoff_cycle"] - 19), r["cutoff_cycle"] + 1)
            assert r["prediction"] == sum(seen) + 1000 * len(seen)


def test_terminal_evaluation(spark, ramp):
    labels = spark.createDataFrame([(i, 10 * i) for i in (1, 2, 3, 4)], "unit_id long, true_rul long")
    got = evaluate.evaluate_terminal(ramp, labels, models.FormulaModel(0.0, {"f1_latest": 1.0}), ["f1"], gapless=True)
    assert {r["unit_id"]: r["prediction"] for r in got.collect()} == {1: 40, 2: 35, 3: 10, 4: 120}
    broken = models.FormulaModel(float("inf"), {})
    with pytest.raises(Exception, match="not finite"):
        evaluate.evaluate_terminal(ramp, labels, broken, ["f1"], gapless=True).collect()


def test_drift_and_falsification(spark):
    df = pairs(spark, [1, 2, 3], [1, 2, 4]).withColumn("variant", F.lit("A"))
    stored = evaluate.metrics(df, by=["variant"])
    assert all(r["passed"] for r in evaluate.falsify(df, stored, ["variant"]).collect())
    wrong = stored.withColumn("rmse", F.col("rmse") + 0.01)
    bad = [r["metric"] for r in evaluate.falsify(df, wrong, ["variant"]).collect() if not r["passed"]]
    assert bad == ["rmse"]


# ---- selection ----

POLICY = "candidate_id string, score_per_unit_mean double, score_per_unit_std double, rmse_mean double, bias_mean double"


def chosen(spark, rows):
    return {r["candidate_id"] for r in selection.select_candidate(spark.createDataFrame(rows, POLICY)).filter("selected").collect()}


def test_selection_rule(spark):
    assert chosen(spark, [("a", 100.0, 5.0, 10.0, 0.0), ("b", 20.0, 5.0, 30.0, 0.0)]) == {"b"}
    assert chosen(spark, [("a", 20.0, 50.0, 25.0, 0.0), ("b", 30.0, 50.0, 22.0, 0.0)]) == {"b"}
    assert chosen(spark, [("a", 20.0, 50.0, 25.0, -20.0), ("b", 21.0, 50.0, 25.0, 1.0)]) == {"b"}
    assert chosen(spark, [("a", 20.0, None, 25.0, 0.0), ("b", 20.5, None, 2.0, 0.0)]) == {"a"}


def test_completeness_and_summary(spark):
    rows = [(f"c{i}", f, "rf" if f > 1 else "first", float(f), float(f * i)) for i in range(2) for f in range(1, 6)]
    df = spark.createDataFrame(rows, "candidate_id string, fold int, model string, rmse double, score_per_unit double")
    names = spark.createDataFrame([("c0",), ("c1",)], "candidate_id string")
    assert selection.cv_gaps(df, names).isEmpty()
    assert [r["problem"] for r in selection.cv_gaps(df.filter("not (candidate_id = 'c1' and fold = 3)"), names).collect()] == ["missing"]
    assert [r["problem"] for r in selection.cv_gaps(df.unionByName(df.filter("candidate_id = 'c0' and fold = 5")), names).collect()] == ["repeated"]
    s = {r["candidate_id"]: r for r in selection.cv_summary(df).collect()}
    assert s["c1"]["rmse_mean"] == 3.0 and s["c1"]["rmse_std"] == 1.5811 and s["c1"]["model"] == "first"


def test_final_rounds(spark):
    df = spark.createDataFrame(
        [("x", f, e, i) for f, (e, i) in enumerate(zip([12, 15, 14, 13, 16], [40, 44, 42, 41, 43]), 1)],
        "candidate_id string, fold int, best_epoch int, best_iteration int",
    )
    assert selection.final_rounds(df, "best_epoch").first()["rounds"] == 14
    assert selection.final_rounds(df).first()["rounds"] == 43


def test_labels_and_counts(spark):
    df = spark.createDataFrame(
        [("gru", "variant=w90_c45_all loss=huber"), ("xgboost", "variant=w90_c125_varying"), ("rf", "plain"),
         ("lstm", "variant=w90_cnone_all loss=mse"), ("rf", "variant=w90_c125_none")],
        "model string, notes string",
    )
    runs = selection.parse_runs(df, "w30_c125_all")
    baseline = {"window": "90", "cap": "125", "sensors": "all", "loss": "mse"}
    got = {(r["model"], r["factor"], r["changed"]) for r in selection.label_changes(runs, baseline).collect()}
    assert got == {
        ("gru", "cap=45; loss=huber", 2),
        ("xgboost", "sensors=varying; loss=-", 2),
        ("rf", "window=30; loss=-", 2),
        ("lstm", "cap=none", 1),
        ("rf", "sensors=none; loss=-", 2),
    }
    same = selection.label_changes(runs, {"window": "90", "cap": "none", "sensors": "all", "loss": "mse"})
    assert same.filter("model = 'lstm'").isEmpty()
    odd = spark.createDataFrame([(None, 1), ("a", 2)], "cap string, k int")
    assert [r["factor"] for r in selection.label_changes(odd, {"cap": "a"}).collect()] == ["cap=null"]
    p = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 1)], "v string, k int")
    assert {r["v"]: r["passed"] for r in selection.check_prediction_counts(p, ["v"], ["k"], 2).collect()} == {"a": True, "b": False}
    best = spark.createDataFrame([("A", 5.0, 1.0, 0.0), ("B", 4.0, 9.0, 0.0), ("C", 4.0, 2.0, -3.0)], "variant string, score_per_unit double, rmse double, bias double")
    assert selection.select_variant(best).first()["variant"] == "C"


# ---- conformal ----


def test_quantile_rules(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 76)], "score double")
    for rule in ("higher", "finite_sample"):
        got = {r["alpha"]: r["q"] for r in conformal.conformal_q(df, rule=rule).collect()}
        assert got == {0.1: 69.0, 0.2: 61.0, 0.3: 54.0}
    few = df.filter("score <= 19")
    assert conformal.conformal_q(few, [0.1]).first()["q"] == 18.0
    assert conformal.conformal_q(few, [0.1], "higher").first()["q"] == 19.0
    tiny = df.filter("score <= 3")
    assert conformal.conformal_q(tiny, [0.1]).first()["k"] == 3
    with pytest.raises(Exception, match="too few scores"):
        conformal.conformal_q(tiny, [0.1], "higher").collect()


def test_published_scores_give_published_widths(spark):
    # Ranks used for 15 calibration units.
    df = spark.createDataFrame([(float(i),) for i in range(1, 16)], "score double")
    assert {r["alpha"]: r["k"] for r in conformal.conformal_q(df).collect()} == {0.1: 15, 0.2: 13, 0.3: 12}


def test_cluster_scores_and_coverage(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"unit_id": np.repeat(np.arange(15), 5), "true_raw_rul": 50.0, "prediction": 50 + rng.normal(0, 9, 75)})
    df = spark.createDataFrame(pdf)
    want = (pdf.prediction - 50).abs().groupby(pdf.unit_id).max()
    scores = conformal.cluster_scores(df)
    got = scores.toPandas().set_index("unit_id")["score"]
    assert np.allclose(got.sort_index(), want)
    q = conformal.conformal_q(scores, [0.1])
    assert conformal.check_guarantee(conformal.coverage(df, q)).first()["passed"]
    wide = conformal.add_interval(df, q).first()
    assert wide["width"] == pytest.approx(round(2 * want.max(), 2))
    assert conformal.residual_summary(df).first()["median"] == pytest.approx((pdf.prediction - 50).abs().median())


# ---- error analysis ----


def test_profiles(spark):
    rows = [(1, 30, 100.0, 110.0), (2, 44, 20.0, 10.0), (3, 45, 60.0, 61.0), (4, 200, 0.0, 70.0)]
    df = spark.createDataFrame(rows, "unit_id long, observed_cycles long, true_rul double, prediction double")
    df = df.withColumn("implied_failure_cycle", F.col("observed_cycles") + F.col("true_rul"))
    hist = {r["lower"]: r for r in errors.bucket_profile(df).collect()}
    assert set(hist) == {0, 45, 200} and hist[0]["n"] == 2 and hist[0]["upper"] == 45
    multi = {(r["split"], r["group"]): r for r in errors.multi_profile(df).collect()}
    assert len(multi) == 11
    assert multi[("true_rul_bin", "true_rul_30_59")]["count"] == 0
    assert multi[("padded_vs_full", "padded_observed_lt_45")]["count"] == 2
    assert sum(r["score_pct"] or 0 for k, r in multi.items() if k[0] == "padded_vs_full") == pytest.approx(100)
    head = errors.error_headline(df).first()
    assert (head["late"], head["early"], head["late_far"], head["early_far"]) == (3, 1, 1, 0)
    assert head["bias_median"] == pytest.approx(5.5)
    assert errors.late_share(df).first()["late_share"] > 0.9
    worst = errors.worst_k(df.withColumn("sample", F.lit("x")), "sample", 2).orderBy("rank").collect()
    assert [r["unit_id"] for r in worst] == [4, 1]
    table = {r["lower"]: r["n"] for r in errors.rul_bucket_table(df, (0, 20, 40, 60)).collect()}
    assert table == {0.0: 1, 20.0: 1, 60.0: 2}
    assert {r["error"] for r in errors.padded_errors(df, 45).collect()} == {10.0, -10.0}


def test_exact_predictions_do_not_divide_by_zero(spark):
    df = spark.createDataFrame([(1, 30, 5.0, 5.0), (2, 30, 5.0, 5.0)], "unit_id long, observed_cycles long, true_rul double, prediction double")
    assert errors.late_share(df).first()["late_share"] is None
    assert errors.error_correlation(df).first()["corr_true_rul"] is None


def test_last_buckets_are_open(spark):
    df = spark.createDataFrame(
        [(1, 20_000, 10.0, 12.0, 20_010), (2, 44, 12_000.0, 12_001.0, 12_044)],
        "unit_id long, observed_cycles long, true_rul double, prediction double, implied_failure_cycle long",
    )
    rows = errors.bucket_profile(df).collect()
    assert {(r["lower"], r["upper"], r["n"]) for r in rows} == {(0, 45, 1), (200, None, 1)}
    shares = errors.multi_profile(df).groupBy("split").agg(F.sum("score_pct").alias("s"), F.sum("count").alias("n"))
    assert all(r["n"] == 2 and r["s"] == pytest.approx(100) for r in shares.collect())


def test_profile_reads_and_aggregates_once(spark):
    df = spark.createDataFrame(
        [(10, 60, 5.0, 4.0), (50, 90, 40.0, 55.0), (200, 300, 120.0, 100.0)],
        "observed_cycles long, implied_failure_cycle long, true_rul double, prediction double",
    )
    found = errors.multi_profile(df)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and plan.count("Expand [") == 1
    rows = {(r["split"], r["group"]): r for r in found.collect()}
    assert len(rows) == 11 and rows["true_rul_bin", "true_rul_60_99"]["count"] == 0
    assert sum(r["score_pct"] for (split, _), r in rows.items() if split == "padded_vs_full") == pytest.approx(100)
