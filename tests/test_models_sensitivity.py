import numpy as np
import pytest
from pyspark.sql import functions as F

from wearmark.operators import errors, features, models, profile, sensitivity, splits, target, windows
from wearmark.operators.checkpoints import checkpoint_manifest
from wearmark.plans import flows

FORMULA = models.FormulaModel(5.0, {"s1_mean": 0.5, "s1_latest": 0.25, "s1_std": 2.0, "s2_last5_mean": 3.0, "engine_age": -0.1})


def test_factory_and_clip(spark):
    with pytest.raises(ValueError):
        models.make_estimator("unknown")
    booster = models.make_estimator("boosted")
    assert booster.getMaxIter() == 500 and booster.getStepSize() == 0.05 and booster.getMaxDepth() == 6
    assert models.make_estimator("forest").getNumTrees() == 300
    df = spark.createDataFrame([(-3.0,), (20.0,), (90.0,)], "prediction double")
    assert [r[0] for r in models.clip_predictions(df, 45).collect()] == [0.0, 20.0, 45.0]


def test_mean_and_linear_models(noisy):
    rows = target.add_target(noisy).withColumn("engine_age", F.col("cycle").cast("double"))
    mean = models.predict(rows, models.fit_model("mean", rows, []))
    assert mean.select("prediction").distinct().count() == 1
    one = rows.filter("unit_id = 9")
    line = models.predict(one, models.fit_model("linear", one, ["engine_age"]))
    assert line.agg(F.max(F.abs(F.col("prediction") - F.col("rul")))).first()[0] < 1e-6


def test_best_iteration_and_fixed_refit(noisy):
    rows = features.dense_features(target.add_target(noisy), ["s1"], 10, keep=["rul"], gapless=True).cache()
    inputs = features.feature_names(["s1"])
    params = {"maxIter": 5, "maxDepth": 2}
    model = models.fit_model("boosted", rows.filter("unit_id <= 8"), inputs, params)
    best = models.best_iteration(model, rows.filter("unit_id = 9"))
    assert 0 <= best < 5
    again = models.fit_model("boosted", rows, inputs, {**params, "maxIter": best + 1})
    assert again.stages[-1].getNumTrees == best + 1
    assert models.best_iteration(model, rows.filter("unit_id = 9"), patience=1) <= best


def test_final_fit_ignores_calibration_rows(spark, noisy):
    rows = target.add_target(noisy).withColumn("engine_age", F.col("cycle").cast("double"))
    spoiled = rows.withColumn("rul", F.when(F.col("unit_id") == 9, 10_000).otherwise(F.col("rul")))
    roles = spark.createDataFrame([(u, "calibration" if u == 9 else "train") for u in range(1, 10)], "unit_id long, role string")
    model = models.fit_final(spoiled, roles, "linear", ["engine_age"])
    assert models.predict(rows, model).agg(F.max("prediction")).first()[0] < 100


def make_scorer():
    def score(x, mask):
        return x[:, :, 0].sum(axis=1) * 2 + x[:, -1, 1] + mask.sum(axis=1)

    return score


_scorer = make_scorer()


def test_sequence_scoring(ramp):
    seqs = windows.sequence_windows(ramp, ["f1", "f2"], 5, gapless=True).select("unit_id", "end_cycle", "seq", "mask")
    got = models.score_sequences(seqs, _scorer, 5).filter("unit_id = 1 and end_cycle in (2, 9)").orderBy("end_cycle").collect()
    assert [r["prediction"] for r in got] == [2 * 3 + 102 + 2, 2 * 35 + 109 + 5]


def test_occlusion_closed_form_equals_replacing_the_series(spark, noisy, noisy_frame):
    manifest = checkpoint_manifest(profile.lifetimes(noisy).filter("lifetime > 9"))
    at = features.features_at(noisy, manifest, ["s1", "s2"], None, gapless=True)
    deltas = sensitivity.occlude(at, ["s1", "s2"], FORMULA)
    got = {(r["unit_id"], r["cutoff_cycle"]): r for r in deltas.filter("sensor = 's1'").collect()}
    for (unit, cutoff), r in got.items():
        seen = noisy_frame[(noisy_frame.unit_id == unit) & (noisy_frame.cycle <= cutoff)].assign()
        flat = spark.createDataFrame(seen.assign(s1=seen["s1"].mean()))
        line = spark.createDataFrame([(unit, cutoff)], "unit_id long, cutoff_cycle long")
        if unit == 9 and cutoff > 100:
            want = models.predict(features.features_at(flat, line, ["s1", "s2"], None, gapless=True), FORMULA)
            assert r["prediction_occluded"] == pytest.approx(want.first()["prediction"])
    assert sensitivity.alignment_check(manifest, deltas, 2).first()["passed"]
    assert not sensitivity.alignment_check(manifest, deltas.filter("sensor = 's1'"), 2).first()["passed"]
    assert sensitivity.top_sensors(deltas, 1).count() == 5
    assert sensitivity.occlusion_summary(deltas).count() == 2


@pytest.mark.parametrize("size", [16, 65_536])
def test_backgrounds_equal_built_windows(noisy, noisy_frame, size):
    w = 9
    stacks = []
    for _, g in noisy_frame.sort_values("cycle").groupby("unit_id"):
        x = g[["s1", "s2"]].to_numpy(float)
        stacks += [x[e - w : e] for e in range(w, len(x) + 1)]
    full = np.stack(stacks)
    got = {r["sensor"]: r["median"] for r in sensitivity.background_median(noisy, ["s1", "s2"], w, gapless=True, segment_rows=size).collect()}
    assert got["s1"] == pytest.approx(np.median(full[:, :, 0])) and got["s2"] == pytest.approx(np.median(full[:, :, 1]))
    rows = sensitivity.position_background(noisy, ["s1"], w, gapless=True, segment_rows=size).collect()
    assert {r["position"]: pytest.approx(r["median"]) for r in rows} == {p + 1: np.median(full[:, p, 0]) for p in range(w)}


def test_attributions(spark, ramp):
    seqs = windows.full_windows_only(windows.terminal_windows(ramp, ["f1", "f2"], 5, gapless=True), 5)
    background = spark.createDataFrame([("f1", 1.0), ("f2", 2.0)], "sensor string, median double")
    got = sensitivity.median_attribution(seqs, background, ["f1", "f2"], _scorer, 5)
    one = {r["sensor"]: r for r in got.filter("unit_id = 1").collect()}
    assert one["f1"]["attribution"] == 2 * (38 * 5) - 2 * 5 and one["f2"]["attribution"] == 138
    assert one["f1"]["gap"] == pytest.approx(0)
    groups = spark.createDataFrame([(1, "late-miss"), (4, "accurate")], "unit_id long, group string")
    assert sensitivity.attribution_summary(got, groups).count() == 4
    places = spark.createDataFrame([(p, s, 0.0) for p in range(1, 6) for s in ("f1", "f2")], "position long, sensor string, median double")
    by_place = sensitivity.position_attribution(seqs.filter("unit_id = 1"), places, ["f1", "f2"], _scorer, 5)
    assert {r["position"]: r["attribution"] for r in by_place.collect()} == {1: 72, 2: 74, 3: 76, 4: 78, 5: 80 + 140}
    err = errors.with_errors(spark.createDataFrame([(1, 50, 0.0, 60.0), (2, 50, 0.0, 5.0), (3, 4, 0.0, 60.0), (4, 50, 0.0, 30.0)],
                             "unit_id long, observed_cycles long, true_rul double, prediction double"))
    assert {r["unit_id"]: r["group"] for r in sensitivity.target_groups(err, 45).collect()} == {1: "late-miss", 2: "accurate"}


def test_nested_cv_and_choice(spark, noisy):
    df = noisy.filter("unit_id >= 3")
    more = df.unionByName(df.withColumn("unit_id", F.col("unit_id") + 100)).filter("cycle <= 40")
    folds = splits.group_folds(more.select("unit_id").distinct(), 2)
    candidates = [
        flows.Candidate("tree", "boosted", 8, {"maxIter": 2, "maxDepth": 2}),
        flows.Candidate("line", "linear", 8),
    ]
    rows, predictions = flows.nested_cv(more, folds, 2, candidates, ["s1", "s2"], 2, fractions=(0.45, 0.8))
    assert predictions.groupBy("candidate_id").count().collect()[0]["count"] == 28
    found = {(r["candidate_id"], r["fold"]): r["best_iteration"] for r in rows.collect()}
    assert len(found) == 4 and found[("line", 1)] is None and found[("tree", 1)] in (0, 1)
    held = predictions.filter("candidate_id = 'tree'").select("unit_id", "fold").distinct()
    assert held.exceptAll(folds.select("unit_id", "fold")).isEmpty()
    assert flows.choose(rows, candidates, 2).filter("selected").count() == 1
    with pytest.raises(ValueError):
        flows.choose(rows.filter("fold = 1"), candidates, 2)
