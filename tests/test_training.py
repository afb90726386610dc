"""One-scan cross-validation, boosting with a monitor, and the concurrent grid."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from wearmark.operators import boosting, features, leastsquares, models, splits, target
from wearmark.plans import flows


@pytest.fixture(scope="module")
def table(noisy):
    rows = features.dense_features(target.add_target(noisy), ["s1", "s2"], 8, keep=["rul"], gapless=True)
    return rows.withColumn("fold", (F.col("cycle") % 3 + 1).cast("int")).cache()


def test_fold_models_equal_single_fits(table):
    inputs = ["s1_mean", "s1_std", "s2_slope", "engine_age"]
    frame = table.toPandas()
    fits = {r["fold"]: r for r in leastsquares.fold_models(table.repartition(7), inputs).collect()}
    assert set(fits) == {1, 2, 3}
    for f, r in fits.items():
        seen = frame[frame.fold != f]
        x = np.column_stack([seen[inputs].to_numpy(float), np.ones(len(seen))])
        want = np.linalg.lstsq(x, seen["rul"].to_numpy(float), rcond=None)[0]
        assert r["n"] == len(seen) and r["mean_label"] == pytest.approx(seen["rul"].mean())
        np.testing.assert_allclose([*r["weights"], r["intercept"]], want, rtol=1e-9, atol=1e-9)
        line = models.fit_model("linear", table.filter(F.col("fold") != f), inputs).stages[-1]
        np.testing.assert_allclose(r["weights"], line.coefficients.toArray(), rtol=1e-9, atol=1e-9)


def test_held_out_predictions_with_constant_and_repeated_inputs(table):
    more = table.withColumns({"one": F.lit(5.0), "twice": F.col("s1_mean") * 2 - 3})
    plain = ["s1_mean", "engine_age"]
    wide = [*plain, "one", "twice"]
    scored = {
        name: leastsquares.predict_held_out(more, leastsquares.fold_models(more, names), names)
        .select("unit_id", "cycle", "prediction").toPandas().sort_values(["unit_id", "cycle"])["prediction"].to_numpy()
        for name, names in (("plain", plain), ("wide", wide))
    }
    np.testing.assert_allclose(scored["plain"], scored["wide"], rtol=1e-9, atol=1e-7)


def test_moments_far_from_zero_keep_their_digits(spark):
    rng = np.random.default_rng(1)
    x = 1e7 + rng.normal(0, 1, 400)
    rows = [(float(v), float(3 * (v - 1e7) + 1), i % 4) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows + [(None, 1.0, 0), (1.0, 1.0, None)], "x double, rul double, fold int")
    for r in leastsquares.fold_models(df.repartition(5), ["x"]).collect():
        assert r["n"] == 300 and r["weights"][0] == pytest.approx(3, rel=1e-9)
    assert leastsquares.fold_models(df.limit(0), ["x"]).count() == 0


def test_cross_validation_scans_once_for_all_folds(spark, noisy, monkeypatch):
    some = noisy.filter("unit_id >= 3 and cycle <= 40")
    more = some.unionByName(some.withColumn("unit_id", F.col("unit_id") + 100))
    folds = splits.group_folds(more.select("unit_id").distinct(), 4, strict=False)
    fits = []
    real = leastsquares.fold_models
    monkeypatch.setattr(leastsquares, "fold_models", lambda *a, **b: fits.append(1) or real(*a, **b))
    monkeypatch.setattr(models, "fit_model", None)  # no fold is fitted by itself
    candidates = [flows.Candidate("mean", "mean", 8), flows.Candidate("line", "linear", 8)]
    rows, _ = flows.group_cv(more, folds, 4, candidates, ["s1", "s2"], fractions=(0.45, 0.8))
    assert len(fits) == 1 and rows.count() == 8


BOOST = {"maxIter": 60, "maxDepth": 2, "stepSize": 0.3}


def test_boosting_stops_while_training(noisy):
    rows = features.dense_features(target.add_target(noisy), ["s1"], 10, keep=["rul"], gapless=True).cache()
    inputs = features.feature_names(["s1"])
    fit, stop = rows.filter("unit_id = 9"), rows.filter("unit_id = 8")
    found = boosting.boost(fit, inputs, BOOST, stop=stop, patience=3)
    assert found.rounds_fitted == len(found.losses) < 60
    assert found.best_iteration == int(np.argmin(found.losses)) == found.rounds_fitted - 1 - 3
    assert found.model.stages[-1].getNumTrees == found.best_iteration + 2  # the mean and its rounds
    scored = models.predict(stop, found.model)
    loss = scored.agg(F.avg((F.col("prediction") - F.col("rul")) ** 2)).first()[0]
    assert loss == pytest.approx(found.losses[found.best_iteration])


def test_boosting_without_monitor_fits_all_rounds(noisy, tmp_path):
    rows = features.dense_features(target.add_target(noisy), ["s1"], 10, keep=["rul"], gapless=True).cache()
    inputs = features.feature_names(["s1"])
    errors = []
    for n in (0, 3, 13):
        found = boosting.boost(rows, inputs, {**BOOST, "maxIter": n})
        assert found.rounds_fitted == n and found.losses == [] and found.best_iteration == n - 1
        scored = models.predict(rows, found.model)
        errors.append(scored.agg(F.avg((F.col("prediction") - F.col("rul")) ** 2)).first()[0])
    variance = rows.agg(F.var_pop("rul")).first()[0]
    assert errors[0] == pytest.approx(variance) and errors[0] > errors[1] > errors[2]
    found.model.write().overwrite().save(str(tmp_path / "m"))
    again = models.predict(rows, PipelineModel.load(str(tmp_path / "m")))
    gap = again.select("unit_id", "cycle", F.col("prediction").alias("p")).join(scored, ["unit_id", "cycle"])
    assert gap.agg(F.max(F.abs(F.col("p") - F.col("prediction")))).first()[0] < 1e-12


@pytest.fixture(scope="module")
def fleet(noisy):
    more = noisy.filter("unit_id >= 5").unionByName(noisy.filter("unit_id >= 5").withColumn("unit_id", F.col("unit_id") + 100))
    return more.filter("cycle <= 60").cache()


@pytest.fixture(scope="module")
def roles(fleet):
    return splits.split_units(fleet.select("unit_id").distinct())


def test_grid_breaks_off_and_is_resumed(spark, fleet, roles, tmp_path, monkeypatch):
    points = flows.grid_points((8, 4), ("mean", "linear"), [("linear", 8, {"cap": 20}), ("forest", 8, {"numTrees": 2, "maxDepth": 2})])
    assert [p.id for p in points][-2:] == ["linear_w8_cap20_s42", "forest_w8_maxDepth2_numTrees2_s42"]
    real, fitted, broken = models.fit_model, [], ["linear"]

    def fit(name, *rest):
        if name in broken:
            raise RuntimeError("power cut")
        fitted.append(name)
        return real(name, *rest)

    monkeypatch.setattr(models, "fit_model", fit)
    run = lambda: flows.run_grid(fleet, roles, ["s1", "s2"], points, str(tmp_path / "grid"), parallel=3)
    with pytest.raises(flows.GridFailure) as failure:
        run()
    assert set(failure.value.failed) == {"linear_w8_s42", "linear_w4_s42", "linear_w8_cap20_s42"}
    assert sorted(fitted) == ["forest", "mean", "mean"]  # the others were stored all the same
    broken.clear()
    results, predictions = run()
    assert sorted(fitted) == ["forest", "linear", "linear", "linear", "mean", "mean"]
    found = {r["experiment_id"]: r for r in results.collect()}
    assert set(found) == {p.id for p in points} and len({r["n"] for r in found.values()}) == 1
    assert predictions.groupBy("experiment_id").count().count() == 6
    run()
    assert len(fitted) == 6  # nothing left to do
    one = predictions.filter("experiment_id = 'linear_w8_s42'")
    rmse = one.agg(F.sqrt(F.avg((F.col("prediction") - F.col("true_raw_rul")) ** 2))).first()[0]
    assert found["linear_w8_s42"]["rmse"] == pytest.approx(rmse)
    # a capped target is learned, errors are of the uncapped one
    assert found["linear_w8_cap20_s42"]["bias"] < found["linear_w8_s42"]["bias"]
    assert found["linear_w8_cap20_s42"]["overrides"] == "cap=20"


def test_grid_makes_features_once_per_window(spark, fleet, roles, tmp_path, monkeypatch):
    made, real = [], flows.dense_features
    monkeypatch.setattr(flows, "dense_features", lambda df, cols, w, **more: made.append(w) or real(df, cols, w, **more))
    points = flows.grid_points((8,), ("mean", "linear"), [("linear", 8, {"cap": 20}), ("mean", 4, {"cap": 20})])
    results, _ = flows.run_grid(fleet, roles, ["s1"], points, str(tmp_path / "grid"), parallel=2)
    assert made == [8]  # caps share a table, the mean needs none
    units = {r[0] for r in roles.filter("role = 'train'").collect()}
    frame = fleet.toPandas()
    frame = frame[frame.unit_id.isin(units)]
    left = frame.groupby("unit_id")["cycle"].transform("max") - frame["cycle"]
    held = spark.read.parquet(str(tmp_path / "grid" / "predictions"))
    for name, want in (("mean_w8_s42", left.mean()), ("mean_w4_cap20_s42", left.clip(upper=20).mean())):
        got = {r[0] for r in held.filter(F.col("experiment_id") == name).select("prediction").collect()}
        assert len(got) == 1 and got.pop() == pytest.approx(want)


def test_interrupted_grid_cancels_and_resumes(spark, fleet, roles, tmp_path, monkeypatch):
    """The caller is interrupted half way: what ended is stored, what had not started never starts."""
    points = flows.grid_points((8, 6, 4), ("mean",))
    real, fitted = models.fit_model, []

    def fit(name, *rest):
        fitted.append(name)
        if len(fitted) == 3:
            time.sleep(3)  # still running when the caller is interrupted
        return real(name, *rest)

    monkeypatch.setattr(models, "fit_model", fit)
    waiting = flows.as_completed

    def interrupted(running):
        for n, future in enumerate(waiting(running)):
            if n == 1:
                raise KeyboardInterrupt
            yield future

    monkeypatch.setattr(flows, "as_completed", interrupted)
    run = lambda: flows.run_grid(fleet, roles, ["s1"], points, str(tmp_path / "grid"), parallel=1)
    with pytest.raises(KeyboardInterrupt):
        run()
    before = spark.read.parquet(str(tmp_path / "grid" / "results")).count()
    assert 1 <= before < 3
    monkeypatch.setattr(flows, "as_completed", waiting)
    results, _ = run()
    assert results.count() == 3 and len(fitted) <= 4


def test_grid_ids_must_differ(fleet, roles, tmp_path):
    with pytest.raises(ValueError):
        flows.run_grid(fleet, roles, ["s1"], flows.grid_points((8, 8), ("mean",)), str(tmp_path))
