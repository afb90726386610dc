"""Boosting of all folds: the models of one fit after another, from the scans of one."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wearmark.operators import boosting, models
from wearmark.operators.boosting import Fit
from wearmark.plans import flows

PLAIN = {"maxIter": 4, "maxDepth": 2, "stepSize": 0.5, "subsamplingRate": 1.0, "featureSubsetStrategy": "all"}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    lines = [(i, i % 3, i % 5 == 0, *map(float, rng.normal(0, 1, 2))) for i in range(300)]
    made = spark.createDataFrame(lines, "id long, fold int, halt boolean, a double, b double")
    return made.withColumn("rul", 4 * F.col("a") - F.col("b") * F.col("fold")).repartition(3).cache()


def _scored(rows, model):
    return [r[0] for r in models.predict(rows, model).orderBy("id").select("prediction").collect()]


def test_folds_side_by_side_equal_one_after_another(rows, monkeypatch):
    scans, real = [], boosting._Rows.sums
    monkeypatch.setattr(boosting._Rows, "sums", lambda *a: scans.append(1) or real(*a))
    monkeypatch.setattr(boosting, "RENEW", 2)
    inputs, halt = ["a", "b"], F.col("halt")
    fits = [Fit((F.col("fold") != f) & ~halt, (F.col("fold") != f) & halt, refit=True) for f in range(3)]
    found = boosting.boost_many(rows, inputs, fits, PLAIN)
    assert len(scans) <= 2 * (4 + 1)  # levels by rounds, one round more for the refits
    for f, got in enumerate(found):
        train = rows.filter(F.col("fold") != f)
        alone = boosting.boost(train.filter(~halt), inputs, PLAIN, stop=train.filter(halt))
        assert got.best_iteration == alone.best_iteration and got.losses == pytest.approx(alone.losses)
        refit = boosting.boost(train, inputs, {**PLAIN, "maxIter": alone.best_iteration + 1})
        np.testing.assert_allclose(_scored(rows, got.model), _scored(rows, refit.model), rtol=1e-9)


def test_more_fits_than_are_grown_together(rows, monkeypatch):
    monkeypatch.setattr(boosting, "FITS", 2)
    fits = [Fit(F.col("fold") == f) for f in range(3)]
    for f, got in enumerate(boosting.boost_many(rows, ["a"], fits, {**PLAIN, "maxIter": 1})):
        alone = boosting.boost(rows.filter(F.col("fold") == f), ["a"], {**PLAIN, "maxIter": 1})
        np.testing.assert_allclose(_scored(rows, got.model), _scored(rows, alone.model), rtol=1e-9)
    with pytest.raises(ValueError):
        boosting.boost_many(rows, ["a"], [Fit(F.col("fold") == 0, refit=True)], PLAIN)


def test_cross_validation_works_the_fleet_out_once(spark, noisy, monkeypatch):
    fleet = noisy.filter("unit_id >= 5")
    folds = spark.createDataFrame([(5, 1), (6, 2), (7, 1), (8, 2), (9, 1)], "unit_id long, fold int")
    plans, real, seen = [], flows.dense_features, spark.sparkContext.accumulator(0)
    count = F.udf(lambda u: seen.add(1) or u, "long").asNondeterministic()
    monkeypatch.setattr(flows, "dense_features", lambda df, *a, **k: plans.append(df) or real(df, *a, **k))
    rows, _ = flows.nested_cv(
        fleet.withColumn("unit_id", count("unit_id")), folds, 2, [flows.Candidate("mean", "mean", 8)], ["s1"], 1, fractions=(0.45, 0.8)
    )
    assert rows.count() == 2 and len(plans) == 1
    assert seen.value == fleet.count()
