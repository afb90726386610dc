"""Boosted trees grown from bins: against a brute force tree, and one scan a level."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wearmark.operators import boosting, models

PLAIN = {"maxIter": 3, "maxDepth": 3, "stepSize": 0.5, "subsamplingRate": 1.0, "featureSubsetStrategy": "all"}


@pytest.fixture(scope="module")
def numbers():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 20, (600, 3)).astype(float)
    x[:, 2] = 7.0
    return x, np.round(3 * x[:, 0] - np.where(x[:, 1] > 9, 25, 0) + rng.normal(0, 1, 600), 3)


@pytest.fixture(scope="module")
def rows(spark, numbers):
    lines = [(*map(float, a), float(b)) for a, b in zip(*numbers)]
    return spark.createDataFrame(lines, "a double, b double, c double, rul double").repartition(5).cache()


def _brute(x, y, depth):
    if depth:
        best = (1e-9, None)
        for j in range(x.shape[1]):
            for v in np.unique(x[:, j])[:-1]:
                low = x[:, j] <= v
                gain = y.var() - (low.sum() * y[low].var() + (~low).sum() * y[~low].var()) / len(y)
                best = max(best, (gain, (j, v)), key=lambda g: g[0])
        if best[1]:
            low = x[:, best[1][0]] <= best[1][1]
            out = np.empty(len(y))
            out[low], out[~low] = _brute(x[low], y[low], depth - 1), _brute(x[~low], y[~low], depth - 1)
            return out
    return np.full(len(y), y.mean())


def test_rounds_equal_brute_force(numbers, rows, monkeypatch):
    x, y = numbers
    scans, real = [], boosting._Rows.sums
    monkeypatch.setattr(boosting._Rows, "sums", lambda *a: scans.append(1) or real(*a))
    found = boosting.boost(rows, ["a", "b", "c"], PLAIN)
    assert len(scans) == 3 * 3  # a scan a level
    want = np.full(len(y), y.mean())
    for _ in range(3):
        want += 0.5 * _brute(x, y - want, 3)
    scored = models.predict(rows, found.model).toPandas()
    keyed = {(*a, b): w for *a, b, w in zip(*x.T, y, want)}
    np.testing.assert_allclose(scored["prediction"], [keyed[tuple(r)] for r in scored[["a", "b", "c", "rul"]].to_numpy()], rtol=1e-9)


def test_shares_and_renewal_keep_margins_and_model_alike(rows, monkeypatch):
    monkeypatch.setattr(boosting, "RENEW", 2)
    more = {**PLAIN, "maxIter": 7, "subsamplingRate": 0.6, "featureSubsetStrategy": "0.5", "maxBins": 8}
    found = boosting.boost(rows, ["a", "b", "c"], more, stop=rows, patience=None)
    best = models.predict(rows, found.model).agg(F.avg((F.col("prediction") - F.col("rul")) ** 2)).first()[0]
    assert best == pytest.approx(found.losses[found.best_iteration]) and found.rounds_fitted == 7
    again = boosting.boost(rows, ["a", "b", "c"], more, stop=rows, patience=None)
    assert again.losses == pytest.approx(found.losses)


def test_unknown_inputs_are_an_error(spark, rows):
    for bad in ((None, 1.0, 1.0, 1.0), (float("nan"), 1.0, 1.0, 1.0), (1.0, 1.0, 1.0, None)):
        with pytest.raises(Exception, match="null or not a number"):
            boosting.boost(rows.unionByName(spark.createDataFrame([bad], rows.schema)), ["a", "b", "c"], PLAIN)
    with pytest.raises(ValueError):
        boosting.boost(rows.limit(0), ["a", "b", "c"], PLAIN)


def test_inputs_that_never_vary_leave_the_mean(numbers, rows):
    found = boosting.boost(rows, ["c"], PLAIN)
    scored = models.predict(rows, found.model).select("prediction").distinct().collect()
    assert len(scored) == 1 and scored[0][0] == pytest.approx(numbers[1].mean()) and found.rounds_fitted == 3
