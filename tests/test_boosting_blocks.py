"""Boosting from blocks of rows: siblings by what is left, sums merged alike, no model that nobody asks for."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wearmark.operators import boosting, models
from wearmark.operators.boosting import Fit

PLAIN = {"maxIter": 3, "maxDepth": 3, "stepSize": 0.5, "subsamplingRate": 0.7, "featureSubsetStrategy": "all"}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    lines = [(i % 5 == 0, *map(float, rng.normal(0, 1, 2))) for i in range(4000)]
    made = spark.createDataFrame(lines, "halt boolean, a double, b double")
    return made.withColumn("rul", F.round(4 * F.col("a") * F.col("b") + F.col("b"), 3)).repartition(3).cache()


def _fit(rows):
    return boosting.boost_many(rows, ["a", "b"], [Fit(~F.col("halt"), F.col("halt"))], PLAIN)[0]


def test_of_two_siblings_the_smaller_one_is_scanned(rows, monkeypatch):
    asked, real = [], boosting._Rows.sums

    def sums(table, turns, share):
        (model, tree, nodes, _), = turns
        asked.append(len(nodes))
        for node in nodes:
            other = node + 1 if node % 2 else node - 1  # siblings are 1 and 2, 3 and 4, ...
            assert node == 0 or tree.stats[node][0] <= tree.stats[other][0]
        return real(table, turns, share)

    monkeypatch.setattr(boosting._Rows, "sums", sums)
    _fit(rows)
    assert asked == [1, 1, 2] * 3  # of 1, 2 and 4 open nodes


def test_a_line_of_the_table_holds_many_rows(rows, monkeypatch):
    lines, real = [], boosting._Rows.add
    monkeypatch.setattr(boosting._Rows, "add", lambda t, *a: lines.append(t.base.count()) or real(t, *a))
    whole = _fit(rows)
    assert lines == [3] * 3  # a line a partition
    monkeypatch.setattr(boosting, "BLOCK_BYTES", 0)  # at least 1,024 rows all the same
    assert _fit(rows).losses == pytest.approx(whole.losses) and lines[3:] == [6] * 3


def test_sums_merged_by_a_shuffle_are_those_of_the_driver(rows, monkeypatch):
    near = _fit(rows)
    monkeypatch.setattr(boosting, "DRIVER_BYTES", 0)
    far = _fit(rows)
    assert far.losses == near.losses and far.trees == near.trees


def test_squares_of_nodes_are_those_of_their_rows(rows):
    found = boosting.boost(rows, ["a", "b"], {**PLAIN, "maxIter": 1, "subsamplingRate": 1.0})
    tree = found.trees[1][0]
    y = np.array([r[0] for r in rows.select("rul").collect()])
    assert tree.stats[0] == pytest.approx((len(y), (y - y.mean()).sum(), ((y - y.mean()) ** 2).sum()), abs=1e-6)
    for node, left in enumerate(tree.left):
        if tree.feature[node] >= 0:
            assert tree.stats[node] == pytest.approx(np.add(tree.stats[left], tree.stats[left + 1]), abs=1e-6)


def test_models_are_made_when_asked_for(rows, monkeypatch):
    made, real = [], boosting.assembled
    monkeypatch.setattr(boosting, "assembled", lambda *a: made.append(1) or real(*a))
    found = _fit(rows)
    assert found.rounds_fitted == 3 and not made
    held = models.predict(rows.filter("halt"), found.model).agg(F.avg((F.col("prediction") - F.col("rul")) ** 2)).first()[0]
    assert held == pytest.approx(found.losses[found.best_iteration]) and found.model is found.model and len(made) == 1
