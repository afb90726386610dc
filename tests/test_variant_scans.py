"""Variants are fitted by plain scans, and what was fitted is not worked out again when it is applied."""

from __future__ import annotations

import numpy as np
import pytest

from wearmark.operators import regimes
from wearmark.plans import catalogue
from wearmark.sources.fleets import supplier_fleet, supplier_rows

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_for_fits_are_those_of_the_fleet(spark):
    fleet, rows = supplier_fleet(spark, SF).drop("cycle"), supplier_rows(spark, SF)
    assert rows.columns == fleet.columns
    assert rows.exceptAll(fleet).isEmpty() and fleet.exceptAll(rows).isEmpty()
    assert "Join" not in _plan(rows) and "Window" not in _plan(rows)


@pytest.mark.parametrize("name", ["variant_matrix_c", "variant_matrix_d"])
def test_matrix_reads_its_table_for_the_numbering_only(spark, name):
    scans = _plan(supplier_fleet(spark, SF)).count("Relation ")
    assert _plan(getattr(catalogue, name)(spark, SF)).count("Relation ") == scans


def test_nearest_regime_takes_the_first_of_equals(spark):
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 5, (200, 3)).astype(float)
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows] + [(None, 1.0, 1.0)], "a double, b double, c double")
    for centres in (rng.integers(0, 5, (6, 3)).astype(float), np.zeros((3, 3)), np.ones((1, 3))):
        model = regimes.RegimeModel(centres, 0.0, [0.0], 0)
        got = regimes.assign_regime(df, model, ["a", "b", "c"])
        assert got.schema["regime"].dataType.simpleString() == "int"
        assert got.filter("a is null").first()["regime"] is None
        seen = got.dropna().toPandas()
        want = ((seen[["a", "b", "c"]].to_numpy()[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert (seen["regime"] == want).all()
        assert str(got._jdf.queryExecution().optimizedPlan()).count("array_position") == 0
