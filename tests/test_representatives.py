from __future__ import annotations

import random

import pytest

from wearmark.operators import profile


@pytest.mark.parametrize("n", [1, 2, 3, 50, 51])
def test_representative_units_equal_sorting(spark, n):
    rng = random.Random(n)
    rows = [(rng.randrange(5_000_000), rng.choice([40, 41, 41, 41, 90])) for _ in range(n)]
    rows = list({u: (u, life) for u, life in rows}.values())
    life = spark.createDataFrame(rows, "unit_id long, lifetime long").repartition(5)
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    want = {("shortest", *ordered[0]), ("middle", *ordered[len(ordered) // 2]), ("longest", *ordered[-1])}
    assert {tuple(r) for r in profile.representative_units(life).collect()} == want


def test_no_units(spark):
    assert profile.representative_units(spark.createDataFrame([], "unit_id long, lifetime long")).count() == 0


def test_chosen_rows_are_not_shuffled(spark, ramp, monkeypatch):
    chosen = spark.createDataFrame([(1,), (3,), (3,)], "unit_id long")
    few = profile.trajectories_of(ramp, chosen, ["f1"])
    assert "SortMergeJoin" not in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(profile, "SHORT_LIST", 1)
    many = profile.trajectories_of(ramp, chosen, ["f1"])
    assert few.count() == 50 and few.exceptAll(many).isEmpty() and many.exceptAll(few).isEmpty()
