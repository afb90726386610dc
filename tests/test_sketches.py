from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wearmark.operators import profile, sketches


@pytest.fixture(scope="module")
def values():
    """A hot unit with half of all rows, skewed values, ties and unknowns."""
    rng = np.random.default_rng(6)
    rows = [(1, float(v)) for v in rng.lognormal(0, 2, 20_000)]
    rows += [(int(2 + i % 60), float(v)) for i, v in enumerate(rng.normal(3, 1, 20_000).round(1))]
    return rows + [(5, None), (6, float("nan")), (99, None)]


def gap(known, value, prob):
    """How far the ranks of ``value`` lie from the wanted one, as a share."""
    low, high = np.searchsorted(known, value, "left") / len(known), np.searchsorted(known, value, "right") / len(known)
    return max(low - prob, prob - high, 0)


@pytest.mark.parametrize("size", [200, 800])
def test_merged_quantiles_keep_their_rank_error(spark, values, size):
    df = spark.createDataFrame(values, "unit_id long, x double").repartition(9)
    per_unit = sketches.unit_sketches(df, "x", size=size)
    probs = [0.01, 0.25, 0.5, 0.75, 0.9, 0.99]
    known = np.sort([v for _, v in values if v is not None and v == v])
    rows = sketches.quantiles(sketches.merged(per_unit, size=size), probs).collect()
    assert [r["prob"] for r in rows] == probs and {r["n"] for r in rows} == {len(known)}
    assert max(gap(known, r["quantile"], r["prob"]) for r in rows) <= sketches.rank_error(size)
    shares = sketches.ranks(sketches.merged(per_unit, size=size), [1.0, 3.0]).collect()
    for r in shares:
        assert abs(r["rank"] - np.searchsorted(known, r["value"], "right") / len(known)) <= sketches.rank_error(size) + 1e-9


def test_small_groups_are_exact_and_empty_ones_absent(spark, values):
    df = spark.createDataFrame(values, "unit_id long, x double")
    rows = sketches.quantiles(sketches.unit_sketches(df.filter("unit_id > 1"), "x"), [0.5]).collect()
    assert len(rows) == 60  # unit 99 has no known value
    for r in rows:
        own = np.sort([v for u, v in values if u == r["unit_id"] and v is not None and v == v])
        assert r["quantile"] == own[int(np.ceil(0.5 * len(own))) - 1] and r["n"] == len(own)
    assert sketches.quantiles(sketches.unit_sketches(df.limit(0), "x"), [0.5]).count() == 0


def test_switches_of_the_profile(spark, noisy, noisy_frame):
    exact, sketched = (profile.describe(noisy, "s1", size).first() for size in (None, 800))
    assert exact["count"] == sketched["count"] and exact["mean"] == pytest.approx(sketched["mean"])
    known = np.sort(noisy_frame["s1"])
    for name, prob in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
        assert gap(known, sketched[name], prob) <= sketches.rank_error()
    plain, rough = profile.fleet_summary(noisy).first(), profile.fleet_summary(noisy, sketch_size=200).first()
    assert rough["median_lifetime"] == plain["median_lifetime"] == 9 and rough["units"] == plain["units"]
    assert "Exchange" in profile.describe(noisy, "s1", 200)._jdf.queryExecution().executedPlan().toString()
    assert profile.describe(noisy.withColumn("s1", F.lit(None).cast("double")), "s1", 200).count() <= 1
