"""Features from arrays inside the tasks are those of the window functions; variants do their common work once."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wearmark.operators import boosting, features, regimes
from wearmark.plans import catalogue, flows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("w, segment_rows, batch", [(30, 65_536, 10_000), (30, 40, 7), (7, 16, 3), (1, 65_536, 10)])
def test_arrays_equal_window_functions(spark, noisy, w, segment_rows, batch):
    rows = noisy.withColumn("role", F.concat(F.lit("r"), F.col("unit_id") % 2))
    cols, key = ["s1", "s2", "s3"], ["unit_id", "cycle"]
    kind = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(kind)
    spark.conf.set(kind, batch)
    try:
        got = features.dense_arrays(rows, cols, w, keep=["role"], gapless=True, segment_rows=segment_rows).toPandas()
    finally:
        spark.conf.set(kind, before)
    want = features.dense_features(rows, cols, w, keep=["role"], gapless=True, segment_rows=segment_rows).toPandas()
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    got, want = (t.sort_values(key).reset_index(drop=True) for t in (got, want))
    for c in want.columns:
        if c == "role":
            assert (got[c] == want[c]).all()
        else:
            np.testing.assert_allclose(got[c], want[c], rtol=1e-9, atol=1e-9, err_msg=c)


def test_gapped_cycles_are_placed_first(spark, gapped_frame):
    rows, key = spark.createDataFrame(gapped_frame).repartition(3), ["unit_id", "cycle"]
    got, want = (f(rows, ["s1"], 5).toPandas().sort_values(key).to_numpy(float) for f in (features.dense_arrays, features.dense_features))
    np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-9)


def test_monitor_rows_by_a_condition(spark):
    rng = np.random.default_rng(2)
    lines = [(i % 4 == 0, *map(float, rng.normal(0, 1, 2))) for i in range(400)]
    rows = spark.createDataFrame(lines, "halt boolean, a double, rul double").coalesce(1).cache()
    plain = {"maxIter": 3, "maxDepth": 2, "stepSize": 0.5, "subsamplingRate": 1.0, "featureSubsetStrategy": "all"}
    apart = boosting.boost(rows.filter("not halt"), ["a"], plain, stop=rows.filter("halt"))
    assert boosting.boost(rows, ["a"], plain, stop=F.col("halt")).losses == pytest.approx(apart.losses)


def test_comparison_numbers_the_fleet_and_finds_regimes_once(spark, monkeypatch):
    seen, found, real = spark.sparkContext.accumulator(0), [], regimes.fit_regimes
    monkeypatch.setattr(regimes, "fit_regimes", lambda *a: found.append(1) or real(*a))
    count = F.udf(lambda c: seen.add(1) or c, "long").asNondeterministic()
    fleet = catalogue.events_fleet(spark, SF)
    results, _ = flows.compare_variants(
        fleet.withColumn("cycle", count("cycle")), catalogue.split3(spark, SF), ["sensor_1"], ["setting_3"], 8,
        catalogue.inner_stop(), k=2, params={"maxIter": 1, "maxDepth": 1}, variants=("C", "D"), n_init=1,
    )
    lines = {r["variant"]: r for r in results.collect()}
    assert lines["C"]["inputs"] == 1 and lines["D"]["inputs"] == 4
    assert len(found) == 2  # of the inner rows and of all training rows, for both variants
    assert seen.value == fleet.count()


def test_features_are_scaled_as_their_columns(spark, noisy):
    cols, key = ["s1", "s2", "s3"], ["unit_id", "cycle"]
    pre = regimes.fit_variant(noisy, "A", cols, [])
    plain = features.dense_arrays(noisy, cols, 8, gapless=True)
    got = features.scale_features(plain, pre.sensor_params, cols).toPandas().sort_values(key)
    want = features.dense_features(regimes.variant_matrix(noisy, pre), cols, 8, gapless=True).toPandas().sort_values(key)
    assert list(got.columns) == list(want.columns)
    np.testing.assert_allclose(got.to_numpy(float), want.to_numpy(float), rtol=1e-9, atol=1e-9)


def test_variants_share_their_tables(spark, monkeypatch):
    made, real, tables = [], flows.dense_arrays, {}
    monkeypatch.setattr(flows, "dense_arrays", lambda df, cols, *a, **k: made.append(len(cols)) or real(df, cols, *a, **k))
    fit = boosting.boost
    for variants in (("A", "B", "C", "D"), ("A",), ("C",)):
        read = []
        monkeypatch.setattr(boosting, "boost", lambda rows, *a, **b: read.append(rows.inputFiles()[0]) or fit(rows, *a, **b))
        results, _ = flows.compare_variants(
            catalogue.events_fleet(spark, SF), catalogue.split3(spark, SF), ["sensor_1"], ["setting_3"], 8,
            catalogue.inner_stop(), k=2, params={"maxIter": 2, "maxDepth": 2}, variants=variants, n_init=1,
        )
        tables[variants] = {r["variant"]: r for r in results.drop("training_time").collect()}
        assert len(read) == 2 * len(variants)
    # one table of A and B, one a stage of C and D; alone, A has one and C one a stage
    assert made == [2, 4, 4] + [1] + [1, 1]
    for alone in ("A", "C"):
        for name, value in tables[(alone,)][alone].asDict().items():
            assert tables[("A", "B", "C", "D")][alone][name] == (pytest.approx(value) if isinstance(value, float) else value)
