import pandas as pd
import pytest

from wearmark.operators import quality


def clean(n_units=3, cycles=4):
    rows = [(u, c, 1.0, 1.0 + c) for u in range(1, n_units + 1) for c in range(1, cycles + 1)]
    pdf = pd.DataFrame(rows, columns=["unit_id", "cycle", "setting_1", "sensor_1"])
    pdf["row_idx"] = range(len(pdf))
    return pdf


def verdict(spark, pdf, expected=3):
    report = quality.validate_trajectories(spark.createDataFrame(pdf), expected, columns=4)
    return {r["check"]: r["passed"] for r in report.collect()}


def failing(spark, pdf, expected=3):
    return {c for c, ok in verdict(spark, pdf, expected).items() if not ok}


def test_clean_frame_passes(spark):
    assert failing(spark, clean()) == set()
    assert failing(spark, clean(), expected=100) == {"unit_count"}


def test_each_dirty_variant_fails_its_check(spark):
    base = clean()
    twice = pd.concat([base, base.iloc[[3]]], ignore_index=True)
    twice["row_idx"] = [*range(len(base)), 3.5]
    twice["row_idx"] = twice["row_idx"].rank(method="first").astype(int)
    assert failing(spark, twice) == {"no_duplicate_cycle", "cycles_increase"}
    nan = base.copy()
    nan.loc[2, "sensor_1"] = float("nan")
    assert failing(spark, nan) == {"no_missing"}
    inf = base.copy()
    inf.loc[2, "sensor_1"] = float("inf")
    assert failing(spark, inf) == {"no_infinite"}
    swapped = base.copy()
    swapped.loc[[0, 1], "row_idx"] = [1, 0]
    assert failing(spark, swapped) == {"cycles_increase"}
    empty = base.copy()
    empty["sensor_1"] = float("nan")
    assert failing(spark, empty) == {"no_missing", "no_empty_column"}
    shifted = base.copy()
    shifted["unit_id"] += 1
    assert failing(spark, shifted) == {"ids_start_at_one", "ids_contiguous"}
    text = base.copy()
    text["sensor_1"] = "x"
    assert failing(spark, text) == {"all_numeric"}


def test_constant_columns_are_reported_not_failed(spark):
    base = clean()
    names = {r["column"] for r in quality.constant_columns(spark.createDataFrame(base), ["setting_1", "sensor_1"]).collect()}
    assert names == {"setting_1"}


@pytest.mark.parametrize("size", [2, 3, 100])
def test_order_breaks_across_runs(spark, size):
    pdf = pd.DataFrame({"unit_id": 1, "cycle": [1, 2, 3, 3, 5, 4, 9], "row_idx": range(7)})
    got = quality.order_breaks(spark.createDataFrame(pdf), segment_rows=size).collect()
    assert got[0]["breaks"] == 2


def test_labels(spark):
    good = spark.createDataFrame([(1, 5), (2, 7)], "unit_id long, true_rul int")
    assert quality.report_passed(quality.validate_labels(good, 2)).first()["passed"]
    floats = spark.createDataFrame([(1, 5.0), (2, 7.0)], "unit_id long, true_rul double")
    assert not quality.report_passed(quality.validate_labels(floats, 2)).first()["passed"]
    zero = spark.createDataFrame([(1, 0), (2, 7)], "unit_id long, true_rul int")
    assert quality.report_passed(quality.validate_labels(zero, 3)).first()["failed"] == 2


def test_expected_units(spark):
    assert quality.expected_units(spark, "FD004").count() == 2
