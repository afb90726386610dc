"""Correlations with inputs that never vary, whatever the partitions that their rows are added up from."""

from __future__ import annotations

from pyspark.sql import functions as F

from wearmark.functions.columns import pearson
from wearmark.operators import profile


def test_a_constant_in_many_partitions_has_no_correlation(spark):
    # (1 / 49) * 49 is not 1, so means merged from such partitions differ in their last digit
    rows = spark.range(0, 49 * 8, 1, 8).select(
        F.col("id").alias("rul"), F.lit(1.0).alias("still"), (F.col("id") * 0 + 0.1).alias("level"), (-2.0 * F.col("id")).alias("falls")
    )
    found = {r["sensor"]: r["corr"] for r in profile.sensor_target_corr(rows, ["still", "level", "falls"]).collect()}
    assert list(found) == ["falls"] and abs(found["falls"] + 1) < 1e-12
    assert rows.agg(pearson("rul", "still").alias("corr")).first()["corr"] is None


def test_only_rows_that_know_both_sides_decide_what_varies(spark):
    rows = spark.createDataFrame([(1.0, None), (2.0, 3.0), (2.0, 4.0), (5.0, None)], "x double, y double")
    assert rows.agg(pearson("x", "y").alias("corr")).first()["corr"] is None
    assert rows.limit(0).agg(pearson("x", "y").alias("corr")).first()["corr"] is None
