"""The sorts of a task hold a bounded number of rows, whatever the session's shuffle partitions."""

from __future__ import annotations

import pytest

from wearmark.operators import segments
from wearmark.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_supplier_feature_sums_deals_rows_by_their_number(spark, monkeypatch):
    want = sorted(map(tuple, catalogue.supplier_feature_sums(spark, SF).collect()))
    monkeypatch.setattr(segments, "TASK_ROWS", 200)
    found = catalogue.supplier_feature_sums(spark, SF)
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f", {-(-rows // 200)}), REPARTITION_BY_NUM") >= 2
    assert sorted(map(tuple, found.collect())) == want


@pytest.mark.parametrize("name, source", [("variant_matrix_c", "lineitem"), ("variant_matrix_d", "lineitem"), ("raw_rul", "events")])
def test_numbering_deals_rows_by_their_number(spark, monkeypatch, name, source):
    made = catalogue.QUERIES[name](spark, SF)
    columns = [c for c in made.columns if c in ("unit_id", "cycle", "rul", "sensor_1")]
    want = sorted(map(tuple, made.select(*columns).collect()))
    assert "REPARTITION_BY_NUM" not in made._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(segments, "TASK_ROWS", 100)
    found = catalogue.QUERIES[name](spark, SF)
    rows = spark.read.parquet(f"{SF}/{source}.parquet").count()
    assert f", {-(-rows // 100)}), REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.select(*columns).collect())) == want
