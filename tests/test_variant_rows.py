"""The variant comparison computes the rows of each fit once, however often the learner reads them."""

from __future__ import annotations

from wearmark.operators import boosting
from wearmark.plans import catalogue, flows

SF = "/root/testdata/sf0.001"


def test_variant_fits_read_written_rows(spark, monkeypatch):
    read, fit = [], boosting.boost
    monkeypatch.setattr(boosting, "boost", lambda rows, *a, **b: read.append(rows.inputFiles()) or fit(rows, *a, **b))
    results, _ = flows.compare_variants(
        catalogue.events_fleet(spark, SF), catalogue.split3(spark, SF), ["sensor_1"], ["setting_3"], 8,
        catalogue.inner_stop(), k=2, params={"maxIter": 1, "maxDepth": 1}, variants=("A",), n_init=1,
    )
    assert results.count() == 1 and len(read) == 2
    for files in read:
        assert files and all("/variant_A" in f for f in files)
