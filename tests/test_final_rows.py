"""The final fit computes its feature rows once, however often the learner reads them."""

from __future__ import annotations

from wearmark.operators import models
from wearmark.plans import catalogue, flows


def test_final_fit_reads_written_rows(spark, monkeypatch):
    paths, real, fit = [], flows.new_table_path, models.fit_final
    monkeypatch.setattr(flows, "new_table_path", lambda *a: paths.append(real(*a)) or paths[-1])
    read = []
    monkeypatch.setattr(models, "fit_final", lambda rows, *a: read.extend(rows.inputFiles()) or fit(rows, *a))
    sf = "/root/testdata/sf0.001"
    scored = catalogue.final_fit(spark, sf)
    assert scored.count() == catalogue.event_manifest(spark, sf).count()
    assert len(paths) == 1 and read and all(paths[0] in f for f in read)
