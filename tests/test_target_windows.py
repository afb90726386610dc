import numpy as np
import pytest
from pyspark.sql import functions as F

from frames import collect
from wearmark.operators import profile, target, windows


@pytest.mark.parametrize("size", [8, 65_536])
def test_raw_and_capped_rul(ramp, size):
    raw = collect(target.add_target(ramp, segment_rows=size), "unit_id", "cycle")
    assert raw[raw.unit_id == 3]["rul"].tolist() == list(range(9, -1, -1))
    assert raw["rul"].max() == 119
    capped = target.add_target(ramp, "capped", 45, segment_rows=size)
    assert capped.agg(F.max("rul")).first()[0] == 45
    ignored = target.add_target(ramp, "raw", 45)
    assert ignored.agg(F.max("rul")).first()[0] == 119


def test_target_mode_is_explicit(ramp):
    with pytest.raises(ValueError):
        target.add_target(ramp, "capped")
    with pytest.raises(ValueError):
        target.add_target(ramp, "auto", 45)


def test_implied_failure_cycle_rejects_zero_labels(spark):
    seen = spark.createDataFrame([(1, 30)], "unit_id long, observed_cycles long")
    good = spark.createDataFrame([(1, 5)], "unit_id long, true_rul long")
    assert target.implied_failure_cycle(seen, good).first()["implied_failure_cycle"] == 35
    bad = spark.createDataFrame([(1, 0)], "unit_id long, true_rul long")
    with pytest.raises(Exception, match="label is not positive"):
        target.implied_failure_cycle(seen, bad).collect()


@pytest.mark.parametrize("size", [30, 65_536])
@pytest.mark.parametrize("gapless", [True, False])
def test_full_windows(ramp, size, gapless):
    rows = target.add_target(ramp)
    seqs = windows.sequence_windows(
        rows, ["f1", "f2"], 30, pad=False, keep=["rul"], gapless=gapless, segment_rows=size
    )
    counts = {r["unit_id"]: r["count"] for r in seqs.groupBy("unit_id").count().collect()}
    assert counts == {1: 11, 2: 6, 4: 91}
    first = seqs.filter("unit_id = 2").orderBy("end_cycle").first()
    assert first["end_cycle"] == 30 and first["rul"] == 5
    assert [r[0] for r in first["seq"]] == list(range(1, 31))
    late = seqs.filter("unit_id = 4 and end_cycle = 77").first()
    assert [r[0] for r in late["seq"]] == list(range(48, 78))


@pytest.mark.parametrize("size", [9, 65_536])
def test_padded_windows_and_masks(ramp, size):
    seqs = windows.sequence_windows(ramp, ["f1", "f2"], 8, segment_rows=size)
    assert seqs.count() == ramp.count()
    row = seqs.filter("unit_id = 1 and end_cycle = 3").first()
    assert row["n_observed"] == 3 and row["padded"]
    assert [r[0] for r in row["seq"]] == [0, 0, 0, 0, 0, 1, 2, 3]
    assert row["mask"] == [0, 0, 0, 0, 0, 1, 1, 1]
    full = seqs.filter("unit_id = 4 and end_cycle = 100").first()
    assert not full["padded"] and [r[0] for r in full["seq"]] == list(range(93, 101))
    assert windows.full_windows_only(seqs, 8).count() == ramp.count() - 4 * 7
    assert profile.padded_count(seqs, 8).first()["padded"] == 28


@pytest.mark.parametrize("gapless", [True, False])
def test_terminal_windows(ramp, gapless):
    seqs = windows.terminal_windows(ramp, ["f1"], 90, gapless=gapless, segment_rows=16)
    got = {r["unit_id"]: r for r in seqs.collect()}
    assert got[3]["padded"] and got[3]["n_observed"] == 10
    assert [v[0] for v in got[3]["seq"]] == [0.0] * 80 + [float(i) for i in range(1, 11)]
    assert not got[4]["padded"] and got[4]["seq"][0][0] == 31.0 and got[4]["n_cycles"] == 120


def test_cutoff_guard(spark, ramp):
    manifest = spark.createDataFrame([(1, 40), (1, 41), (3, 0), (7, 1)], "unit_id long, cutoff_cycle long")
    bad = {(r[0], r[1]) for r in windows.check_cutoffs(manifest, ramp).collect()}
    assert bad == {(1, 41), (3, 0), (7, 1)}


def test_window_values_do_not_depend_on_partitioning(noisy):
    one = windows.sequence_windows(noisy, ["s1"], 12, segment_rows=16)
    two = windows.sequence_windows(noisy.repartition(7), ["s1"], 12, segment_rows=65_536)
    a, b = collect(one, "unit_id", "end_cycle"), collect(two, "unit_id", "end_cycle")
    assert all(np.array_equal(np.stack(x), np.stack(y)) for x, y in zip(a["seq"], b["seq"]))
