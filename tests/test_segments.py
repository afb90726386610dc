import pandas as pd
import pytest
from pyspark.sql import functions as F

from frames import collect
from wearmark.operators import segments
from wearmark.sources.fleets import events_fleet, supplier_fleet


@pytest.mark.parametrize("size", [4, 7, 65_536])
def test_position_counts_rows_across_gaps(spark, gapped_frame, size):
    df = spark.createDataFrame(gapped_frame).repartition(5)
    got = collect(segments.with_position(df, segment_rows=size), "unit_id", "cycle")
    want = gapped_frame.sort_values(["unit_id", "cycle"]).groupby("unit_id").cumcount() + 1
    assert got["_pos"].tolist() == want.tolist()


def test_number_rows_carries_previous_value_over_bucket_borders(spark):
    rows = [(1, t) for t in (3, 5, 11, 12, 40)] + [(2, 9)]
    df = spark.createDataFrame(rows, "u long, t long")
    got = collect(
        segments.number_rows(df, ["u"], ["t"], [F.floor(F.col("t") / 10)], "n", {"before": "t"}), "u", "t"
    )
    assert got["n"].tolist() == [1, 2, 3, 4, 5, 1]
    assert [None if pd.isna(v) else int(v) for v in got["before"]] == [None, 3, 5, 11, 12, None]


def test_number_rows_without_group(spark):
    df = spark.range(0, 1000).withColumn("h", F.md5(F.col("id").cast("string")))
    got = segments.number_rows(df, [], ["h", "id"], [F.substring("h", 1, 1)], "n").toPandas()
    assert got.sort_values("h")["n"].tolist() == list(range(1, 1001))


@pytest.mark.parametrize("fleet", [events_fleet, supplier_fleet])
def test_fleet_numbering_does_not_depend_on_the_hot_limit(spark, fleet):
    sf = "/root/testdata/sf0.001"
    cold, hot = fleet(spark, sf), fleet(spark, sf, hot_rows=10)
    assert cold.exceptAll(hot).isEmpty() and hot.exceptAll(cold).isEmpty()


@pytest.mark.parametrize("size", [8, 65_536])
def test_attach_units_equals_plain_join(spark, ramp, size):
    table = spark.createDataFrame([(1, "a"), (4, "b"), (9, "c")], "unit_id long, role string")
    got = segments.attach_units(ramp, table, segment_rows=size)
    want = ramp.join(table, "unit_id")
    assert got.select(want.columns).exceptAll(want).isEmpty()
    assert got.count() == 160
    semi = segments.attach_units(ramp, table, how="left_semi", segment_rows=size)
    assert semi.columns == ramp.columns or set(semi.columns) == set(ramp.columns)
    assert semi.count() == 160


def test_long_unit_spreads_over_many_join_keys(ramp):
    keyed = segments.unit_segments(ramp, ramp.select("unit_id").distinct(), segment_rows=8)
    assert keyed.filter("unit_id = 4").count() == 15


def test_halo_copies_only_segment_edges(ramp):
    spread, size = segments.with_halo(ramp.withColumn("_pos", F.col("cycle")), "_pos", 3, 10)
    assert size == 10
    copies = spread.filter("_halo and unit_id = 4")
    assert copies.count() == 3 * 12
    _, grown = segments.with_halo(ramp.withColumn("_pos", F.col("cycle")), "_pos", 30, 10)
    assert grown == 30
