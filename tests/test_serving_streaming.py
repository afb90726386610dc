import numpy as np
import pytest
from pyspark.sql import functions as F

from wearmark.operators import features, models, serving
from wearmark.operators.checkpoints import terminal_manifest
from wearmark.streaming import scorer

MODEL = models.FormulaModel(10.0, {"s1_mean": 1.0, "s2_slope": 2.0, "engine_age": -0.5})


def test_serve_batch(noisy, noisy_frame):
    got = {r["unit_id"]: r for r in serving.serve_batch(noisy, models.FormulaModel(3.0, {}), 5.25, ["s1"], 10).collect()}
    assert got[3]["n_padded_timesteps"] == 6 and got[3]["history_is_padded"]
    assert got[3]["warning"] == "Limited observed history: only 4 cycles observed; window 10 -> 6 timesteps padded."
    assert got[9]["warning"] is None and not got[9]["history_is_padded"]
    assert (got[9]["lo"], got[9]["hi"], got[9]["interval_width"]) == (-2.25, 8.25, 10.5)
    with pytest.raises(ValueError):
        serving.serve_batch(noisy.drop("cycle"), MODEL, 1.0, ["s1"], 10)


def test_full_and_windowed_modes_differ_only_for_long_units(noisy):
    full = serving.serve_batch(noisy, MODEL, 1.0, ["s1", "s2"], 20, mode="full", gapless=True)
    part = serving.serve_batch(noisy, MODEL, 1.0, ["s1", "s2"], 20, mode="windowed", gapless=True)
    changed = {r["unit_id"] for r in full.exceptAll(part).collect()}
    assert changed <= {8, 9} and changed
    assert serving.fleet_padding(full).first()["padded_units"] == 7


def test_capped_serving_stays_in_range(noisy):
    served = serving.serve_capped(noisy, models.FormulaModel(0.0, {"s1_last": 10.0}), ["s1"], 12, 45.0)
    assert {r["prediction"] for r in served.collect()} == {45.0}


def test_text_scoring(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = [f"{u}   {c}  0 0 0 " + " ".join(str(u * 10 + c) for _ in range(21)) for u in (1, 2) for c in range(1, 6)]
    (folder / "test_X.txt").write_text("\n".join(lines) + "\n")
    (folder / "RUL.txt").write_text("3\n9\n")
    model = models.FormulaModel(0.0, {"sensor_2_last": 0.1})
    served, metrics = serving.score_file(spark, str(folder / "test_X.txt"), model, ["sensor_2"], 4, 45, str(folder / "RUL.txt"))
    assert {r["unit_id"]: r["prediction"] for r in served.collect()} == {1: 1.5, 2: 2.5}
    assert metrics.first()["mae"] == pytest.approx((1.5 + 6.5) / 2)


def test_tail_features_equal_batch_features(noisy, noisy_frame):
    w = 12
    batch = features.features_at(noisy, terminal_manifest(noisy), ["s1", "s2"], w, gapless=True).toPandas().set_index("unit_id")
    for unit, g in noisy_frame.groupby("unit_id"):
        x = g.sort_values("cycle")[["s1", "s2"]].to_numpy(float)[-w:]
        names = [f"{c}_{k}" for k in features.GROUPS for c in ("s1", "s2")]
        np.testing.assert_allclose(batch.loc[unit, names].to_numpy(float), scorer.tail_features(x), rtol=1e-9, atol=1e-9)


def _stream(spark, folder):
    return spark.readStream.schema("unit_id long, cycle long, s1 double, s2 double").option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_stream_over_several_batches_equals_batch(spark, noisy, tmp_path):
    w = 12
    source = tmp_path / "source"
    for low, high in ((0, 5), (5, 20), (20, 60), (60, 999)):
        part = noisy.filter((F.col("cycle") > low) & (F.col("cycle") <= high)).select("unit_id", "cycle", "s1", "s2")
        part.coalesce(1).write.mode("append").parquet(str(source))
    scored = scorer.stream_scorer(_stream(spark, source), MODEL, ["s1", "s2"], w)
    out = tmp_path / "out"
    scorer.run_available(scored, str(out), str(tmp_path / "cp"))
    latest = spark.read.parquet(str(out)).groupBy("unit_id").agg(F.max_by("prediction", "engine_age").alias("prediction"), F.max("engine_age").alias("n"))
    want = models.predict(features.features_at(noisy, terminal_manifest(noisy), ["s1", "s2"], w, gapless=True), MODEL)
    both = latest.join(want.select("unit_id", F.col("prediction").alias("p"), "engine_age"), "unit_id").collect()
    assert len(both) == 9
    for r in both:
        assert r["prediction"] == pytest.approx(r["p"]) and r["n"] == r["engine_age"]


def test_every_row_counts(spark, tmp_path):
    source = tmp_path / "source"
    rows = "unit_id long, cycle long, s1 double, s2 double"
    batches = [
        [(1, c, float(c), 0.0) for c in range(10, 15)],
        [(1, 14, 20.0, 1.0), (1, 3, 99.0, 0.0)],
        [(1, 15, 15.0, 0.0)],
    ]
    out = tmp_path / "out"
    for batch in batches:
        spark.createDataFrame(batch, rows).coalesce(1).write.mode("append").parquet(str(source))
        scored = scorer.latest_features(_stream(spark, source), ["s1"], 4, tie="s2")
        scorer.run_available(scored, str(out), str(tmp_path / "cp"))
    got = spark.read.parquet(str(out)).orderBy("engine_age").collect()
    # the repeated cycle enters by its tie, the late row only counts
    assert [(r["cycle"], r["engine_age"], r["s1_mean"]) for r in got] == [(14, 5.0, 12.5), (14, 7.0, 14.75), (15, 8.0, 15.5)]


@pytest.mark.parametrize("chunk", [10, 10_000])
def test_age_does_not_depend_on_chunks(spark, tmp_path, chunk):
    rng = np.random.default_rng(3)
    order = rng.permutation(500)
    rows = [(1, int(c) // 3, float(c), float(c % 3)) for c in order]
    spark.createDataFrame(rows, "unit_id long, cycle long, s1 double, s2 double").coalesce(1).write.parquet(str(tmp_path / "source"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(chunk))
    try:
        scored = scorer.latest_features(_stream(spark, tmp_path / "source"), ["s1"], 30, tie="s2")
        scorer.run_available(scored, str(tmp_path / "out"), str(tmp_path / "cp"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    last = spark.read.parquet(str(tmp_path / "out")).orderBy(F.desc("engine_age")).first()
    assert last["engine_age"] == 500 and last["s1_mean"] == pytest.approx(484.5)
