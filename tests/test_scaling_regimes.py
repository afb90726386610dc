import numpy as np
import pandas as pd
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from wearmark.operators import regimes, scaling, splits

SENSORS = ["sensor_1", "sensor_2"]
SETTINGS = ["setting_1", "setting_2", "setting_3"]


@pytest.fixture(scope="module")
def regime_fleet(spark):
    rng = np.random.default_rng(5)
    rows = []
    for unit in range(1, 7):
        for c in range(80):
            band = (c // 20) % 3
            rows.append((unit, c + 1, 100.0, 10.0 * band, 60.0 if c % 2 else 100.0,
                         float(rng.normal(0.5 * (c % 3), 1)), float(5 * band + rng.normal())))
    return spark.createDataFrame(
        pd.DataFrame(rows, columns=["unit_id", "cycle", *SETTINGS, *SENSORS])
    )


def test_scaler_uses_permitted_rows_and_population_variance(spark):
    pdf = pd.DataFrame([(u, c, c + 100.0 * u, 7.0) for u in range(1, 11) for c in range(1, 41)],
                       columns=["unit_id", "cycle", "f1", "f2"])
    df = spark.createDataFrame(pdf)
    roles = spark.createDataFrame([(u, "train" if u <= 8 else "validation") for u in range(1, 11)], "unit_id long, role string")
    params = scaling.fit_scaler(splits.rows_for(df, roles, "train"), ["f1", "f2"])
    got = {r["column"]: r for r in params.collect()}
    train = pdf[pdf.unit_id <= 8]["f1"]
    assert got["f1"]["mean"] == pytest.approx(train.mean())
    assert got["f1"]["scale"] == pytest.approx(train.std(ddof=0))
    assert got["f2"]["scale"] == 1.0
    scaled = scaling.apply_scaler(df, params, ["f1", "f2"])
    assert scaled.columns == df.columns
    assert scaled.agg(F.max(F.abs("f2"))).first()[0] == 0.0


def test_fold_scalers_equal_direct_fits(spark, noisy, noisy_frame):
    units = noisy.select("unit_id").distinct()
    folds = splits.fold_assignments(splits.group_folds(units, 3), 3)
    got = scaling.fold_scalers(noisy, folds, ["s1", "s3"]).toPandas().set_index(["fold", "column"])
    roles = folds.filter("role = 'outer_train'").toPandas()
    for fold, g in roles.groupby("fold"):
        rows = noisy_frame[noisy_frame.unit_id.isin(g.unit_id)]
        assert got.loc[(fold, "s1"), "mean"] == pytest.approx(rows["s1"].mean())
        assert got.loc[(fold, "s1"), "scale"] == pytest.approx(rows["s1"].std(ddof=0))
        assert got.loc[(fold, "s3"), "scale"] == 1.0
        assert got.loc[(fold, "s1"), "n"] == len(rows)


def test_variant_widths_and_unseen_units(regime_fleet):
    fitted = regime_fleet.filter("unit_id <= 4")
    widths = {"A": 2, "B": 5, "C": 2, "D": 2 + 3 + 6}
    for variant, width in widths.items():
        pre = regimes.fit_variant(fitted, variant, SENSORS, SETTINGS, k=6, n_init=2)
        assert len(pre.inputs) == width
        rows = regimes.variant_matrix(regime_fleet, pre)
        bad = rows.filter(" or ".join(f"isnan({c}) or {c} is null" for c in pre.inputs))
        assert rows.count() == 480 and bad.isEmpty()


def test_regimes_depend_on_settings_only(regime_fleet):
    model = regimes.fit_regimes(regime_fleet, SETTINGS, k=6, n_init=3)
    labelled = regimes.assign_regime(regime_fleet, model, SETTINGS)
    pairs = labelled.groupBy("setting_2", "setting_3").agg(F.count_distinct("regime").alias("n")).collect()
    assert len(pairs) == 6 and all(r["n"] == 1 for r in pairs)
    noisy = regime_fleet.withColumn("sensor_1", F.col("sensor_1") * 1000)
    again = regimes.assign_regime(noisy, model, SETTINGS).select("unit_id", "cycle", "regime")
    assert again.exceptAll(labelled.select("unit_id", "cycle", "regime")).isEmpty()
    hot = regimes.one_hot_regime(labelled, 6)
    total = sum(F.col(f"regime_{i}") for i in range(6))
    assert hot.filter(total != 1).isEmpty()


def _ml_cost(df, k, seed):
    points = VectorAssembler(inputCols=SETTINGS, outputCol="features").transform(df)
    return KMeans(k=k, seed=seed).fit(points).summary.trainingCost


def test_ten_starts_are_no_worse_than_ten_single_runs(spark):
    rng = np.random.default_rng(8)
    middles = rng.uniform(0, 100, (9, 3))
    # one place holds half of all rows, another a handful
    picks = rng.choice(9, 4000, p=[0.5, 0.2, 0.1, 0.1, 0.05, 0.02, 0.02, 0.0095, 0.0005])
    rows = [tuple(float(v) for v in middles[p] + rng.normal(0, 1, 3)) for p in picks]
    df = spark.createDataFrame(rows + [(None, 1.0, 1.0)], "setting_1 double, setting_2 double, setting_3 double")
    model = regimes.fit_regimes(df.repartition(6), SETTINGS, k=9, n_init=10)
    singles = [_ml_cost(df.dropna(), 9, s) for s in range(10)]
    assert model.cost == min(model.costs) and len(model.costs) == 10
    assert model.cost <= min(singles) * (1 + 1e-6)
    one = regimes.fit_regimes(df.repartition(6), SETTINGS, k=9, n_init=1)
    assert model.passes < 10 * one.passes / 2  # ten starts do not take ten times the scans
    labelled = regimes.assign_regime(df, model, SETTINGS)
    assert labelled.filter("regime is null").count() == 1
    table, names = np.array(rows), labelled.dropna().select("regime", *SETTINGS).toPandas()
    gaps = ((names[SETTINGS].to_numpy()[:, None] - model.centers[None]) ** 2).sum(axis=2)
    assert (gaps.argmin(axis=1) == names["regime"]).all() and gaps.min(axis=1).sum() == pytest.approx(model.cost)
    assert len(table) == len(names)


def test_repeated_settings_are_scanned_once(spark, monkeypatch):
    rng = np.random.default_rng(5)
    values = rng.integers(0, 4, (3000, 3)).astype(float)
    df = spark.createDataFrame([tuple(float(v) for v in r) for r in values], "setting_1 double, setting_2 double, setting_3 double")
    scanned, real = [], regimes._step
    monkeypatch.setattr(regimes, "_step", lambda points, *a: scanned.append(points.count()) or real(points, *a))
    model = regimes.fit_regimes(df.repartition(5), SETTINGS, k=5)
    assert max(scanned) <= 64  # places, however many rows
    gaps = ((values[:, None] - model.centers[None]) ** 2).sum(axis=2)
    assert gaps.min(axis=1).sum() == pytest.approx(model.cost)
    for i, centre in enumerate(model.centers):  # at rest over the rows
        np.testing.assert_allclose(values[gaps.argmin(axis=1) == i].mean(axis=0), centre, atol=1e-5)
    again = regimes.fit_regimes(df.repartition(3), SETTINGS, k=5)
    np.testing.assert_allclose(again.centers, model.centers, rtol=1e-12)


def test_fewer_places_than_regimes(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)] * 50 + [(4.0, 5.0, 6.0)] * 3, "setting_1 double, setting_2 double, setting_3 double")
    model = regimes.fit_regimes(df, SETTINGS, k=4)
    assert model.cost == 0
    assert regimes.assign_regime(df, model, SETTINGS).select("regime", *SETTINGS).distinct().count() == 2
    with pytest.raises(ValueError):
        regimes.fit_regimes(df.limit(0), SETTINGS)


def test_regime_scaling_centres_each_regime(regime_fleet):
    pre = regimes.fit_variant(regime_fleet, "C", SENSORS, SETTINGS, k=6, n_init=2)
    rows = regimes.variant_matrix(regime_fleet, pre)
    for r in rows.groupBy("regime").agg(F.avg("sensor_2").alias("m"), F.stddev_pop("sensor_2").alias("s")).collect():
        assert r["m"] == pytest.approx(0, abs=1e-9) and r["s"] == pytest.approx(1)


def test_unseen_regime_is_an_error(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (2, 0, 3.0), (3, 1, 5.0)], "unit_id long, regime int, s double")
    params = scaling.fit_scaler(df.filter("regime = 0"), ["s"], ["regime"])
    with pytest.raises(Exception, match="no scaler was fitted for 1"):
        scaling.apply_scaler(df, params, ["s"], ["regime"]).collect()
