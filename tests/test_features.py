import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wearmark.operators import features

COLS = ["s1", "s2", "s3"]


def brute(frame, w, cols=COLS):
    """Features by direct definition, one history at a time."""
    out = []
    for unit, g in frame.sort_values(["unit_id", "cycle"]).groupby("unit_id"):
        x = g[cols].to_numpy(float)
        for i, cycle in enumerate(g["cycle"]):
            seen = x[max(0, i + 1 - w) if w else 0 : i + 1]
            n = len(seen)
            t = np.arange(n)
            line = {"unit_id": unit, "cycle": cycle, "engine_age": cycle, "history_length": n}
            for j, c in enumerate(cols):
                v = seen[:, j]
                line |= {
                    f"{c}_latest": v[-1],
                    f"{c}_mean": v.mean(),
                    f"{c}_std": v.std(),
                    f"{c}_min": v.min(),
                    f"{c}_max": v.max(),
                    f"{c}_slope": np.polyfit(t, v, 1)[0] if n > 1 else 0.0,
                    f"{c}_delta": v[-1] - v[0],
                }
                for k in (5, 10):
                    line[f"{c}_last{k}_mean"] = v[-k:].mean() if n >= k else v[-1]
            out.append(line)
    return pd.DataFrame(out)


def check(got, want):
    keys = ["unit_id", "cycle"]
    got = got.sort_values(keys).reset_index(drop=True)
    want = want.sort_values(keys).reset_index(drop=True)
    assert len(got) == len(want)
    for c in want.columns:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-9, err_msg=c)


@pytest.mark.parametrize("w", [30, 7, 1, None])
@pytest.mark.parametrize("size", [32, 65_536])
def test_dense_features(noisy, noisy_frame, w, size):
    got = features.dense_features(noisy, COLS, w, gapless=True, segment_rows=size)
    assert set(got.columns) == {"unit_id", "cycle", *features.feature_names(COLS)}
    check(got.toPandas(), brute(noisy_frame, w))


@pytest.mark.parametrize("w", [2, 10, 37, 150])
@pytest.mark.parametrize("size", [8, 37])
def test_windows_of_two_blocks(noisy, noisy_frame, w, size):
    """Windows that end on, before and after the borders of blocks and segments."""
    got = features.dense_features(noisy, COLS, w, gapless=True, segment_rows=size)
    check(got.toPandas(), brute(noisy_frame, w))


def test_windowed_plan_shuffles_once(noisy):
    dense = features.dense_features(noisy, COLS, 30, gapless=True)
    plan = dense._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 2


@pytest.mark.parametrize("w", [12, None])
def test_dense_features_with_gaps(spark, gapped_frame, w):
    got = features.dense_features(spark.createDataFrame(gapped_frame), COLS, w, segment_rows=16)
    check(got.toPandas(), brute(gapped_frame, w))


@pytest.mark.parametrize("w", [30, 6, None])
@pytest.mark.parametrize("size", [32, 65_536])
def test_sparse_features_equal_dense(spark, noisy, noisy_frame, w, size):
    want = brute(noisy_frame, w)
    want = want[(want["cycle"] * 7 + want["unit_id"]) % 5 < 2]
    manifest = spark.createDataFrame(want[["unit_id", "cycle"]].rename(columns={"cycle": "cutoff_cycle"}))
    got = features.features_at(noisy, manifest, COLS, w, gapless=True, segment_rows=size).toPandas()
    check(got.rename(columns={"cutoff_cycle": "cycle"}), want)


@pytest.mark.parametrize("w", [12, None])
def test_sparse_features_with_gaps(spark, gapped_frame, w):
    want = brute(gapped_frame, w)
    manifest = spark.createDataFrame(want[["unit_id", "cycle"]].rename(columns={"cycle": "cutoff_cycle"}))
    got = features.features_at(spark.createDataFrame(gapped_frame), manifest, COLS, w, segment_rows=16)
    check(got.toPandas().rename(columns={"cutoff_cycle": "cycle"}), want)


def test_future_rows_never_matter(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"unit_id": 1, "cycle": range(1, 101), "s": rng.normal(0, 1, 100)})
    pdf.loc[pdf["cycle"] > 60, "s"] = 1e6
    manifest = spark.createDataFrame([(1, 30), (1, 50), (1, 60)], "unit_id long, cutoff_cycle long")
    got = features.features_at(spark.createDataFrame(pdf), manifest, ["s"], None, gapless=True, segment_rows=16)
    assert got.agg(F.max(F.abs("s_mean")), F.max("s_max")).first()[1] < 100


@pytest.mark.parametrize("w", [30, 45])
def test_legacy_features_equal_padded_windows(spark, noisy, noisy_frame, w):
    ends = noisy_frame.groupby("unit_id")["cycle"].max().reset_index(name="cutoff_cycle")
    got = features.legacy_features(noisy, spark.createDataFrame(ends), COLS, w, gapless=True, segment_rows=64)
    got = got.toPandas().set_index("unit_id")
    for unit, g in noisy_frame.groupby("unit_id"):
        x = g.sort_values("cycle")[COLS].to_numpy(float)[-w:]
        x = np.vstack([np.zeros((w - len(x), 3)), x])
        for j, c in enumerate(COLS):
            v = x[:, j]
            want = [v[-1], v.mean(), v.std(), v.min(), v.max(), np.polyfit(np.arange(w), v, 1)[0], v[-5:].mean(), v[-10:].mean()]
            have = [got.loc[unit, f"{c}_{k}"] for k in features.LEGACY_GROUPS]
            np.testing.assert_allclose(have, want, rtol=1e-7, atol=1e-7)


def test_linear_window_closed_form(spark):
    rows = [(1, c, 2.0 * (c - 1)) for c in range(1, 31)]
    df = spark.createDataFrame(rows, "unit_id long, cycle long, x double")
    last = features.dense_features(df, ["x"], 30, gapless=True).filter("cycle = 30").first()
    assert last["x_slope"] == pytest.approx(2.0)
    assert last["x_latest"] == 58 and last["x_last5_mean"] == 54 and last["x_delta"] == 58


@pytest.mark.parametrize("kind", ["outlier", "drift"])
@pytest.mark.parametrize("size", [64, 65_536])
def test_moments_keep_their_digits(spark, kind, size):
    rng = np.random.default_rng(2)
    x = 1e6 + rng.normal(0, 0.01, 300) if kind == "outlier" else np.arange(300) * 1e4 + rng.normal(0, 0.01, 300)
    x[0] = 0.0
    pdf = pd.DataFrame({"unit_id": 1, "cycle": range(1, 301), "s": x})
    df = spark.createDataFrame(pdf)
    for w in (30, None):
        dense = features.dense_features(df, ["s"], w, gapless=True, segment_rows=size).toPandas()
        check(dense, brute(pdf, w, ["s"]))
        cuts = spark.createDataFrame([(1, c) for c in (40, 150, 300)], "unit_id long, cutoff_cycle long")
        sparse = features.features_at(df, cuts, ["s"], w, gapless=True, segment_rows=size).toPandas()
        want = brute(pdf, w, ["s"])
        check(sparse.rename(columns={"cutoff_cycle": "cycle"}), want[want["cycle"].isin([40, 150, 300])])


def test_manifest_lines_without_rows_raise(spark, noisy):
    cuts = spark.createDataFrame([(1, 1), (77, 5)], "unit_id long, cutoff_cycle long")
    with pytest.raises(Exception, match="no rows for unit 77"):
        features.features_at(noisy, cuts, ["s1"], 5, gapless=True).collect()
