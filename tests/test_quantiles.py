import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wearmark.operators import quantiles


def _values(kind):
    rng = np.random.default_rng(3)
    if kind == "normal":
        return rng.normal(0, 1, 501)
    if kind == "outlier":
        return np.concatenate([rng.uniform(0, 1e-6, 300), [1e300, -1e300]])
    if kind == "ties":
        return np.repeat([1.0, 2.0, 2.0, 7.5], 50)
    return np.array([4.25])


@pytest.mark.parametrize("kind", ["normal", "outlier", "ties", "single"])
@pytest.mark.parametrize("levels", [0, 2])
def test_matches_numpy(spark, kind, levels):
    v = _values(kind)
    df = spark.createDataFrame(pd.DataFrame({"x": v}))
    got = quantiles.exact_quantiles(df, "x", [0.0, 0.1, 0.5, 0.83, 1.0], levels=levels).toPandas()
    for p, q in zip(got["prob"], got["quantile"]):
        assert q == pytest.approx(np.quantile(v, p), rel=1e-12, abs=1e-300)


def test_groups_weights_and_nan(spark):
    pdf = pd.DataFrame(
        {"g": ["a"] * 4 + ["b"] * 3, "x": [1.0, 2.0, 3.0, np.nan, 5.0, 9.0, 7.0], "w": [3, 1, 1, 9, 1, 0, 1]}
    )
    df = spark.createDataFrame(pdf)
    got = dict(
        quantiles.exact_median(df, "x", ["g"], F.col("w")).select("g", "median").toPandas().itertuples(index=False)
    )
    assert got == {"a": 1.0, "b": 6.0}
