from __future__ import annotations

import math

import numpy as np
import pytest

from wearmark.llm import whitening


def brute(vectors):
    """Rows kept, exact fit statistics and whitened values by plain numpy."""
    kept = [(i, v) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    xs = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in kept]
    fit = sorted({x for _, x in xs})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    apart = np.array(fit, float) - np.array(sums) / n
    cov = apart.T @ apart / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(x, sums)) for _, x in xs]
    projected = (np.array([x for _, x in xs], float) - np.array(sums) / n) @ axes[:, :4] / np.sqrt(values[:4])
    return xs, n, deviation, projected, values / values.sum()


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 12)) * np.linspace(3, 0.2, 12) @ rng.normal(size=(12, 12))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base.astype(np.float32))]
    rows += [(i, rows[7][1]) for i in range(400, 700)]  # one vector holds half of all rows
    rows += [(7, rows[7][1]), (None, rows[8][1])]
    rows += [(900, None), (901, []), (902, [float("nan")] * 12), (903, [None] + [1.0] * 11)]
    rows += [(904, [float("-inf")] + [0.0] * 11), (905, [0.0] * 12), (906, [-0.0] * 12)]
    return rows


def test_equals_plain_numpy(spark, vectors):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").selectExpr("*", "1 AS n", "2 AS key", "3 AS x")
    got = whitening.whitened(df.repartition(5)).collect()
    xs, n, deviation, projected, shares = brute(vectors)
    assert len(got) == 4 * len(xs) and {r.n for r in got} == {n}
    assert max(r.identity_error for r in got) < 1e-9
    find = lambda i: sorted((r for r in got if r.vec_id == i), key=lambda r: r.component)[:4]
    signs = None
    for k, (i, _) in enumerate(xs):
        rows = sorted((r for r in got if r.vec_id == i), key=lambda r: r.component)
        assert {int(r.deviation) for r in rows} == {deviation[k]}
        values = [np.mean([r.whitened for r in rows if r.component == c]) for c in range(1, 5)]
        if signs is None:
            signs = np.sign(values) * np.sign(projected[k])
        assert np.allclose(values, projected[k] * signs, atol=1e-9)
    assert np.allclose([r.explained for r in find(3)], shares[:4], rtol=1e-9)
    assert sum(r.vec_id is None for r in got) == 4 and sum(r.vec_id == 7 for r in got) == 8


def test_partitioning_does_not_matter(spark, vectors):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    one, two = (whitening.whitened(df.repartition(p)).collect() for p in (1, 7))
    order = lambda rows: sorted(((r.vec_id is None, r.vec_id or 0, r.component, int(r.deviation), round(r.whitened, 8)) for r in rows))
    assert order(one) == order(two)


@pytest.mark.parametrize(
    "rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [])]]
)
def test_nothing_to_whiten(spark, rows):
    found = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert found.count() == 0


def test_fewer_dimensions_than_components(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 4.0]), (4, [9.0, 9.0, 9.0])]
    found = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r.vec_id, r.component) for r in found} == {(v, c) for v in (1, 2, 3) for c in (1, 2)}
    assert abs(sum(r.explained for r in found) / 3 - 1) < 1e-12


def test_deviation_beyond_64_bits_is_exact(spark):
    rows = [(i, [float(1 << 40) * i, 1.0]) for i in range(1, 5)]
    found = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    xs = {i: ((1 << 48) * i, 256) for i in range(1, 5)}
    sums = [sum(c) for c in zip(*xs.values())]
    for r in found:
        assert int(r.deviation) == sum((4 * c - s) ** 2 for c, s in zip(xs[r.vec_id], sums))


def test_factor_and_rotations():
    rng = np.random.default_rng(5)
    for d, rank in ((1, 1), (5, 5), (9, 3), (40, 40)):
        half = rng.normal(size=(d, rank)) * np.logspace(0, -4, rank)
        a = half @ half.T
        factor = whitening.pivoted_cholesky(a)
        assert factor.shape[1] <= d and np.allclose(factor @ factor.T, a, atol=1e-13 * np.trace(a))
        values, axes = whitening.eigen(a)
        want = np.linalg.eigvalsh(a)[::-1]
        assert np.allclose(values[:rank], want[:rank], rtol=1e-6, atol=1e-14 * want[0])
        assert np.allclose(axes.T @ axes, np.eye(axes.shape[1]), atol=1e-12)
    assert whitening.eigen(np.zeros((3, 3)))[0].size == 0
