"""Wavelets against matrices built from their definition, bases against all bases, distances against sorted values."""

import math

import numpy as np
import pytest

from tidemark.operators import stats, wavelets
from tidemark.plans import numeric


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")


def arrays(df, name):
    return np.array([r[name] for r in df.orderBy("id").collect()])


def step(n, h):
    """Matrix of one split: row k has the filter from place 2 k on, around the end."""
    g = [(-1) ** j * h[len(h) - 1 - j] for j in range(len(h))]
    out = np.zeros((n, n))
    for k in range(n // 2):
        for j in range(len(h)):
            out[k, (2 * k + j) % n] += h[j]
            out[n // 2 + k, (2 * k + j) % n] += g[j]
    return out


def all_nodes(x, levels, h):
    out = {(0, 0): x}
    for k in range(levels):
        for i in range(2**k):
            c = step(len(out[k, i]), h) @ out[k, i]
            out[k + 1, 2 * i], out[k + 1, 2 * i + 1] = np.split(c, 2)
    return out


def bases(node, levels):
    yield [node]
    if node[0] < levels:
        for a in bases((node[0] + 1, 2 * node[1]), levels):
            for b in bases((node[0] + 1, 2 * node[1] + 1), levels):
                yield a + b


@pytest.mark.parametrize("moments", [1, 2, 3, 6])
def test_filters(moments):
    """Orthonormal, and so many powers of the place vanish."""
    h = wavelets.low_pass(moments)
    assert len(h) == 2 * moments and math.isclose(h.sum(), math.sqrt(2))
    for k in range(moments):
        assert abs((h[2 * k :] * h[: len(h) - 2 * k]).sum() - (k == 0)) < 1e-9
        assert abs((wavelets.high_pass(h) * np.arange(len(h)) ** k).sum()) < 1e-5
    if moments == 2:
        assert np.allclose(h, (np.array([1, 3, 3, 1]) + math.sqrt(3) * np.array([1, 1, -1, -1])) / (4 * math.sqrt(2)))


@pytest.mark.parametrize("moments", [1, 2, 4])
def test_coefficients_and_back(spark, moments):
    x = np.random.default_rng(moments).normal(size=(9, 16))
    h, nodes = wavelets.low_pass(moments), wavelets.wavelet_nodes(3)
    assert nodes == [(3, 0), (3, 1), (2, 1), (1, 1)]
    df = frame(spark, x).repartition(3).withColumn("c", wavelets.decomposed("x", nodes, moments))
    want = [np.concatenate([all_nodes(v, 3, h)[k] for k in nodes]) for v in x]
    assert np.allclose(arrays(df, "c"), want, atol=1e-10)
    assert np.allclose(arrays(df.withColumn("y", wavelets.rebuilt("c", nodes, moments)), "y"), x, atol=1e-10)


def test_lengths_nulls_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 4.0, 2.0]), (1, None), (2, []), (3, [5.0]), (4, [1.0, 4.0, 2.0, 2.0])], "id long, x array<double>")
    nodes = wavelets.wavelet_nodes(2)
    got = df.withColumn("c", wavelets.decomposed("x", nodes, 1)).withColumn("y", wavelets.rebuilt("c", nodes, 1)).withColumn("m", wavelets.multiwavelet("x", 1))
    rows = {r.id: r for r in got.collect()}
    assert rows[1].c is None and rows[1].y is None and rows[1].m is None and rows[2].c == rows[2].y == rows[2].m == []
    assert np.allclose(rows[0].y, [1, 4, 2, 2]) and rows[0].c == rows[4].c and np.allclose(rows[3].y, [5] * 4) and len(rows[3].m) == 4


def test_best_basis_has_the_least_entropy_of_all(spark):
    t = np.arange(16)
    x = np.sin(1.3 * t) + 0.3 * np.sin(2.9 * t) + 0.01 * np.random.default_rng(3).normal(size=(5, 16))
    basis = wavelets.best_basis(frame(spark, x), "x", 3, 2)
    nodes = all_nodes(x.mean(0), 3, wavelets.low_pass(2))
    cost = lambda b: sum(-(c**2 * np.log(c**2)).sum() for c in (nodes[k] for k in b))
    assert math.isclose(cost(basis), min(map(cost, bases((0, 0), 3))), abs_tol=1e-9) and len(basis) > 1
    df = frame(spark, x).withColumn("c", wavelets.decomposed("x", basis))
    assert np.allclose(arrays(df.withColumn("y", wavelets.rebuilt("c", basis)), "y"), x, atol=1e-10)
    assert wavelets.best_basis(frame(spark, x).where("false"), "x", 3) == [(0, 0)]


def test_two_wavelets_keep_lengths_and_come_back(spark):
    x = np.random.default_rng(5).normal(size=(6, 24))
    df = frame(spark, x).withColumn("c", wavelets.multiwavelet("x", 3)).withColumn("y", wavelets.from_multiwavelet("c", 3))
    c = arrays(df, "c")
    assert c.shape == (6, 48) and np.allclose((c**2).sum(1), (x**2).sum(1)) and np.allclose(arrays(df, "y"), x, atol=1e-10)
    line = wavelets.pairs(np.full((1, 32), 3.0), 3)
    assert np.allclose(line[0, 8:], 0, atol=1e-12)  # constants have no wavelets
    v = wavelets.pairs(x[:1], 1)[0]  # one step by its definition
    two = x[0][:, None] * np.array([math.sqrt(2), 1]) / math.sqrt(3)
    for k in range(12):
        parts = [two[(2 * k + j) % 24] for j in range(4)]
        assert np.allclose(v[2 * k : 2 * k + 2], sum(m @ p for m, p in zip(wavelets.PAIR_LOW, parts)))
        assert np.allclose(v[24 + 2 * k : 26 + 2 * k], sum(m @ p for m, p in zip(wavelets.PAIR_HIGH, parts)))


def distance(v, within=3.0):
    v = np.sort(v)
    v = v[np.abs(v - v.mean()) <= within * v.std()] if v.min() < v.max() else v
    if v.min() == v.max():
        return 0.0
    p = np.array([0.5 * math.erfc(-(a - v.mean()) / v.std(ddof=1) / math.sqrt(2)) for a in v])
    return max(max(abs((v <= a).mean() - q), abs((v < a).mean() - q)) for a, q in zip(v, p))


def features(n=400, seed=2):
    rng = np.random.default_rng(seed)
    two = np.where(rng.random(n) < 0.4, -3, 3) + rng.normal(size=n)
    far = rng.normal(size=n)
    far[:3] = 60
    return np.stack([rng.normal(size=n), two, np.round(rng.normal(size=n)), np.full(n, 0.1), far + 1e6, rng.exponential(size=n)], axis=1)


@pytest.mark.parametrize("rows", [None, 50])
def test_distances(spark, monkeypatch, rows):
    if rows:
        monkeypatch.setattr(stats, "WINDOW_ROWS", rows)  # features are cut into ranges
    x = features()
    df = frame(spark, x).unionByName(spark.createDataFrame([(-1, None), (-2, [None, float("nan")])], "id long, x array<double>"))
    got = {r.k: r.distance for r in wavelets.normal_distances(df, "x").collect()}
    assert np.allclose([got[k] for k in range(6)], [distance(x[:, k]) for k in range(6)], atol=1e-7)
    best = {r.id: r.best for r in wavelets.best_features(df, "x", 2).collect()}
    order = sorted(range(6), key=lambda k: (-got[k], k))[:2]
    assert best[-1] is None and best[7] == x[7, order].tolist() and 1 in order


def test_queries_by_numpy(spark, data):
    rows = spark.read.parquet(f"{data}/sf0.001/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    h = wavelets.low_pass(2)
    nodes = all_nodes(x.mean(0), 4, h)
    cost = lambda k: -sum(float(v * v * math.log(v * v)) for v in nodes[k] if v)

    def least(k):
        if k[0] == 4:
            return cost(k), [k]
        a, b = least((k[0] + 1, 2 * k[1])), least((k[0] + 1, 2 * k[1] + 1))
        return (cost(k), [k]) if cost(k) <= a[0] + b[0] else (a[0] + b[0], a[1] + b[1])

    basis = least((0, 0))[1]
    c = np.array([np.concatenate([all_nodes(v, 4, h)[k] for k in basis]) for v in x])
    far = [distance(c[:, k]) for k in range(c.shape[1])]
    order = sorted(range(len(far)), key=lambda k: (-round(far[k], 9), k))[:10]
    got = {r.vec_id: r.best for r in numeric.QUERIES["packet_features"](spark, f"{data}/sf0.001").collect()}
    assert len(got) == len(x) and np.allclose([got[r.vec_id] for r in rows], c[:, order], atol=1e-6)
    m = wavelets.pairs(x, 3)
    m = m[:, m.shape[1] // 8 :]
    told = {r.k: r.distance for r in numeric.QUERIES["multiwavelet_distances"](spark, f"{data}/sf0.001").collect()}
    assert np.allclose([told[k] for k in range(m.shape[1])], [distance(v) for v in m.T], atol=1e-6)
