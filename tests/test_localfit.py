"""Local fits against weighted least squares at every vertex, and the criteria against whole hat matrices."""

import math

import numpy as np
import pytest

from tidemark.operators import localfit
from tidemark.operators.localfit import Smooth, local_fit

KERNEL = {"tcub": lambda u: (1 - abs(u) ** 3) ** 3, "bisq": lambda u: (1 - u**2) ** 2}


def data(n, seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.uniform(0, 10, n) ** 1.3, 2)
    return x, np.sin(x / 3) + rng.normal(0, 0.2, n)


def bandwidth(x, v, s):
    return max(s.h, np.sort(np.abs(x - v))[max(1, math.floor(len(x) * s.nn + 1e-9)) - 1]) if s.nn > 0 else s.h


def row(x, v, h, s, w=1.0):
    """Value, slope, and the weights of all responses in the value."""
    u = (x - v) / h
    k = np.where(np.abs(u) < 1, KERNEL[s.kernel](u), 0) * w
    a = (x - v)[:, None] ** np.arange(s.degree + 1)
    m = np.linalg.inv(a.T @ (k[:, None] * a)) @ (a * k[:, None]).T
    return m


def vertices(x, s):
    out, stack = {x.min(), x.max()}, [(x.min(), x.max())]
    while stack:
        a, b = stack.pop()
        if b - a > s.cut * min(bandwidth(x, a, s), bandwidth(x, b, s)):
            m = (a + b) / 2
            out.add(m)
            stack += [(a, m), (m, b)]
    return sorted(out)


@pytest.mark.parametrize("s", [Smooth(nn=0.3), Smooth(nn=0.05, h=0.9, degree=1, kernel="bisq"), Smooth(nn=0.0, h=2.0, degree=3), Smooth(nn=0.02, h=0.3, degree=0)])
def test_tree_and_fits(spark, monkeypatch, s):
    monkeypatch.setattr(localfit, "BLOCK", 64)
    keyed = {"a": data(300, 1), None: data(211, 2)}
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (x, y) in keyed.items() for a, b in zip(x, y)] + [("a", None, 1.0), ("a", 1.0, None), ("a", float("nan"), 1.0)], "g string, x double, y double")
    fit = local_fit(df, ["g"], "x", "y", smooth=s)
    got = {}
    for r in fit.table().collect():
        got.setdefault(r.g, {})[round(r.v, 9)] = r
    assert set(got) == {"a", None}
    for k, (x, y) in keyed.items():
        want = vertices(x, s)
        assert sorted(got[k]) == pytest.approx(want)
        for v in want:
            r, h = got[k][round(v, 9)], bandwidth(x, v, s)
            m = row(x, v, h, s)
            assert r.h == pytest.approx(h) and r.value == pytest.approx(m[0] @ y, abs=1e-8)
            assert r.slope == pytest.approx(m[1] @ y if s.degree else 0.0, abs=1e-6)
            assert r.variance == pytest.approx(m[0] @ m[0], abs=1e-8)


def test_criteria_at_every_point_are_those_of_the_hat_matrix(spark):
    """With each x a vertex nothing is interpolated; influence, cross-validation and degrees of freedom are exact."""
    x, y = data(90, 4)
    s = Smooth(nn=0.4, degree=1)
    fit = local_fit(spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y)], "g int, x double, y double"), ["g"], "x", "y", smooth=s, ev="data")
    r = fit.criteria().first()
    hat = np.stack([row(x, v, bandwidth(x, v, s), s)[0] for v in x])
    e = y - hat @ y
    left = []
    for i, v in enumerate(x):  # the point left out, with the same bandwidth
        m = row(np.delete(x, i), v, bandwidth(x, v, s), s)
        left.append(y[i] - m[0] @ np.delete(y, i))
    n, rss = len(x), float(e @ e)
    want = {"n": n, "likelihood": -rss / 2, "df0": np.trace(hat), "df1": (hat**2).sum(), "gcv": n * rss / (n - np.trace(hat)) ** 2, "lcv": float(np.square(left).sum()), "aic": rss + 2 * np.trace(hat)}
    assert all(r[k] == pytest.approx(want[k], rel=1e-8) for k in want)


def test_interpolated_criteria_are_near_the_exact_ones(spark):
    x, y = data(400, 5)
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y)], "g int, x double, y double")
    near, exact = (local_fit(df, ["g"], "x", "y", smooth=Smooth(nn=0.3), ev=ev).criteria().first() for ev in ("tree", "data"))
    assert near.df0 == pytest.approx(exact.df0, rel=0.05) and near.gcv == pytest.approx(exact.gcv, rel=0.05) and near.lcv == pytest.approx(exact.lcv, rel=0.05)


def test_prediction_keeps_rows_and_cubics(spark):
    """A cubic is fitted exactly by cubics, and the interpolation keeps it between vertices."""
    x = np.linspace(-2, 3, 120)
    df = spark.createDataFrame([(1, float(a), float(a**3 - a)) for a in x], "g int, x double, y double")
    fit = local_fit(df, ["g"], "x", "y", smooth=Smooth(nn=0.5, degree=3))
    asked = spark.createDataFrame([(1, 0.123), (1, 2.9), (2, 1.0), (1, None)], "g int, at double")
    got = {(r.g, r.at): r.fit for r in fit.predict(asked, "at").collect()}
    assert got[1, 0.123] == pytest.approx(0.123**3 - 0.123, abs=1e-7) and got[1, 2.9] == pytest.approx(2.9**3 - 2.9, abs=1e-6)
    assert got[2, 1.0] is None and got[1, None] is None and len(got) == 4


@pytest.mark.parametrize("family", ["binomial", "poisson"])
def test_likelihood_fits_solve_the_score_equations(spark, family):
    rng = np.random.default_rng(6)
    x, w = rng.uniform(0, 5, 250), rng.integers(1, 6, 250).astype(float)
    y = rng.binomial(w.astype(int), 1 / (1 + np.exp(2 - x))) if family == "binomial" else rng.poisson(w * np.exp(x / 3))
    s = Smooth(nn=0.5, degree=1, family=family)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x, y, w)], "x double, y double, w double").withColumn("g", __import__("pyspark").sql.functions.lit("k"))
    fit = local_fit(df, ["g"], "x", "y", "w", smooth=s, ev="grid", points=5)
    rows = fit.table().collect()
    assert len(rows) == 5
    for r in rows:
        u = (x - r.v) / r.h
        k = np.where(np.abs(u) < 1, KERNEL["tcub"](u), 0)
        mean = s.mean(r.value + r.slope * (x - r.v))
        for a in (np.ones_like(x), x - r.v):
            assert abs((k * a * (y - w * mean)).sum()) < 1e-6
    c = fit.criteria().first()
    assert c.n == 250 and 2 < c.df0 < 10 and c.likelihood < 0 and c.lcv > -2 * c.likelihood


def test_order_statistic_is_exact_with_ties(spark, monkeypatch):
    monkeypatch.setattr(localfit, "BLOCK", 16)
    x = np.round(np.random.default_rng(7).uniform(0, 3, 200), 1)
    df = spark.createDataFrame([("k", float(a), 0.0) for a in x], "g string, x double, y double")
    blocks = localfit.packed(df, ["g"], "x", "y")
    key = blocks.first()["_k"]
    asked = [(key, v, k) for v in (0.0, 1.05, 7.0) for k in (1, 2, 77, 200)]
    for v, k in {(v, k) for _, v, k in asked}:
        got = localfit.order_statistic(blocks, spark.createDataFrame([(key, v, k)], "_k string, v double, left long")).first()
        assert got.distance == np.sort(np.abs(x - v))[k - 1]
        if k == 77:
            break


def test_one_point_and_none(spark):
    df = spark.createDataFrame([("one", 2.0, 5.0), ("same", 1.0, 1.0), ("same", 1.0, 3.0), ("none", None, 1.0)], "g string, x double, y double")
    got = {r.g: r for r in local_fit(df, ["g"], "x", "y").table().collect()}
    assert set(got) == {"one", "same"} and got["one"].value == 5 and got["same"].value == 2
