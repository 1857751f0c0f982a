"""Models, sorting, maps and waveforms against numpy and closed forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import maps, models, sorting, waveforms


def test_linear_against_lstsq(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 2))
    y = 2 + x @ [1.5, -0.7] + 0.3 * rng.standard_normal(200)
    df = spark.createDataFrame([("a", 1.0, *map(float, r), float(v)) for r, v in zip(x, y)] + [("b", 1.0, 1.0, 2.0, 3.0), ("a", None, 1.0, 1.0, 1.0)], "g string, one double, x1 double, x2 double, y double")
    got = {r.g: r for r in models.linear(df, "y", ["one", "x1", "x2"], ["g"], contrast=[0, 1, -1]).collect()}
    a = np.c_[np.ones(200), x]
    b, rest, *_ = np.linalg.lstsq(a, y, rcond=None)
    var = rest[0] / 197
    c = np.array([0, 1, -1])
    assert np.allclose(got["a"].betas, b) and got["a"].dof == 197
    assert np.allclose(got["a"].se, np.sqrt(np.diag(np.linalg.inv(a.T @ a)) * var))
    assert abs(got["a"].t - c @ b / math.sqrt(var * c @ np.linalg.inv(a.T @ a) @ c)) < 1e-8
    assert abs(got["a"].r2 - (1 - rest[0] / ((y - y.mean()) ** 2).sum())) < 1e-9 and got["b"].t == 0


def test_response_and_design(spark):
    h = models.haemodynamic(2.0)
    assert abs(sum(h) - 1) < 1e-12 and np.argmax(h) in (2, 3)
    on = spark.createDataFrame([(1, "a", 2, 4), (1, "a", 5, 6), (1, "b", 8, 8)], "run long, p string, a long, b long")
    got = {r.volume: r.x for r in models.design(on, "run", "p", "a", "b", 12, h).collect()}
    box = np.zeros(12)
    box[[2, 3, 5]] = 1
    assert np.allclose([got.get(k, 0.0) for k in range(12)], np.convolve(box, h)[:12])
    assert models.impulse_columns(on, "run", "p", "a", 3).where("p = 'b'").count() == 3


def test_prewhitening_takes_out_the_lag(spark):
    rng = np.random.default_rng(2)
    e = np.zeros(3000)
    for k in range(1, 3000):
        e[k] = 0.5 * e[k - 1] + rng.standard_normal()
    df = spark.createDataFrame([("a", k, 1.0, float(v)) for k, v in enumerate(e)], "g string, i long, one double, y double")
    out = models.prewhitened(df, "y", ["one"], ["g"], "i").orderBy("i").collect()
    assert abs(out[0].rho - 0.5) < 0.051 and len(out) == 2999
    y = np.array([r.y for r in out])
    assert abs(np.corrcoef(y[1:], y[:-1])[0, 1]) < 0.06


def test_robust_fit_leaves_outliers_alone(spark):
    rng = np.random.default_rng(3)
    x = np.arange(60.0)
    y = 3 + 2 * x + 0.1 * rng.standard_normal(60)
    y[::10] += 500
    df = spark.createDataFrame([(1, 1.0, float(a), float(b)) for a, b in zip(x, y)], "g long, one double, x double, y double")
    r = models.robust(df, "y", ["one", "x"], ["g"]).first()
    assert np.allclose(r.betas, [3, 2], atol=0.1) and r.weight < 0.95
    m = models.robust(df.withColumn("y", F.when(F.col("x") == 0, 1e6).otherwise(F.col("x") * 0 + 7.0)), "y", ["one"], ["g"]).first()
    assert abs(m.betas[0] - 7) < 0.01


@pytest.mark.parametrize("corrected", [False, True])
def test_bootstrap_interval(spark, corrected):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(k, "a", float(v)) for k, v in enumerate(rng.normal(5, 2, 400))], "id long, g string, v double")
    r = models.bootstrap_mean(df, "v", "id", ["g"], rounds=400, corrected=corrected).first()
    assert r.low < r["mean"] < r.high and abs((r.high - r.low) - 2 * 1.96 * 2 / 20) < 0.12
    again = models.bootstrap_mean(df.repartition(7), "v", "id", ["g"], rounds=400, corrected=corrected).first()
    assert abs(again.low - r.low) < 1e-9


def test_sign_permutation(spark):
    df = spark.createDataFrame([(k, "up", 1.0 + 0.1 * (k % 3)) for k in range(12)] + [(k, "flat", float((-1) ** k)) for k in range(12)], "id long, g string, v double")
    got = {r.g: r.p for r in models.sign_permutation(df, "v", "id", ["g"]).collect()}
    assert got["up"] > 0.99 and 0.3 < got["flat"] < 0.7


def test_mediation_and_intraclass(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal(500)
    m = 0.8 * x + 0.2 * rng.standard_normal(500)
    y = 0.5 * m + 0.2 * rng.standard_normal(500)
    df = spark.createDataFrame([("a", float(i), float(j), float(k)) for i, j, k in zip(x, m, y)], "g string, x double, m double, y double")
    r = models.mediation(df, "x", "m", "y", ["g"]).first()
    assert abs(r.indirect - 0.4) < 0.1 and abs(r.direct) < 0.15 and r.z > 5
    rows = [("a", s, float(s + 0.01 * k)) for s in range(10) for k in range(4)]
    assert models.intraclass(spark.createDataFrame(rows, "g string, s long, v double"), "v", "s", ["g"]).first().icc > 0.99


def test_fits(spark):
    x = np.linspace(-5, 5, 21)
    y = 4 * np.exp(-((x - 1) ** 2) / (2 * 1.5**2)) + 0.5
    r = models.gaussian_tuning(spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(x, y)], "g string, x double, y double"), "x", "y", ["g"]).first()
    assert np.allclose([r.height, r.centre, r.width, r.base], [4, 1, 1.5, 0.5], atol=0.02) and r.r2 > 0.999
    c = np.linspace(0.05, 2, 20)
    y = 0.5 + 0.48 * (1 - np.exp(-((c / 0.6) ** 2.5)))
    r = models.weibull_fit(spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(c, y)], "g string, x double, y double"), "x", "y", ["g"]).first()
    assert abs(r.scale - 0.6) < 0.02 and abs(r.shape - 2.5) < 0.15 and abs(r.lapse - 0.02) < 0.01
    rng = np.random.default_rng(6)
    for link in ("logit", "probit"):
        u = rng.uniform(-3, 3, 3000)
        p = 1 / (1 + np.exp(-2 * (u - 0.5)))
        df = spark.createDataFrame([("a", float(round(a, 1)), float(b)) for a, b in zip(u, rng.random(3000) < p)], "g string, x double, y double")
        r = models.logistic_fit(df, "x", "y", ["g"], link).first()
        assert abs(r.middle - 0.5) < 0.15 and abs(r.slope / (2 if link == "logit" else 1.17) - 1) < 0.2


def test_repeated_anova_of_two_levels_is_a_squared_paired_t(spark):
    rng = np.random.default_rng(7)
    a, b = rng.standard_normal(12), rng.standard_normal(12) + 0.5
    df = spark.createDataFrame([("g", s, l, float(v)) for s in range(12) for l, v in (("a", a[s]), ("b", b[s]))], "g string, s long, l string, v double")
    r = models.repeated_anova(df, "v", "s", "l", ["g"]).first()
    d = a - b
    assert abs(r.f - (math.sqrt(12) * d.mean() / d.std(ddof=1)) ** 2) < 1e-8 and (r.df_effect, r.df_error) == (1, 11)


def test_detection_is_greedy(spark):
    x = np.zeros(100)
    x[[2, 20, 22, 30, 98]] = -5
    x[31] = 5
    df = spark.createDataFrame([(1, x.tolist()), (2, None), (3, [])], "k long, x array<double>")
    at = lambda **k: sorted(r.at for r in sorting.detect(df, ["k"], "x", F.lit(-3.0), 4, 6, 5, **k).collect())
    assert at() == [20, 30] and at(polarity="both") == [30] and at(polarity="pos") == [31] and at(polarity="either") == [20, 30]


def test_alignment(spark):
    w = [[0, 0, -5, 1, 0], [0, 0, -4, 1, 0], [0, -6, 2, 0, 9]]
    got = {r.k: (r.w, r["shift"]) for r in sorting.modal_alignment(spark.createDataFrame([(k, list(map(float, x))) for k, x in enumerate(w)], "k long, w array<double>"), "w", []).collect()}
    assert got[0] == (list(map(float, w[0])), 0) and got[2] == ([0, 0, -6, 2, 0], -1)


def blobs(spark, n=150):
    rng = np.random.default_rng(8)
    rows = [(k, int(k % 2), (rng.standard_normal(3) + 8 * (k % 2)).tolist()) for k in range(2 * n)]
    return spark.createDataFrame(rows, "id long, c int, x array<double>")


def test_clusters_and_quality(spark):
    df = blobs(spark)
    got = sorting.mixture(df, "x", [2, 3])
    assert {r.n for r in got.groupBy("cluster").agg(F.countDistinct("c").alias("n")).collect()} == {1}
    o = sorting.gaussian_overlap(df, "x", "c").collect()
    assert len(o) == 2 and all(r.false_positive < 1e-6 for r in o)
    q = sorting.nearest_quality(df, "id", "x", "c").collect()
    assert len(q) == 2 and all(r.false_positive == 0 and r.false_negative == 0 for r in q)
    far = df.unionByName(spark.createDataFrame([(999, 0, [60.0, -60.0, 0.0])], df.schema))
    assert sorting.without_outliers(far, "x", "c").where("id = 999").count() == 0
    d = {r.id: r.distance for r in sorting.mahalanobis(df, "x", "c").collect()}
    x = np.array([r.x for r in df.where("c = 0").orderBy("id").collect()])
    want = np.einsum("ij,jk,ik->i", x - x.mean(0), np.linalg.inv(np.cov(x.T)), x - x.mean(0))
    assert np.allclose([d[k] for k in range(0, 300, 2)], want)


def test_nearest_quality_covers_all_rows(spark):
    """A large cluster beside a small one, more rows than a block and than the old sample of 2000 a cluster."""
    rng = np.random.default_rng(11)
    c = np.r_[np.zeros(4500, int), np.ones(300, int)]
    x = rng.standard_normal((len(c), 3)) + 1.0 * c[:, None]
    x[10] = x[11]  # a pair of equals
    df = spark.createDataFrame([(k, int(j), v.tolist()) for k, (j, v) in enumerate(zip(c, x))], "id long, c int, x array<double>")
    share = np.zeros((2, 2))
    for i in range(len(c)):
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        near = np.lexsort((np.arange(len(c)), d))[:10]
        share[c[i]] += np.bincount(c[near], minlength=2) / 10
    want = {0: (share[0, 1] / 4500, share[1, 0] / 4500), 1: (share[1, 0] / 300, share[0, 1] / 300)}
    for block in (1500, 10_000):
        got = {r.cluster: (r.false_positive, r.false_negative) for r in sorting.nearest_quality(df, "id", "x", "c", block=block).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[j], want[j], atol=1e-9) for j in want)


def test_principal_axes_and_scores(spark):
    """Against the singular values of the whole matrix; a null array has no scores, and equal rows are no harm."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 5)) @ np.diag([5, 3, 2, 1, 0]) + 100
    x[7] = x[8]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(-1, None)], "id long, x array<double>").repartition(3)
    got = {r.id: r.scores for r in waveforms.principal_scores(df, "x", 3).collect()}
    u, s, axes = np.linalg.svd(x - x.mean(0), full_matrices=False)
    signs = [np.sign(a[np.abs(a).argmax()]) for a in axes[:3]]
    assert got.pop(-1) is None
    assert np.allclose([got[k] for k in range(200)], (u * s)[:, :3] * signs, atol=1e-8)
    v = waveforms.explained_variance(df, "x").orderBy("k").collect()
    assert np.allclose([r.variance for r in v], s**2 / 199, atol=1e-8) and abs(sum(r.share for r in v) - 1) < 1e-12
    one = waveforms.principal_scores(df.where("id = 3"), "x", 2).collect()
    assert one[0].scores == [0.0, 0.0]
    assert waveforms.principal_scores(df.where("id = 999"), "x", 2).collect() == []


def test_unit_measures(spark):
    df = spark.createDataFrame([("a", t) for t in (0.0, 1.0, 10.0, 20.0, 30.0)], "u string, t double")
    r = sorting.refractory_share(df, "t", ["u"], 1.0).first()
    assert r.percent == 20 and not r.single
    heights = spark.createDataFrame([("a", float(v)) for v in np.random.default_rng(9).normal(5, 1, 4000)], "u string, h double")
    assert abs(sorting.missed_share(heights, "h", ["u"], 4.0).first().missed - 0.1587) < 0.03
    two = spark.createDataFrame([("c", "a", 1.0)] * 10 + [("c", "b", 1.0)] * 30, "ch string, u string, t double")
    got = {r.u: r.censored for r in sorting.censored_share(two, "t", ["ch", "u"], 0.001, 1.0).collect()}
    assert abs(got["a"] - 0.03) < 1e-12 and abs(got["b"] - 0.01) < 1e-12


def test_rank_sum(spark):
    a, b = [1.0, 2.0, 2.0, 5.0], [2.0, 6.0, 7.0]
    df = spark.createDataFrame([("a", v) for v in a] + [("b", v) for v in b], "g string, v double")
    w = 1 + 3 + 3 + 5
    assert abs(sorting.rank_sum(df, "v", "g", []).first().z - (w - 4 * 8 / 2) / math.sqrt(4 * 3 * 8 / 12)) < 1e-9


def test_rank_sum_in_chunks(spark, monkeypatch):
    """Values of all groups are read once, in chunks: no window holds a pair's values."""
    monkeypatch.setattr(sorting, "RANKED", 7)
    rng = np.random.default_rng(6)
    rows = [(k, g, float(v)) for k in "xy" for g, n in (("a", 40), ("b", 55), ("c", 3), ("d", 1)) for v in rng.integers(0, 30, n)] + [("x", "e", 500.0)] * 3
    rows += [("x", None, 1.0), (None, "a", 1.0), ("x", "a", None)]
    df = spark.createDataFrame(rows, "k string, g string, v double").repartition(5)
    got = {(r.k, r.a, r.b): r.z for r in sorting.rank_sum(df, "v", "g", ["k"]).collect()}
    want = {}
    for k in "xy":
        of = {}
        for key, g, v in rows:
            if key == k and g and v is not None:
                of.setdefault(g, []).append(v)
        for a in of:
            for b in of:
                if a < b:
                    n, m = len(of[a]), len(of[b])
                    u = sum((x > y) + (x == y) / 2 for x in of[a] for y in of[b])
                    want[k, a, b] = (u - n * m / 2) / math.sqrt(n * m * (n + m + 1) / 12)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    plan = sorting.rank_sum(df, "v", "g", ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "ORDER BY v" not in plan and " v#" not in "".join(x for x in plan.splitlines() if "Window" in x)


def test_neighbours_move_rows_a_bounded_number_of_times(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=3).astype(np.float32).tolist(), int(rng.integers(3))) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, x array<float>, c int")
    want = {r.c: r[1:] for r in df.sparkSession.createDataFrame(sorting.nearest_quality(df, "id", "x", "c", block=200).collect(), "c int, p double, q double").collect()}
    monkeypatch.setattr(sorting, "NEIGHBOUR_LEAST", 10)
    monkeypatch.setattr(sorting, "NEIGHBOUR_BLOCKS", 3)
    out = sorting.nearest_quality(df, "id", "x", "c")
    assert "sequence(0, 2" in str(out._jdf.queryExecution().analyzed()) or "cast(2 as bigint)" in str(out._jdf.queryExecution().analyzed())
    got = {r[0]: r[1:] for r in out.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[c], want[c]) for c in got)


def test_refractory_is_greedy(spark):
    df = spark.createDataFrame([("a", t) for t in (0, 1, 2, 3, 10, 11, 20)] + [("b", 5)], "c string, t long")
    got = sorted((r.c, r.t) for r in waveforms.keep_after_refractory(df, "t", ["c"], 1).collect())
    assert got == [("a", 0), ("a", 2), ("a", 10), ("a", 20), ("b", 5)]


def test_formula(spark):
    df = spark.createDataFrame([(3.0, -4.0)], "p double, q double")
    one = lambda t: df.select(maps.formula(t, {"a": "p", "b": "q"}).alias("v")).first().v
    assert one("a * 2 - -b") == 2 and one("sqrt(a ** 2 + b ** 2)") == 5 and one("max(a, b) > 2") and one("a / 0") is None
    for bad in ("__import__('os')", "a.b", "c", "a if b else a", "a[0]"):
        with pytest.raises(ValueError):
            maps.formula(bad, {"a": "p", "b": "q"})


def test_clusters_of_points(spark):
    points = [(0, 0, 0, 5.0), (1, 0, 0, 6.0), (2, 0, 0, 7.0), (3, 1, 0, 7.0), (9, 9, 9, 4.0), (5, 5, 5, 1.0)]
    df = spark.createDataFrame(points, "x int, y int, z int, v double")
    for corners, sizes in ((1, [1, 1, 3]), (2, [1, 4])):
        t = maps.cluster_table(maps.clusters(df, "v", 3.0, ["x", "y", "z"], corners), "v", ["x", "y", "z"]).collect()
        assert sorted(r["size"] for r in t) == sizes
    big = max(t, key=lambda r: r["size"])
    assert big.peak == 7 and tuple(big.peak_at) == (2, 0, 0) and big["mean"] == 6.25
    assert maps.clusters(df, "v", 99.0, ["x", "y", "z"]).count() == 0


def test_regions_and_density(spark):
    s = maps.sphere(spark.createDataFrame([("r", 0, 0, 0)], "region string, x int, y int, z int"), ["x", "y", "z"], "region", 1.0)
    assert s.count() == 7 and s.orderBy("distance").first().distance == 0
    foci = spark.createDataFrame([("s1", 0, 0, 0), ("s1", 1, 0, 0), ("s2", 5, 5, 5)], "n string, x int, y int, z int")
    assert maps.kernel_density(foci, ["x", "y", "z"], "n", 1.0).agg(F.max("share")).first()[0] == 0.5
    df = spark.createDataFrame([("a", 1, 0, 0, 2.0), ("a", 0, 0, 0, 4.0), ("a", 9, 9, 9, 50.0)], "c string, x int, y int, z int, v double")
    r = maps.region_means(df, s, ["x", "y", "z"], "region", ["c"], "v").first()
    assert (r["mean"], r.n) == (3.0, 2)
    moved = df.limit(1).select(*maps.affine(["x", "y", "z"], [[2, 0, 0, 1], [0, 1, 0, 0], [0, 0, 1, -1]])).first()
    assert tuple(moved) == (3.0, 0.0, -1.0)
    p = spark.createDataFrame([("g", c, k, float(k if c == "a" else -k)) for c in "ab" for k in range(5)], "g string, c string, p int, v double")
    assert abs(maps.pattern_similarity(p, "c", ["p"], "v", ["g"]).first().r + 1) < 1e-12
