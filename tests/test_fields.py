"""Averages of fields, lines, votes and coherence against numpy; jittered trains by their properties."""

import math

import numpy as np
import pytest

from tidemark.operators import bins, fields, spectral, stats, waveforms, windows
from tidemark.operators.spectral import Taper


def test_spike_triggered_average_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = {c: rng.normal(size=60) for c in "ab"}
    field = spark.createDataFrame([(c, i, float(v)) for c in x for i, v in enumerate(x[c])], "c string, i long, v double")
    at = [(c, float(t)) for c in "ab" for t in [*rng.uniform(-2, 62, 40), 5.0, 0.0, 59.0, 4.0, 55.0]]
    spikes = spark.createDataFrame(at, "c string, t double")
    got = {r.lag: r for r in fields.spike_triggered_average(spikes, field, ["c"], "t", "i", "v", -4, 4).collect()}
    for lag in range(-4, 5):
        v = [np.interp(t + lag, np.arange(60), x[c]) for c, t in at if t - 4 >= 0 and t + 4 <= 59]
        assert got[lag].n == len(v) and abs(got[lag]["mean"] - np.mean(v)) < 1e-9 and abs(got[lag].sem - np.std(v, ddof=1) / math.sqrt(len(v))) < 1e-9
    assert fields.spike_triggered_average(spikes.limit(0), field, ["c"], "t", "i", "v", -4, 4).count() == 0


@pytest.mark.parametrize("n,length,step", [(100, 24, 6), (50, 10, 10), (47, 12, 5), (30, 28, 3)])
def test_running_line_against_numpy(spark, n, length, step):
    y = np.random.default_rng(n).normal(size=n) + np.arange(n) / 9
    line, weight = np.zeros(n), np.zeros(n)
    j = np.arange(1, length + 1)
    tricube = (1 - np.abs((j - length / 2) / (length / 2)) ** 3) ** 3
    starts = range(0, (math.ceil((n - length) / step) - 1) * step + 1, step)
    for s in starts:
        a, b = np.polyfit(j, y[s : s + length], 1)
        line[s : s + length] += tricube * (a * j + b)
        weight[s : s + length] += tricube
    want = np.divide(line, weight, out=np.zeros(n), where=weight > 0)
    tail = starts[-1] + length - 1
    want[tail:] = a * (np.arange(tail, n) - starts[-1] + 1) + b
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(y)], "k string, i long, v double")
    got = [r.line for r in windows.running_line(df, "v", ["k"], "i", length, step).orderBy("i").collect()]
    assert np.allclose(got, want, atol=1e-9)


def test_votes_within_a_distance(spark):
    rows = [(1, [0.0, 0.0], "a"), (2, [0.1, 0.0], "a"), (3, [0.0, 0.2], "b"), (4, [5.0, 5.0], "b"), (5, None, "b"), (6, [0.0, 0.1], None)]
    df = spark.createDataFrame(rows, "id long, x array<double>, label string")
    got = {r.id: (r.label, r.votes) for r in waveforms.knn_vote(df, df, "id", "x", "label", 2, most=1.0).collect()}
    # ties go to the least label; a row too far from all has no votes; rows without features or label don't count
    assert got == {1: ("a", 1), 2: ("a", 1), 3: ("a", 2), 6: ("a", 1)}
    many = waveforms.knn_vote(df, df, "id", "x", "label", 2, most=1.0, block=1)
    assert {r.id: (r.label, r.votes) for r in many.collect()} == got


def test_jittered_trains(spark):
    df = spark.createDataFrame([("a", t) for t in range(0, 1000, 7)], "c string, t long")
    out = bins.jittered(df, "t", ["c"], 50, 20)
    rows = out.collect()
    assert len(rows) == 20 * df.count() and sorted(map(tuple, rows)) == sorted(map(tuple, bins.jittered(df.repartition(3), "t", ["c"], 50, 20).collect()))
    count = lambda ts: np.bincount(np.array(ts) // 50, minlength=20).tolist()
    own = count([r.t for r in df.collect()])
    assert all(count([r.t for r in rows if r["round"] == k]) == own for k in (1, 7, 20))
    band = bins.correlogram_band(df, df, "t", ["c"], 20, 5, 50, rounds=20)
    for r in band.collect():
        assert r.low <= r.high
    peak = {r.lag: r for r in band.collect()}[0]
    assert peak.n == df.count() and peak.n > peak.high  # each event meets itself, jittered ones don't


def test_coherence_matrix_and_interval(spark):
    rng, p = np.random.default_rng(3), Taper(fs=1.0, tw=3.0, k=5)
    trials = []
    for t in range(6):
        a = rng.normal(size=64)
        trials += [("g", t, "x", a.tolist()), ("g", t, "y", (a + rng.normal(size=64)).tolist()), ("g", t, "z", rng.normal(size=64).tolist())]
    df = spark.createDataFrame(trials, "g string, trial int, ch string, v array<double>")
    got = {(r.a, r.b, round(r.f, 6)): r for r in spectral.coherence_matrix(df, ["g"], "trial", "ch", "v", p).collect()}
    assert {k[:2] for k in got} == {("x", "y"), ("x", "z"), ("y", "z")}
    for a, b in (("x", "y"), ("y", "z")):
        pair = df.where(f"ch = '{a}'").select("g", "trial", "v").join(df.where(f"ch = '{b}'").select("trial", df.v.alias("w")), "trial")
        for r in spectral.coherence(pair, ["g"], "v", "w", p).collect():
            m = got[(a, b, round(r.f, 6))]
            assert abs(m.c - r.c) < 1e-9 and abs(m.phase - r.phase) < 1e-6 and m.trials == 6
    pair = df.where("ch = 'x'").select("g", "trial", "v").join(df.where("ch = 'y'").select("trial", df.v.alias("w")), "trial")
    j = np.concatenate([spectral.transforms(np.array(r.v), p) for r in pair.orderBy("trial").collect()], axis=1)
    k = np.concatenate([spectral.transforms(np.array(r.w), p) for r in pair.orderBy("trial").collect()], axis=1)
    n = j.shape[1]
    c = lambda u, v: np.abs((u.conj() * v).sum(1)) / np.sqrt((np.abs(u) ** 2).sum(1) * (np.abs(v) ** 2).sum(1))
    left = np.stack([np.sqrt(2 * n - 2) * np.arctanh(c(np.delete(j, i, 1), np.delete(k, i, 1))) for i in range(n)])
    for r, mid, sd in zip(spectral.jackknife_coherence(pair, ["g"], "v", "w", p).orderBy("f").collect(), c(j, k), np.sqrt(n - 1) * left.std(0)):
        z, t = np.sqrt(2 * n - 2) * np.arctanh(mid), 2.0010  # 59 degrees of freedom
        assert abs(r.c - mid) < 1e-9
        assert abs(r.low - max(0, np.tanh((z - t * sd) / np.sqrt(2 * n - 2)))) < 1e-4 and abs(r.high - np.tanh((z + t * sd) / np.sqrt(2 * n - 2))) < 1e-4


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_sums_and_ranks_over_ranges(spark, monkeypatch, most):
    """Keys with too many rows for a task are cut into ranges; nulls are a key."""
    monkeypatch.setattr(stats, "WINDOW_ROWS", most)
    rng = np.random.default_rng(2)
    rows = [(k, i, int(v)) for k in ("a", "b", None) for i, v in enumerate(rng.integers(0, 9, 300))]
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(5)
    got = {(r.k, r.i): r.s for r in stats.running_sum(df, ["k"], "i", "v", "s").collect()}
    want = {}
    for k, i, v in rows:
        want[(k, i)] = want.get((k, i - 1), 0) + v
    assert got == want
    assert {r.i: r.s for r in stats.running_sum(df.where("k = 'a'").drop("k"), [], "i", "v", "s").collect()} == {i: s for (k, i), s in want.items() if k == "a"}
    p = np.sort(rng.random(500) ** 3)
    ps = spark.createDataFrame([(float(x),) for x in p], "p double")
    best = max([x for i, x in enumerate(p) if x * 500 / (i + 1) <= 0.05], default=p[0] / 2.001)
    assert abs(stats.fdr(ps, "p", [], 0.05).first().threshold - best) < 1e-12
    y, x = rng.integers(0, 2, 400), rng.integers(0, 30, 400)
    roc = spark.createDataFrame([(int(a), int(b)) for a, b in zip(x, y)], "x long, y long")
    pairs = [(a > b) + 0.5 * (a == b) for a in x[y == 1] for b in x[y == 0]]
    assert abs(stats.roc_area(roc, "x", "y", []).first().area - np.mean(pairs)) < 1e-12
