"""Alignment against the sequential walk, repair by anchors, and trains drawn with their counts kept."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import alignment, bins


def walk(a, b):
    out, j = [], 0
    for t, c in a:
        hit = j < len(b) and c is not None and c == b[j][1]
        out.append((t, c, b[j][0] if hit else None))
        j += hit
    return out + [(None, c, t) for t, c in b[j:]]


def test_greedy_merge_is_the_walk(spark):
    rng = np.random.default_rng(1)
    a = {k: [(int(t), int(c)) for t, c in enumerate(rng.integers(0, 4, 60))] for k in "pqr"}
    b = {"p": [x for x in a["p"] if rng.random() < 0.7], "q": a["q"][:20] + [(25, 9)] + a["q"][30:], "s": [(1, 1), (2, 2)]}
    a["r"] = a["r"][:3] + [(3, None)] + a["r"][4:]
    b["r"] = [(0, a["r"][0][1]), (1, None), (2, 1)]
    frame = lambda d: spark.createDataFrame([(k, t, c) for k, rows in d.items() for t, c in rows], "k string, t long, code int").repartition(4)
    got = {}
    for r in alignment.greedy_merge(frame(a), frame(b), ["k"], "t", "code").collect():
        got.setdefault(r.k, []).append((r.t, r.code, r.other))
    for k in "pqrs":
        assert sorted(got[k], key=repr) == sorted(walk(a.get(k, []), b.get(k, [])), key=repr)


def test_repair_takes_the_last_shared_trial(spark):
    good = [("x", i, 100 * i, 100 * i + 50) for i in range(6)] + [("y", 0, 5, 6)]
    bad = [("x", 0, 1000, 1050), ("x", 1, 1101, 1151), ("x", 3, 1302, 1352), ("x", 4, 7, None), ("x", 9, 1, 2)]
    df = lambda rows: spark.createDataFrame(rows, "k string, trial int, begin long, stop long")
    got = {(r.k, r.trial): (r.begin, r.stop, r.repaired) for r in alignment.repaired_trials(df(bad), df(good), ["k"], "trial", "stop", ["begin", "stop"]).collect()}
    assert got == {("x", 0): (1000, 1050, False), ("x", 1): (1101, 1151, False), ("x", 2): (1202, 1252, True), ("x", 3): (1302, 1352, False), ("x", 4): (1402, 1452, True), ("x", 5): (1502, 1552, True), ("x", 9): (1, 2, False), ("y", 0): (None, None, True)}


def trains(spark, seed, trials=30, reach=200):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(int(k), int(t)) for k in range(trials) for t in rng.choice(reach, rng.integers(0, 40), replace=False)], "k long, t long")


def by_window(rows, window):
    out = {}
    for k, t in rows:
        out.setdefault((k, t // window), []).append(t)
    return {k: sorted(v) for k, v in out.items()}


def test_shifted_patterns_keep_intervals_and_windows(spark):
    df = trains(spark, 2)
    own = by_window([tuple(r) for r in df.collect()], 25)
    drawn = {}
    for r in bins.pattern_shifted(df, "t", ["k"], 25, 12, 3).collect():
        drawn.setdefault(r["round"], []).append((r.k, r.t))
    assert set(drawn) == set(range(1, 13))
    moved = Counter()
    for rows in drawn.values():
        got = by_window(rows, 25)
        assert got.keys() == own.keys()
        for k, v in own.items():
            assert len({a - b for a, b in zip(v, got[k])}) == 1
            moved[k] += got[k] != v
    assert sum(n > 0 for n in moved.values()) > 0.9 * sum(v[-1] - v[0] < 20 for v in own.values())


@pytest.mark.parametrize("most", [4096, 8])
def test_reassigned_trains_keep_both_counts(spark, monkeypatch, most):
    monkeypatch.setattr(bins, "TRIALS", most)
    df = trains(spark, 4)
    rows = [tuple(r) for r in df.collect()]
    of = lambda rows: (Counter((k, t // 25) for k, t in rows), Counter(t for _, t in rows))
    drawn = {}
    for r in bins.reassigned(df, "t", "k", 25, 6, 1).collect():
        drawn.setdefault(r["round"], []).append((r.k, r.t))
    assert len(drawn) == 6
    for got in drawn.values():
        assert of(got) == of(rows) and len(set(got)) == len(got) and set(got) != set(rows)
    again = {(r["round"], r.k, r.t) for r in bins.reassigned(df.repartition(7), "t", "k", 25, 6, 1).collect()}
    assert again == {(n, *x) for n, got in drawn.items() for x in got}
    assert drawn[1] != drawn[2]


def test_band_of_drawn_trains(spark):
    a, b = trains(spark, 5, 12, 80), trains(spark, 6, 12, 80)
    drawn = [bins.pattern_shifted(x, "t", ["k"], 20, 10, n).cache() for n, x in enumerate((a, b))]
    got = {r.lag: r for r in bins.resampled_band(a, b, *drawn, "t", ["k"], 5, 1, 10, 0.8).collect()}
    count = lambda x, y: Counter(s - t for k, s in x for m, t in y if k == m and abs(s - t) <= 5)
    own = count([tuple(r) for r in a.collect()], [tuple(r) for r in b.collect()])
    each = [count(*([(r.k, r.t) for r in d.where(F.col("round") == n).collect()] for d in drawn)) for n in range(1, 11)]
    for lag in range(-5, 6):
        values = sorted(c[lag] for c in each)
        assert (got[lag].n, got[lag].low, got[lag].high) == (own[lag], values[0], values[8]) and got[lag]["mean"] == pytest.approx(sum(values) / 10)


def test_reassigned_trains_of_many_trials(spark):
    """A window of 4000 trials is dealt 20,000 times in a few seconds."""
    rng = np.random.default_rng(2)
    rows = sorted({(int(k), int(t)) for k, t in zip(rng.integers(0, 4000, 12_000), rng.integers(0, 25, 12_000))})
    df = spark.createDataFrame(rows, "k long, t long")
    got = [(r.k, r.t) for r in bins.reassigned(df, "t", "k", 25, 1, 3).collect()]
    assert len(set(got)) == len(rows) and Counter(k for k, _ in got) == Counter(k for k, _ in rows) and Counter(t for _, t in got) == Counter(t for _, t in rows)
    assert sum(x not in set(rows) for x in got[:500]) > 100
