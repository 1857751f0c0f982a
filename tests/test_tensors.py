"""Pulse artifacts: each step equals principal components and least squares over the whole matrix."""

import numpy as np
import pytest

from tidemark.operators import tensors
from tidemark.plans import numeric


def regressed(m, k, band, after=False):
    """Columns of m (rows by members) less their regression on components of the members outside the band."""
    m = m - m.mean(0)
    out = np.zeros_like(m)
    whole = np.linalg.svd(m, full_matrices=False)[2][:k].T
    for n in range(m.shape[1]):
        out_of = [j for j in range(m.shape[1]) if j in range(n - (band - 1) // 2, n + band // 2 + 1)]
        if after:
            part = whole.copy()
            part[out_of] = 0
            parts = m @ part
        else:
            rest = np.delete(m, out_of, axis=1)
            u, s, _ = np.linalg.svd(rest, full_matrices=False)
            parts = (u * s)[:, : min(k, rest.shape[1])]
        out[:, n] = m[:, n] - parts @ np.linalg.lstsq(parts, m[:, n], rcond=None)[0]
    return out


def brute(x, channels, pulses, trials, band, each, after=False):
    """x is (trial, pulse, channel, sample)."""
    r, p, c, t = x.shape
    x = x - x.mean(3, keepdims=True)
    if channels and each:
        x = np.stack([regressed(v.transpose(0, 2, 1).reshape(p * t, c), channels, band[0], after).reshape(p, t, c).transpose(0, 2, 1) for v in x])
    elif channels:
        x = regressed(x.transpose(0, 1, 3, 2).reshape(-1, c), channels, band[0], after).reshape(r, p, t, c).transpose(0, 1, 3, 2)
    if pulses:
        x = regressed(x.transpose(0, 2, 3, 1).reshape(-1, p), pulses, band[1], after).reshape(r, c, t, p).transpose(0, 3, 1, 2)
    if trials:
        x = regressed(x.transpose(1, 2, 3, 0).reshape(-1, r), trials, band[2], after).reshape(p, c, t, r).transpose(3, 0, 1, 2)
    return x


def tensor(r=5, p=4, c=6, t=12, seed=1):
    rng = np.random.default_rng(seed)
    shape = rng.normal(size=(2, t)) * 50
    return rng.normal(size=(r, p, c, t)) + np.einsum("rp,ct->rpct", 1 + 0.1 * rng.normal(size=(r, p)), rng.normal(size=(c, 2)) @ shape)


def frame(spark, x):
    return spark.createDataFrame([(f"t{i}", j, k, x[i, j, k].tolist()) for i in range(x.shape[0]) for j in range(x.shape[1]) for k in range(x.shape[2])], "tr string, pu int, ch long, v array<double>")


def array(rows, shape):
    out = np.full(shape, np.nan)
    for r in rows:
        out[int(r.trial[1:]), r.pulse, r.channel] = r.samples
    return out


@pytest.mark.parametrize("band,each,after", [((1, 1, 1), True, False), ((3, 2, 1), False, False), ((2, 1, 2), True, True)])
def test_steps_equal_the_whole_matrix(spark, band, each, after):
    x = tensor()
    df = frame(spark, x).repartition(5).withColumnRenamed("v", "samples")
    got = tensors.clean_pulses(df, "tr", "pu", "ch", "samples", 2, 1, 1, band, each, after)
    want = brute(x, 2, 1, 1, band, each, after)
    assert np.allclose(array(got.collect(), x.shape), want, atol=1e-8)
    assert after or np.abs(want).max() < np.abs(x).max() / 5


def test_missing_segments_nulls_and_empty(spark):
    x = tensor(3, 3, 4, 6)
    df = frame(spark, x).where("not (tr = 't1' and pu = 2 and ch = 3)")
    nulls = spark.createDataFrame([(None, 1, 1, [1.0] * 6), ("t9", 0, 0, None)], df.schema)
    got = tensors.clean_pulses(df.unionByName(nulls), "tr", "pu", "ch", "v", 1, 0, 0).collect()
    filled = x.copy()
    filled[1, 2, 3] = 0
    want = brute(filled, 1, 0, 0, (1, 1, 1), True)
    want[1, 2, 3] = np.nan
    assert len(got) == 35 and np.allclose(array(got, x.shape), want, atol=1e-8, equal_nan=True)
    assert tensors.clean_pulses(df.where("false"), "tr", "pu", "ch", "v").collect() == []


def test_trains_into_pulses_and_back(spark):
    x = np.arange(2 * 23, dtype=float).reshape(2, 23)
    df = spark.createDataFrame([(i, 7, v.tolist()) for i, v in enumerate(x)] + [(5, 7, [1.0])], "trial int, channel int, v array<double>")
    cut = tensors.into_pulses(df, "v", 2, 5, 4)
    assert {(r.trial, r.pulse): r.v for r in cut.collect()} == {(i, p): x[i, 2 + 5 * p : 7 + 5 * p].tolist() for i in range(2) for p in range(4)}
    clean = cut.select("trial", "pulse", "channel", "v").selectExpr("trial", "pulse", "channel", "transform(v, x -> -x) samples").where("not (trial = 1 and pulse = 0)")
    back = {r.trial: r.v for r in tensors.from_pulses(df, clean, "trial", "channel", "v", 2, 5, 4).collect()}
    want = x[0].copy()
    want[2:22] *= -1
    assert back == {0: want.tolist(), 1: x[1].tolist(), 5: [1.0]}


def test_query_equals_the_whole_matrix(spark, data):
    rows = numeric.daily_segments(spark, f"{data}/sf0.001").collect()
    banks, days, kinds = (sorted({r[k] for r in rows}) for k in ("bank", "day", "event_type"))
    x = np.zeros((len(banks), len(days), len(kinds), 24))
    there = np.zeros(x.shape[:3], bool)
    for r in rows:
        at = banks.index(r.bank), days.index(r.day), kinds.index(r.event_type)
        x[at], there[at] = r.samples, True
    got = np.zeros(x.shape)
    seen = np.zeros(there.shape, bool)
    for r in numeric.QUERIES["pulse_artifacts"](spark, f"{data}/sf0.001").collect():
        at = banks.index(r.trial), days.index(r.pulse), kinds.index(r.channel)
        got[at], seen[at] = r.samples, True
    # a missing segment counts as zeros in each step
    want = x - x.mean(3, keepdims=True)
    for step in ((2, 0, 0), (0, 2, 0), (0, 0, 2)):
        want = np.where(there[..., None], brute(want, *step, (1, 1, 1), True), 0)
    assert (seen == there).all() and np.allclose(got, want, atol=1e-6)
