"""Distributions, signals and spectra against closed forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import distributions as dist
from tidemark.operators import signals, spectral
from tidemark.operators.spectral import Taper


def near(a, b, tol=1e-8):
    assert np.allclose(a, b, rtol=tol, atol=tol), (a, b)


def test_distributions_at_known_points():
    near(dist.norm_cdf(np.array([0.0, 1.959963984540054])), [0.5, 0.975])
    near(dist.t_cdf(np.array([2.2281388519649385, -1.0, 0.0]), np.array([10.0, 1.0, 5.0])), [0.975, 0.25, 0.5])
    near(dist.chi2_cdf(np.array([3.841458820694124, 18.307038053275146]), np.array([1.0, 10.0])), [0.95, 0.95])
    near(dist.f_cdf(np.array([4.964602743730711]), np.array([1.0]), np.array([10.0])), [0.95], 1e-7)
    near(dist.gamma_cdf(np.array([1.0, 2.0]), np.array([1.0, 1.0])), [1 - math.exp(-1), 1 - math.exp(-2)])
    near(dist.beta_cdf(np.array([0.25, 0.5]), np.array([1.0, 2.0]), np.array([2.0, 2.0])), [1 - 0.75**2, 0.5])
    near(dist.digamma(np.array([1.0, 0.5])), [-0.5772156649015329, -1.9635100260214235])
    near(dist.trigamma(np.array([1.0, 0.5])), [math.pi**2 / 6, math.pi**2 / 2])
    near(dist.gamma_pdf(np.array([2.0, -1.0]), 3.0), [2 * math.exp(-2), 0.0])


def test_quantiles_invert():
    p = np.array([0.001, 0.025, 0.5, 0.9, 0.999])
    near(dist.norm_cdf(dist.norm_inv(p)), p)
    for dof in (1.0, 4.0, 30.0):
        near(dist.t_cdf(dist.t_inv(p, dof), dof), p)
        near(dist.chi2_cdf(dist.chi2_inv(p, dof), dof), p)
        near(dist.f_cdf(dist.f_inv(p, dof, 7.0), dof, 7.0), p)


def test_columns_take_nulls(spark):
    df = spark.createDataFrame([(1.96, 10.0), (None, 3.0), (float("nan"), 3.0), (0.0, -1.0)], "t double, dof double")
    got = df.select(dist.normal_p("t").alias("z"), dist.student_p("t", "dof").alias("p"), dist.signed_p(F.col("t"), "z").alias("s")).collect()
    assert abs(got[0].z - 0.9750021) < 1e-6 and got[1].z is None and got[2].p is None and got[3].p is None
    assert abs(got[0].s - 0.04999579) < 1e-6


FS = 1000.0
T = np.arange(4000) / FS


def sine(f, a=1.0):
    return a * np.sin(2 * np.pi * f * T)


def arrays(spark, *xs):
    return spark.createDataFrame([(k, x.tolist() if x is not None else None) for k, x in enumerate(xs)], "k long, x array<double>")


def column(spark, c, *xs):
    return [r.y for r in arrays(spark, *xs).select("k", c.alias("y")).orderBy("k").collect()]


def test_filters_keep_and_stop(spark):
    mid = slice(500, 3500)
    for c, keep, stop in ((signals.low_pass("x", FS, 40), 5, 200), (signals.high_pass("x", FS, 40), 200, 5), (signals.band_pass("x", FS, 20, 80), 40, 200), (signals.band_stop("x", FS, 45, 55), 20, 50)):
        got = np.array(column(spark, c, sine(keep) + sine(stop))[0])
        assert np.abs(got - sine(keep))[mid].max() < 0.08


def test_gain_is_half_at_the_corner():
    for low, high in ((None, 40.0), (40.0, None), (40.0, 90.0)):
        for f in (low, high):
            if f:
                assert abs(signals.gain(np.array([f]), FS, 4, low, high)[0] - 0.5) < 1e-9
    assert signals.gain(np.array([50.0]), FS, 2, 49, 51, stop=True)[0] < 1e-3


def test_null_empty_and_short(spark):
    got = column(spark, signals.low_pass("x", FS, 40), None, np.array([]), np.array([3.0]), np.array([1.0, 2.0]))
    assert got[0] is None and got[1] == [] and abs(got[2][0] - 3) < 1e-9 and len(got[3]) == 2


def test_resampling_and_field(spark):
    got = np.array(column(spark, signals.resample("x", FS, 250.0), sine(3))[0])
    assert len(got) == 1000 and np.abs(got - sine(3)[::4]).max() < 1e-6
    got = np.array(column(spark, signals.decimate("x", FS, 4), sine(3) + sine(400))[0])
    assert np.abs(got - sine(3)[::4])[100:-100].max() < 0.02
    field = np.array(column(spark, signals.field_potential("x", FS), sine(10) + sine(50))[0])
    assert np.abs(field - sine(10)[::2])[300:-300].max() < 0.05
    loud = np.array(column(spark, signals.activity_envelope("x", 20_000.0), np.r_[np.zeros(8000), np.sin(2 * np.pi * 1000 * np.arange(8000) / 20_000)])[0])
    assert loud[: len(loud) // 2 - 20].max() < 0.1 and loud[len(loud) // 2 + 20 : -20].min() > 0.4


def test_smoothing_bridging_and_chunks(spark):
    x = np.arange(10.0)
    assert np.allclose(column(spark, signals.smooth("x", 3), x)[0], np.convolve(np.r_[0, x, 9], np.ones(3) / 3, "valid"))
    df = spark.createDataFrame([(x.tolist(), [(2, 5), (8, 12)])], "x array<double>, s array<struct<start:int,end:int>>")
    assert signals.bridge(df, "x", "s").first().x == [0, 1, 2, 3, 4, 5, 6, 7, 7, 7]
    long = spark.createDataFrame([("a", k, float(k)) for k in range(25)], "c string, i long, v double")
    chunks = signals.to_chunks(long, ["c"], "i", "v", 10)
    wide = signals.with_context(chunks, ["c"], "chunk", "samples", 3)
    assert [len(r.samples) for r in wide.orderBy("chunk").collect()] == [13, 16, 8]
    back = signals.to_samples(signals.without_context(wide, "samples"), "samples", "c", "chunk")
    assert sorted(r.v for r in back.collect()) == list(range(25))


def test_local_fit_takes_out_slow_parts():
    x = 0.5 * (T - 2) ** 3 + 1.0
    spike = np.zeros(4000)
    spike[2000] = 5
    got = signals.local_fit(x + spike, 30)
    assert np.abs(got[100:1900]).max() < 1e-6 and got[2000] > 4
    y = x + spike
    y[1000:1020] = 50.0
    got = signals.local_fit(y, 30, rail=50.0)
    assert (got[995:1025] == 0).all() and np.abs(got[1100:1900]).max() < 1e-6


def test_shared_components_go(spark):
    rng = np.random.default_rng(1)
    shared = rng.standard_normal(300)
    own = rng.standard_normal((6, 300)) * 0.01
    df = spark.createDataFrame([(1, c, (shared * (c + 1) + own[c]).tolist()) for c in range(6)], "trial long, ch long, x array<double>")
    got = {r.ch: np.array(r.x) for r in signals.remove_shared_components(df, ["trial"], "ch", "x", k=1, band=0).collect()}
    assert all(np.abs(v).std() < 0.05 for v in got.values())


def test_tapers_are_orthonormal():
    h = spectral.slepian(128, 3.0, 5)
    assert np.allclose(h.T @ h, np.eye(5), atol=1e-10)
    assert all(h[:, k].sum() > 0 for k in (0, 2, 4)) and all(h[1, k] > h[0, k] or h[1, k] > 0 for k in (1, 3))
    f = np.fft.rfft(h[:, 0], 1 << 14)
    inside = (np.abs(f[: int((1 << 14) * 3 / 128)]) ** 2).sum() / (np.abs(f) ** 2).sum()
    assert inside > 0.999


def test_spectrum_of_noise_and_sine(spark):
    rng = np.random.default_rng(2)
    p = Taper(fs=FS, low=5, high=400)
    noise = [rng.standard_normal(1024) for _ in range(60)]
    got = spectral.spectrum(arrays(spark, *noise).selectExpr("'a' as c", "x"), ["c"], "x", p).collect()
    s = np.array([r.s for r in got])
    assert abs(s.mean() * FS - 1) < 0.05  # a flat density: variance over the rate
    inside = [r.low <= 1 / FS <= r.high for r in got]
    assert np.mean(inside) > 0.85 and got[0].trials == 60
    line = spectral.spectrum(arrays(spark, sine(60)[:1024]).selectExpr("'a' as c", "x"), ["c"], "x", p, level=None).collect()
    assert abs(max(line, key=lambda r: r.s).f - 60) < 4
    jack = spectral.jackknife_spectrum(arrays(spark, *noise).selectExpr("'a' as c", "x"), ["c"], "x", p).collect()
    assert np.mean([r.low <= 1 / FS <= r.high for r in jack]) > 0.85


def test_coherence(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(20):
        common = rng.standard_normal(512)
        rows.append(("same", common.tolist(), (common + 0.1 * rng.standard_normal(512)).tolist()))
        rows.append(("other", common.tolist(), rng.standard_normal(512).tolist()))
    df = spark.createDataFrame(rows, "g string, x array<double>, y array<double>")
    got = spectral.coherence(df, ["g"], "x", "y", Taper(fs=FS)).collect()
    assert min(r.c for r in got if r.g == "same") > 0.95
    assert np.mean([r.c > r.limit for r in got if r.g == "other"]) < 0.15
    limit = got[0].limit
    assert abs(limit - math.sqrt(1 - 0.05 ** (1 / (20 * 5 - 1)))) < 1e-9 and abs(limit - spectral.coherence_quantile(0.05, 200)) < 1e-6


def test_lines_are_found_and_removed(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal(1000) + 3 * sine(50)[:1000]
    p = Taper(fs=FS, pad=2)
    got = spectral.line_test(arrays(spark, x), ["k"], "x", p).collect()
    best = max(got, key=lambda r: r.ratio)
    assert abs(best.f - 50) < 1 and best.ratio > best.limit and abs(best.amplitude - 3) < 0.3
    clean = np.array(column(spark, spectral.remove_line("x", p, 50.0), x)[0])
    assert np.abs(np.fft.rfft(clean))[50] < 0.2 * np.abs(np.fft.rfft(x))[50]


def test_windows_and_spectrogram(spark):
    x = np.r_[sine(50)[:1000], sine(150)[:1000]]
    got = spectral.spectrogram(arrays(spark, x), ["k"], "x", Taper(fs=FS), 0.5, 0.25).collect()
    times = sorted({r.t for r in got})
    assert len(times) == 7
    peak = lambda t: max((r for r in got if r.t == t), key=lambda r: r.s).f
    assert abs(peak(times[0]) - 50) < 6 and abs(peak(times[-1]) - 150) < 6
    assert spectral.spectrogram(arrays(spark, np.zeros(3)), ["k"], "x", Taper(fs=FS), 0.5, 0.25).count() == 0


def test_point_spectrum(spark):
    rng = np.random.default_rng(5)
    rows = [(1, sorted((rng.uniform(0, 2, rng.poisson(100))).tolist())) for _ in range(40)]
    got = spectral.point_spectrum(spark.createDataFrame(rows, "k long, t array<double>"), ["k"], "t", 0.0, 2.0, Taper(fs=200.0, low=5)).collect()
    assert abs(np.mean([r.s for r in got]) / 50 - 1) < 0.1  # a Poisson train has a flat spectrum at its rate


def test_two_groups(spark):
    a = spark.createDataFrame([(1, 5.0, 1.0, 20), (1, 6.0, 4.0, 20)], "k long, f double, s double, trials long")
    b = spark.createDataFrame([(1, 5.0, 1.0, 20), (1, 6.0, 1.0, 20)], "k long, f double, s double, trials long")
    got = {r.f: r.z for r in spectral.two_group_spectrum(a, b, ["k"], 5).collect()}
    assert abs(got[5.0]) < 1e-9 and abs(got[6.0] - math.log(4) / math.sqrt(2 * dist.trigamma(np.array([100.0]))[0])) < 1e-9


@pytest.mark.parametrize("w,t,p,k", [(5, 0.5, 1, 4), (10, 1.0, 1, 19)])
def test_tapers_of_a_bandwidth(w, t, p, k):
    assert Taper.of_bandwidth(1000.0, w, t, p).k == k
