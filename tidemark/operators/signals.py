"""Sampled signals as one array of samples a row: filters, resampling, band envelopes and artifact removal.

A row is a chunk of a channel or a trial of it, so rows are the unit of work and nothing is collected per channel.
``with_context`` lends each chunk the neighbouring samples that a filter needs, ``without_context`` takes them off again.
Null arrays stay null; empty ones stay empty.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.batches import mapped


def gain(f: np.ndarray, fs: float, order: int, low: float | None, high: float | None, stop: bool = False) -> np.ndarray:
    """Squared magnitude of the digital Butterworth filter at f: low pass (no ``low``), high pass (no ``high``), band pass,
    or band stop. Frequencies are warped as by the bilinear transform."""
    w = np.tan(np.pi * np.clip(f, 0, fs / 2 * (1 - 1e-12)) / fs)
    a = None if low is None else np.tan(np.pi * low / fs)
    b = None if high is None else np.tan(np.pi * high / fs)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        if a is None:
            ratio = w / b
        elif b is None:
            ratio = a / w
        else:
            ratio = np.abs(w * w - a * b) / ((b - a) * w)
            ratio = 1 / ratio if stop else ratio
        return 1 / (1 + ratio ** (2 * order))


def zero_phase(x: np.ndarray, fs: float, order: int, low: float | None = None, high: float | None = None, stop: bool = False) -> np.ndarray:
    """Forward and backward filtering at once: the squared gain on the signal with both ends reflected about themselves."""
    n = len(x)
    edge = min(n - 1, int(3 * order * fs / min(v for v in (low, high) if v)))
    padded = np.concatenate([2 * x[0] - x[edge:0:-1], x, 2 * x[-1] - x[-2 : -edge - 2 : -1]]) if edge else x
    size = len(padded)
    return np.fft.irfft(np.fft.rfft(padded) * gain(np.fft.rfftfreq(size, 1 / fs), fs, order, low, high, stop), size)[edge : edge + n]


def low_pass(x: Column | str, fs: float, high: float, order: int = 4) -> Column:
    return mapped(lambda v: zero_phase(v, fs, order, high=high), x)


def high_pass(x: Column | str, fs: float, low: float, order: int = 4) -> Column:
    return mapped(lambda v: zero_phase(v, fs, order, low=low), x)


def band_pass(x: Column | str, fs: float, low: float, high: float, order: int = 4) -> Column:
    return mapped(lambda v: zero_phase(v, fs, order, low, high), x)


def band_stop(x: Column | str, fs: float, low: float, high: float, order: int = 2) -> Column:
    return mapped(lambda v: zero_phase(v, fs, order, low, high, stop=True), x)


def resampled(x: np.ndarray, fs: float, new: float) -> np.ndarray:
    """Linear interpolation at the new rate, from the first sample on."""
    n = int((len(x) - 1) * new / fs + 1e-9) + 1
    return np.interp(np.arange(n) / new, np.arange(len(x)) / fs, x)


def resample(x: Column | str, fs: float, new: float) -> Column:
    return mapped(lambda v: resampled(v, fs, new), x)


def decimate(x: Column | str, fs: float, by: int, order: int = 8) -> Column:
    """Every ``by``-th sample after a low pass at 0.8 of the new half rate."""
    return mapped(lambda v: zero_phase(v, fs, order, high=0.4 * fs / by)[::by], x)


def field_potential(x: Column | str, fs: float, new: float = 500.0, line: float = 50.0, high: float = 150.0) -> Column:
    """Low-frequency field: the line is stopped, a low pass, a lower rate, and notches at the line and its harmonics."""

    def one(v: np.ndarray) -> np.ndarray:
        v = resampled(zero_phase(zero_phase(v, fs, 2, line - 1, line + 1, stop=True), fs, 4, high=high), fs, new)
        for k in (1, 2, 3):
            if line * k + 1 < new / 2:
                v = zero_phase(v, new, 2, line * k - 1, line * k + 1, stop=True)
        return v

    return mapped(one, x)


def activity_envelope(x: Column | str, fs: float, new: float = 500.0, low: float = 500.0, high: float = 5000.0, smooth: float = 200.0) -> Column:
    """Multi-unit envelope: band pass, absolute value, low pass, lower rate."""
    return mapped(lambda v: resampled(zero_phase(np.abs(zero_phase(v, fs, 4, low, min(high, 0.49 * fs))), fs, 4, high=smooth), fs, new), x)


def smooth(x: Column | str, width: int, kind: str = "uniform") -> Column:
    """Moving mean, or Gaussian of standard deviation width / 5, over ``width`` samples with the ends repeated."""
    half = width // 2
    k = np.ones(2 * half + 1) if kind == "uniform" else np.exp(-0.5 * (np.arange(-half, half + 1) / (width / 5)) ** 2)
    return mapped(lambda v: np.convolve(np.pad(v, half, mode="edge"), k / k.sum(), mode="valid"), x)


def bridged(x: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Samples [a, b) of each span replaced by the line between those around it; at an end by the one neighbour."""
    x, bad = x.copy(), np.zeros(len(x), bool)
    for a, b in spans:
        bad[max(0, a) : max(0, b)] = True
    if bad.all() or not bad.any():
        return x
    good = np.flatnonzero(~bad)
    x[bad] = np.interp(np.flatnonzero(bad), good, x[good])
    return x


def bridge(df: DataFrame, samples: str, spans: str) -> DataFrame:
    """``samples`` with the ``spans`` (array<struct<start, end>>) of the same row interpolated."""

    def batch(rows: pd.Series, cuts: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else bridged(np.asarray(v, float), [(s["start"], s["end"]) for s in ([] if c is None else c)]).tolist() for v, c in zip(rows, cuts)])

    batch.__annotations__ = {"rows": pd.Series, "cuts": pd.Series, "return": pd.Series}
    return df.withColumn(samples, F.pandas_udf(batch, "array<double>")(F.col(samples).cast("array<double>"), F.col(spans)))


def local_fit(x: np.ndarray, half: int, rail: float = np.inf, blank: int = 5, ahead: int = 5, window: int = 15, limit: float = np.inf) -> np.ndarray:
    """The signal less a running cubic fit over 2 half + 1 samples. Samples at a rail, ``blank`` samples after them and
    ``ahead`` before are 0; after a rail the fit begins where its residuals over ``window`` samples stay under ``limit``
    deviations of the signal."""
    n = len(x)
    size = 2 * half + 1
    out = np.zeros(n)
    pegged = np.abs(x) >= rail
    edge = np.diff(np.r_[True, pegged, True].astype(np.int8))
    t = np.arange(-half, half + 1) / max(1, half)
    basis = np.linalg.pinv(np.vander(t, 4, increasing=True))  # rows give the coefficients of the fit
    scale = np.std(x[~pegged]) if (~pegged).any() else 0.0
    for a, b in zip(np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)):
        first, last = a + (blank if a else 0), b - (ahead if b < n else 0)
        if last - first < size:
            continue
        part = x[first:last]
        begin = 0
        while begin + size <= len(part):
            fit = np.vander(t, 4, increasing=True) @ (basis @ part[begin : begin + size])
            if scale == 0 or np.sum((part[begin : begin + window] - fit[:window]) ** 2) <= limit * window * scale**2:
                break
            begin += 1
        part, first = part[begin:], first + begin
        if len(part) < size:
            continue
        middle = np.convolve(part, basis[0][::-1], mode="valid")
        powers = np.vander(t, 4, increasing=True)
        head, tail = powers[:half] @ (basis @ part[:size]), powers[half + 1 :] @ (basis @ part[-size:])
        out[first : first + len(part)] = part - np.concatenate([head, middle, tail])
    return out


def subtract_local_fit(x: Column | str, half: int = 30, rail: float = float("inf"), blank: int = 5, ahead: int = 5, window: int = 15, limit: float = float("inf")) -> Column:
    return mapped(lambda v: local_fit(v, half, rail, blank, ahead, window, limit), x)


def clean_by_components(m: np.ndarray, k: int, band: int = 0) -> np.ndarray:
    """Each column less its projection on the first k principal components of the columns more than ``band`` away."""
    c = m - m.mean(axis=0)
    out = c.copy()
    for j in range(c.shape[1]):
        others = c[:, np.abs(np.arange(c.shape[1]) - j) > band]
        if others.shape[1]:
            u, s, _ = np.linalg.svd(others, full_matrices=False)
            u = u[:, : min(k, int((s > 1e-12 * s[0]).sum()))] if len(s) and s[0] else u[:, :0]
            out[:, j] = c[:, j] - u @ (u.T @ c[:, j])
    return out


def remove_shared_components(df: DataFrame, keys: list[str], column: str, samples: str, k: int = 4, band: int = 1) -> DataFrame:
    """(keys, column, samples): the rows of a key (channels, pulses or trials, by ``column``, of equal lengths) as columns of
    a matrix, each cleaned of what it shares with the rest. A group is one trial's channels, or one channel's pulses."""
    schema = df.select(*keys, column, F.col(samples).cast("array<double>").alias(samples)).schema

    def clean(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(column)
        m = np.stack([np.asarray(v, float) for v in group[samples]], axis=1)
        return group[[*keys, column]].assign(**{samples: list(clean_by_components(m, k, band).T)})

    return df.select(*keys, column, F.col(samples).cast("array<double>").alias(samples)).where(F.col(samples).isNotNull()).groupBy(*keys).applyInPandas(clean, schema)


def with_context(df: DataFrame, keys: list[str], order: str, samples: str, n: int) -> DataFrame:
    """Chunks with up to n samples of the chunk before and the one after; ``_before`` and ``_after`` count them."""
    w = Window.partitionBy(*keys).orderBy(order)
    none = F.array().cast(df.schema[samples].dataType)
    own = lambda c: F.coalesce(c, none)
    out = df.withColumn("_l", own(F.lag(samples).over(w))).withColumn("_r", own(F.lead(samples).over(w)))
    out = out.withColumn("_before", F.least(F.size("_l"), F.lit(n))).withColumn("_after", F.least(F.size("_r"), F.lit(n)))
    head = F.slice("_l", F.size("_l") - F.col("_before") + 1, F.col("_before"))
    return out.withColumn(samples, F.concat(head, own(F.col(samples)), F.slice("_r", F.lit(1), F.col("_after")))).drop("_l", "_r")


def without_context(df: DataFrame, samples: str) -> DataFrame:
    return df.withColumn(samples, F.slice(samples, F.col("_before") + 1, F.size(samples) - F.col("_before") - F.col("_after"))).drop("_before", "_after")


def to_samples(df: DataFrame, samples: str, *keep: str, index: str = "i", value: str = "v") -> DataFrame:
    """A row for each sample."""
    return df.select(*keep, F.posexplode(samples).alias(index, value))


def to_chunks(df: DataFrame, keys: list[str], index: str, value: str, size: int) -> DataFrame:
    """(keys, chunk, samples): runs of ``size`` indices as arrays in order; a group holds one chunk only."""
    chunk = F.floor(F.col(index) / F.lit(size)).cast("long")
    packed = df.groupBy(*keys, chunk.alias("chunk")).agg(F.sort_array(F.collect_list(F.struct(F.col(index).alias("i"), F.col(value).cast("double").alias("v")))).alias("_s"))
    return packed.select(*keys, "chunk", F.transform("_s", lambda s: s["v"]).alias("samples"))
