"""Distribution functions as columns: Arrow batches of numbers in, numbers out.

The incomplete gamma and beta functions are evaluated for a whole batch at once by their continued fractions and series;
quantiles by bisection on them. Null and NaN stay null; arguments outside the domain give null.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_ROUNDS = 300
_lgamma = np.frompyfunc(math.lgamma, 1, 1)
_erfc = np.frompyfunc(math.erfc, 1, 1)


def lgamma(x: np.ndarray) -> np.ndarray:
    return _lgamma(x).astype(float)


def gamma_cdf(x: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function: the series below shape + 1, the continued fraction above."""
    x, a = np.broadcast_arrays(np.asarray(x, float), np.asarray(shape, float))
    out = np.zeros(x.shape)
    inside = (x > 0) & (a > 0) & np.isfinite(x)
    low, high = inside & (x < a + 1), inside & (x >= a + 1)
    if low.any():
        v, s = x[low], a[low]
        term = total = 1 / s
        for k in range(1, 10_000):
            term = term * v / (s + k)
            total = total + term
            if (np.abs(term) < 1e-16 * np.abs(total)).all():
                break
        out[low] = total * np.exp(-v + s * np.log(v) - lgamma(s))
    if high.any():
        v, s = x[high], a[high]
        b = v + 1 - s
        c, d = np.full(v.shape, 1e300), 1 / b
        h = d
        for k in range(1, 10_000):
            n = -k * (k - s)
            b = b + 2
            d = 1 / np.where((t := n * d + b) == 0, 1e-300, t)
            c = np.where((t := b + n / c) == 0, 1e-300, t)
            h = h * (step := c * d)
            if (np.abs(step - 1) < 1e-15).all():
                break
        out[high] = 1 - h * np.exp(-v + s * np.log(v) - lgamma(s))
    out = np.where(x == np.inf, 1.0, out)
    return np.where(np.isnan(x) | np.isnan(a) | (a <= 0), np.nan, out)


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction, on the side where that converges fast."""
    x, a, b = (np.array(v) for v in np.broadcast_arrays(*(np.asarray(v, float) for v in (x, a, b))))
    swap = x > (a + 1) / (a + b + 2)
    y, p, q = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    inside = (x > 0) & (x < 1) & (a > 0) & (b > 0)
    y, p, q = np.where(inside, y, 0.5), np.where(inside, p, 1.0), np.where(inside, q, 1.0)
    tiny = 1e-300
    c, d = np.ones(y.shape), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d
    for m in range(1, _ROUNDS):
        for n in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + n * d
            c = 1 + n / c
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if (np.abs(d * c - 1) < 1e-15).all():
            break
    value = h * np.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    value = np.where(swap, 1 - value, value)
    value = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, value))
    return np.where(np.isnan(x) | ~(a > 0) | ~(b > 0), np.nan, value)


def norm_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * _erfc(-np.asarray(x, float) / math.sqrt(2)).astype(float)


def t_cdf(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    t, n = np.asarray(t, float), np.asarray(dof, float)
    tail = 0.5 * beta_cdf(n / (n + t * t), n / 2, 0.5)
    return np.where(t > 0, 1 - tail, tail)


def f_cdf(f: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    return np.where(f > 0, beta_cdf(d1 * f / (d1 * f + d2), d1 / 2, d2 / 2), 0.0 * f)


def chi2_cdf(x: np.ndarray, dof: np.ndarray) -> np.ndarray:
    return gamma_cdf(np.asarray(x, float) / 2, np.asarray(dof, float) / 2)


def quantile(cdf: Callable[[np.ndarray], np.ndarray], p: np.ndarray, low: float, high: float) -> np.ndarray:
    """The x with cdf(x) = p by bisection; the range is doubled until it holds the answer."""
    p = np.asarray(p, float)
    a, b = np.full(p.shape, low), np.full(p.shape, high)
    for _ in range(60):
        if not (short := cdf(b) < p).any():
            break
        b = np.where(short, 2 * b, b)
    for _ in range(60 if low < 0 else 0):
        if not (short := cdf(a) > p).any():
            break
        a = np.where(short, 2 * a, a)
    for _ in range(110):
        m = (a + b) / 2
        below = cdf(m) < p
        a, b = np.where(below, m, a), np.where(below, b, m)
    return np.where((p > 0) & (p < 1), (a + b) / 2, np.where(p == 0, -np.inf if low < 0 else 0.0, np.where(p == 1, np.inf, np.nan)))


def norm_inv(p: np.ndarray) -> np.ndarray:
    return quantile(norm_cdf, p, -8.0, 8.0)


def t_inv(p: np.ndarray, dof: np.ndarray) -> np.ndarray:
    return quantile(lambda x: t_cdf(x, dof), p, -8.0, 8.0)


def f_inv(p: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    return quantile(lambda x: f_cdf(x, d1, d2), p, 0.0, 8.0)


def chi2_inv(p: np.ndarray, dof: np.ndarray) -> np.ndarray:
    return quantile(lambda x: chi2_cdf(x, dof), p, 0.0, 8.0)


def gamma_pdf(x: np.ndarray, shape: np.ndarray, rate: np.ndarray = 1.0) -> np.ndarray:
    x, a, r = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, shape, rate)))
    ok = x > 0
    return np.where(ok, np.exp(a * np.log(r) + (a - 1) * np.log(np.where(ok, x, 1)) - r * x - lgamma(a)), 0.0)


def digamma(x: np.ndarray) -> np.ndarray:
    """Raised by recurrence until the asymptotic series holds; x > 0."""
    x = np.array(x, float)
    out = np.zeros(x.shape)
    for _ in range(10):
        out -= 1 / x
        x = x + 1
    i = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i / 240)))


def trigamma(x: np.ndarray) -> np.ndarray:
    x = np.array(x, float)
    out = np.zeros(x.shape)
    for _ in range(10):
        out += 1 / (x * x)
        x = x + 1
    i = 1 / (x * x)
    return out + 1 / x + i / 2 + i / x * (1 / 6 - i * (1 / 30 - i * (1 / 42 - i / 30)))


def _column(f: Callable[..., np.ndarray], *args: Column | str) -> Column:
    def batch(*cols: pd.Series) -> pd.Series:
        with np.errstate(all="ignore"):
            return pd.Series(f(*(c.to_numpy(float, na_value=np.nan) for c in cols)))

    arity = {1: lambda a: batch(a), 2: lambda a, b: batch(a, b), 3: lambda a, b, c: batch(a, b, c)}[len(args)]
    arity.__annotations__ = {n: pd.Series for n in "abc"[: len(args)]} | {"return": pd.Series}
    got = F.pandas_udf(arity, "double")(*(F.col(a).cast("double") if isinstance(a, str) else a.cast("double") for a in args))
    return F.when(~F.isnan(got), got)


def _once(f: Callable[..., np.ndarray]) -> Callable[..., np.ndarray]:
    """f of each different row of arguments once: a search is long, and few arguments differ where they are counts."""

    def of(*args: np.ndarray) -> np.ndarray:
        rows, at = np.unique(np.stack(args), axis=1, return_inverse=True)
        return np.asarray(f(*rows))[at.ravel()] if rows.size else np.zeros(0)

    return of


def normal_p(z: Column | str) -> Column:
    return _column(norm_cdf, z)


def normal_quantile(p: Column | str) -> Column:
    return _column(norm_inv, p)


def student_p(t: Column | str, dof: Column | str) -> Column:
    return _column(t_cdf, t, dof)


def student_quantile(p: Column | str, dof: Column | str) -> Column:
    return _column(_once(t_inv), p, dof)


def f_p(f: Column | str, d1: Column | str, d2: Column | str) -> Column:
    return _column(f_cdf, f, d1, d2)


def f_quantile(p: Column | str, d1: Column | str, d2: Column | str) -> Column:
    return _column(_once(f_inv), p, d1, d2)


def chi_square_p(x: Column | str, dof: Column | str) -> Column:
    return _column(chi2_cdf, x, dof)


def chi_square_quantile(p: Column | str, dof: Column | str) -> Column:
    return _column(_once(chi2_inv), p, dof)


def gamma_density(x: Column | str, shape: Column | str, rate: Column | str) -> Column:
    return _column(gamma_pdf, x, shape, rate)


def signed_p(statistic: Column, kind: str, d1: Column | None = None, d2: Column | None = None, tails: int = 2) -> Column:
    """p of a statistic (z, t, r or F) with the statistic's sign; r is turned to t first."""
    if kind == "r":
        statistic, kind = statistic * F.sqrt(F.try_divide(d1, 1 - statistic * statistic)), "t"
    upper = 1 - {"z": lambda: normal_p(F.abs(statistic)), "t": lambda: student_p(F.abs(statistic), d1), "f": lambda: f_p(statistic, d1, d2)}[kind]()
    return F.when(statistic < 0, -1.0).otherwise(1.0) * upper * (1 if kind == "f" else tails)
