"""Wavelets, wavelet packets and multiwavelets of arrays, and the features that tell rows apart best.

Transforms are periodic and orthogonal, so they can be undone. An array whose length isn't a multiple of 2^levels is taken as
if its last value went on up to the next one; coefficients have that longer length, and what is rebuilt can be cut. A batch of
rows of one length is transformed at once. Null arrays stay null, empty ones empty; nulls in arrays make their rows' results
NaN.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.checkpoints import written
from tidemark.functions.distributions import normal_p
from tidemark.operators.stats import running_sum

#: Values that are transformed at once.
CELLS = 1 << 16

#: A packet as (level, index); its children are (level + 1, 2 index), the low pass, and (level + 1, 2 index + 1).
Node = tuple[int, int]

_R = math.sqrt(2)
#: The four 2 by 2 low-pass and high-pass matrices of the symmetric orthogonal pair of two scaling functions.
PAIR_LOW = np.array([[[3 / (5 * _R), 4 / 5], [-1 / 20, -3 / (10 * _R)]], [[3 / (5 * _R), 0], [9 / 20, 1 / _R]], [[0, 0], [9 / 20, -3 / (10 * _R)]], [[0, 0], [-1 / 20, 0]]])
PAIR_HIGH = np.array([[[-1 / 20, -3 / (10 * _R)], [1 / (10 * _R), 3 / 10]], [[9 / 20, -1 / _R], [-9 / (10 * _R), 0]], [[9 / 20, -3 / (10 * _R)], [9 / (10 * _R), -3 / 10]], [[-1 / 20, 0], [-1 / (10 * _R), 0]]])


def low_pass(moments: int) -> np.ndarray:
    """The low-pass filter of 2 ``moments`` taps with so many vanishing moments and least phase: 1 is Haar's."""
    y = np.roots([math.comb(moments - 1 + k, k) for k in range(moments)][::-1])
    taps = np.poly1d([1.0])
    for root in y:
        both = np.roots([1, 4 * root - 2, 1])
        taps *= np.poly1d([1, -both[np.abs(both).argmin()]])
    taps *= np.poly1d([1, 1]) ** moments
    h = np.real(taps.coeffs)
    return h * _R / h.sum()


def high_pass(h: np.ndarray) -> np.ndarray:
    return h[::-1] * (-1.0) ** np.arange(len(h))


def _split(x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Low and high halves of the rows of x, whose length is even."""
    n = x.shape[1]
    parts = x[:, (2 * np.arange(n // 2)[:, None] + np.arange(len(h))) % n]
    return parts @ h, parts @ high_pass(h)


def _join(low: np.ndarray, high: np.ndarray, h: np.ndarray) -> np.ndarray:
    n = 2 * low.shape[1]
    out = np.zeros((len(low), n))
    for j, (a, b) in enumerate(zip(h, high_pass(h))):
        out[:, (2 * np.arange(n // 2) + j) % n] += a * low + b * high
    return out


def _padded(x: np.ndarray, levels: int) -> np.ndarray:
    return np.pad(x, [(0, 0), (0, -x.shape[1] % 2**levels)], mode="edge")


def _column(f: Callable[[np.ndarray], np.ndarray], x: Column | str) -> Column:
    """f over matrices of the rows of each length."""

    def batch(rows: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(rows), dtype=object)
        sizes = np.array([-1 if v is None else len(v) for v in rows])
        for n in np.unique(sizes[sizes >= 0]):
            same, step = np.flatnonzero(sizes == n), max(1, CELLS // max(1, int(n)))
            for at in (same[k : k + step] for k in range(0, len(same), step)):
                done = f(np.stack([np.asarray(v, float) for v in rows.iloc[at]])) if n else np.zeros((len(at), 0))
                for i, v in zip(at, done):
                    out.iloc[i] = v
        return out

    batch.__annotations__ = {"rows": pd.Series, "return": pd.Series}
    return F.pandas_udf(batch, "array<double>")((F.col(x) if isinstance(x, str) else x).cast("array<double>"))


def wavelet_nodes(levels: int) -> list[Node]:
    """The packets of the plain transform: the low pass of all levels, then high passes from the coarsest to the finest."""
    return [(levels, 0), *((k, 1) for k in range(levels, 0, -1))]


def packets(x: np.ndarray, nodes: Sequence[Node], h: np.ndarray) -> np.ndarray:
    """Coefficients of the nodes, side by side, of the rows of x."""
    found = {(0, 0): x}

    def get(level: int, i: int) -> np.ndarray:
        if (level, i) not in found:
            found[level, i & ~1], found[level, i | 1] = _split(get(level - 1, i >> 1), h)
        return found[level, i]

    return np.concatenate([get(*node) for node in nodes], axis=1)


def unpacked(c: np.ndarray, nodes: Sequence[Node], h: np.ndarray) -> np.ndarray:
    """Rows from the coefficients of nodes that are a whole basis."""
    n, at, parts = c.shape[1], 0, {}
    for level, i in nodes:
        size = n >> level
        parts[level, i] = c[:, at : at + size]
        at += size
    for level in range(max((k for k, _ in parts), default=0), 0, -1):
        for node in [p for p in parts if p[0] == level and not p[1] & 1]:
            parts[level - 1, node[1] >> 1] = _join(parts.pop(node), parts.pop((level, node[1] | 1)), h)
    return parts[0, 0]


def decomposed(x: Column | str, nodes: Sequence[Node], moments: int = 2) -> Column:
    """Coefficients of ``nodes``: of ``wavelet_nodes(levels)`` or of a ``best_basis``."""
    h, levels = low_pass(moments), max(k for k, _ in nodes)
    return _column(lambda v: packets(_padded(v, levels), nodes, h), x)


def rebuilt(x: Column | str, nodes: Sequence[Node], moments: int = 2, size: int | None = None) -> Column:
    """Arrays from the coefficients of a whole basis, cut to ``size``."""
    h = low_pass(moments)
    return _column(lambda c: unpacked(c, nodes, h)[:, :size], x)


def mean_array(df: DataFrame, wave: str) -> np.ndarray:
    """Means by place of the arrays that aren't null, added up in parts."""
    sums = df.select(F.posexplode(F.col(wave).cast("array<double>")).alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"))
    return np.array([r.m for r in sums.orderBy("k").collect()], float)  # a number a place


def best_basis(df: DataFrame, wave: str, levels: int, moments: int = 2) -> list[Node]:
    """The packets, from low to high, whose coefficients of the mean array have the least entropy, -sum c^2 ln c^2. A packet
    stays whole where its parts together have no less."""
    x, h = mean_array(df, wave)[None, :], low_pass(moments)
    if not x.size:
        return [(0, 0)]
    x = _padded(x, levels)

    def best(node: Node, c: np.ndarray) -> tuple[float, list[Node]]:
        e = c[c != 0] ** 2
        own = float(-(e * np.log(e)).sum())
        if node[0] == levels:
            return own, [node]
        low, high = _split(c, h)
        a, b = best((node[0] + 1, 2 * node[1]), low), best((node[0] + 1, 2 * node[1] + 1), high)
        return (own, [node]) if own <= a[0] + b[0] else (a[0] + b[0], a[1] + b[1])

    return best((0, 0), x)[1]


def pairs(x: np.ndarray, levels: int) -> np.ndarray:
    """Coefficients of the rows of x by two wavelets: each value goes in twice, weighted as constants are by the two scaling
    functions. Two coefficients a place: those of scaling first, then wavelets from the coarsest to the finest."""
    v = x[:, :, None] * (np.array([_R, 1.0]) / math.sqrt(3))
    fine = []
    for _ in range(levels):
        n = v.shape[1]
        parts = v[:, (2 * np.arange(n // 2)[:, None] + np.arange(4)) % n]
        fine.append(np.einsum("rkjb,jab->rka", parts, PAIR_HIGH))
        v = np.einsum("rkjb,jab->rka", parts, PAIR_LOW)
    return np.concatenate([c.reshape(len(x), -1) for c in (v, *fine[::-1])], axis=1)


def unpaired(c: np.ndarray, levels: int) -> np.ndarray:
    size = c.shape[1] >> levels
    v, at = c[:, :size].reshape(len(c), -1, 2), size
    for _ in range(levels):
        k = v.shape[1]
        w = c[:, at : at + 2 * k].reshape(len(c), -1, 2)
        at, out = at + 2 * k, np.zeros((len(c), 2 * k, 2))
        for j in range(4):
            out[:, (2 * np.arange(k) + j) % (2 * k)] += v @ PAIR_LOW[j] + w @ PAIR_HIGH[j]
        v = out
    return v @ np.array([_R, 1.0]) / math.sqrt(3)


def multiwavelet(x: Column | str, levels: int, scaling: bool = True) -> Column:
    """Coefficients by the pair of wavelets, twice as many as values; without ``scaling`` those of the wavelets only."""

    def one(v: np.ndarray) -> np.ndarray:
        c = pairs(_padded(v, levels), levels)
        return c if scaling else c[:, c.shape[1] >> levels :]

    return _column(one, x)


def from_multiwavelet(x: Column | str, levels: int, size: int | None = None) -> Column:
    return _column(lambda c: unpaired(c, levels)[:, :size], x)


def normal_distances(df: DataFrame, features: str, within: float = 3.0) -> DataFrame:
    """(k, n, distance): how far the distribution of each feature is from the normal one of its mean and deviation: the
    largest difference of the two distribution functions. Values more than ``within`` deviations from their mean are left
    out first; nulls and NaN take no part, and a feature of one value only has distance 0. Equal values are counted together,
    and counts are added up by ``running_sum``, which cuts large features into ranges."""
    v = df.select(F.posexplode(F.col(features).cast("array<double>")).alias("k", "v")).where("v is not null and not isnan(v)")
    values = written(v.groupBy("k", "v").agg(F.count(F.lit(1)).alias("c")))
    moments = v.groupBy(F.col("k").alias("_k")).agg(F.avg("v").alias("_m"), F.stddev_pop("v").alias("_s"), F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    near = values.join(moments, F.col("k") == F.col("_k")).where((F.abs(F.col("v") - F.col("_m")) <= within * F.col("_s")) | (F.col("_lo") == F.col("_hi")))
    near = near.select("k", "v", "c", (F.col("v") - F.col("_lo")).alias("_off"), "_lo")
    # moments about the least value, so that constants have none
    shape = near.groupBy(F.col("k").alias("_k"), "_lo").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("_off")).alias("_a"), F.sum(F.col("c") * F.col("_off") * F.col("_off")).alias("_b"))
    var = (F.col("_b") - F.col("_a") * F.col("_a") / F.col("n")) / F.greatest(F.col("n") - 1, F.lit(1))
    shape = shape.select("_k", "n", (F.col("_lo") + F.col("_a") / F.col("n")).alias("_mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("_sd"))
    ranked = running_sum(near.select("k", "v", "c"), ["k"], "v", "c", "_upto").join(shape, F.col("k") == F.col("_k"))
    p = normal_p(F.try_divide(F.col("v") - F.col("_mean"), F.col("_sd")))
    gap = F.greatest(F.abs(F.col("_upto") / F.col("n") - F.col("_p")), F.abs((F.col("_upto") - F.col("c")) / F.col("n") - F.col("_p")))
    return ranked.withColumn("_p", p).groupBy("k", "n").agg(F.max(F.when(F.col("_sd") > 0, gap).otherwise(0.0)).alias("distance"))


def best_features(df: DataFrame, features: str, n: int, within: float = 3.0, name: str = "best") -> DataFrame:
    """Adds ``name``: the n features farthest from normal, the farthest first, of equal ones the first."""
    chosen = [r.k for r in normal_distances(df, features, within).orderBy(F.desc("distance"), "k").limit(n).collect()]
    return df.withColumn(name, F.when(F.col(features).isNotNull(), F.array(*(F.get(F.col(features), F.lit(k)) for k in chosen))))
