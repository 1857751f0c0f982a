"""Independent components by fixed-point rounds over summed moments.

Arrays are centred and whitened by the axes of their covariance, which is summed in parts. A round needs, for the current
directions, the means of z g(w z) and of g'(w z) over all rows: tasks give sums, the driver gets numbers of the components
squared, makes the directions orthogonal to each other at once, and sends them again. Whitened rows are written once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.checkpoints import written
from tidemark.operators.waveforms import covariance

#: Contrasts as (g, g').
CONTRASTS = {
    "tanh": (np.tanh, lambda u: 1 - np.tanh(u) ** 2),
    "cube": (lambda u: u**3, lambda u: 3 * u**2),
    "gauss": (lambda u: u * np.exp(-(u**2) / 2), lambda u: (1 - u**2) * np.exp(-(u**2) / 2)),
}


@dataclass
class Components:
    """``unmixing`` (k, length) makes sources of variance 1 from arrays less ``mean``; ``mixing`` is its inverse on the axes
    that were kept. Components stand by the falling norm of their mixing, whose largest entry is positive."""

    mean: np.ndarray
    unmixing: np.ndarray
    mixing: np.ndarray
    rounds: int
    settled: bool


def _orthogonal(w: np.ndarray) -> np.ndarray:
    u, _, v = np.linalg.svd(w)
    return u @ v


def independent_components(df: DataFrame, wave: str, k: int, contrast: str = "tanh", most: int = 200, tolerance: float = 1e-7, seed: int = 1) -> Components:
    """Components of the arrays that aren't null; at most as many as the covariance has axes. ``settled`` tells whether the
    directions stood still before ``most`` rounds."""
    mean, cov, n = covariance(df, wave)
    if n < 2:
        return Components(mean, np.zeros((0, len(mean))), np.zeros((len(mean), 0)), 0, True)
    values, vectors = np.linalg.eigh(cov)
    kept = np.argsort(values)[::-1][:k]
    kept = kept[values[kept] > 1e-10 * values.max()]
    whiten = (vectors[:, kept] / np.sqrt(values[kept])).T
    back = vectors[:, kept] * np.sqrt(values[kept])
    d = len(kept)
    g, slope = CONTRASTS[contrast]

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                z = (b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) - mean) @ whiten.T
                yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(z.ravel()), d).cast(pa.list_(pa.float64()))], ["z"])

    rows = df.select(F.col(wave).cast("array<double>").alias("x")).where("x is not null").mapInArrow(whitened, "z array<double>")
    rows = written(rows)
    w, done, settled = _orthogonal(np.random.default_rng(seed).normal(size=(d, d))), 0, d == 0

    while done < most and not settled:

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(d * d + d)
            for b in batches:
                if b.num_rows:
                    z = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, d)
                    u = z @ w.T
                    total += np.r_[(g(u).T @ z).ravel(), slope(u).sum(0)]
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(total)), pa.int32()), "v": total})

        got = {r.i: r.v for r in rows.mapInArrow(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
        total = np.array([got[i] for i in range(d * d + d)]) / n
        new = _orthogonal(total[: d * d].reshape(d, d) - total[d * d :, None] * w)
        settled = float(np.max(1 - np.abs((new * w).sum(1)))) < tolerance
        w, done = new, done + 1
    unmixing, mixing = w @ whiten, back @ w.T
    order = np.argsort(-np.linalg.norm(mixing, axis=0), kind="stable")
    signs = np.sign(mixing[np.abs(mixing).argmax(0), np.arange(d)]) if d else np.zeros(0)
    return Components(mean, (signs[:, None] * unmixing)[order], (mixing * signs)[:, order], done, settled)


def source_values(df: DataFrame, wave: str, found: Components) -> DataFrame:
    """Adds ``sources``: the components of each array; null for null arrays."""
    sent = df.sparkSession.sparkContext.broadcast((found.mean, found.unmixing))  # k + 1 arrays

    def batch(x: pd.Series) -> pd.Series:
        mean, unmixing = sent.value
        known = x.notna().to_numpy()
        values = iter((np.stack(x[known].to_numpy()) - mean) @ unmixing.T if known.any() else ())
        return pd.Series([next(values) if ok else None for ok in known], dtype=object)

    batch.__annotations__ = {"x": pd.Series, "return": pd.Series}
    return df.withColumn("sources", F.pandas_udf(batch, "array<double>")(F.col(wave).cast("array<double>")))
