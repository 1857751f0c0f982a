"""Artifacts of repeated pulses, removed from a tensor of trials, pulses and channels by regression on shared components.

A tensor is a table of segments, one array for each (trial, pulse, channel). Cleaning over one of the three replaces each of
its members by what is left after regression on the principal components of the others. With segments less their own means,
components, regression and residual all follow from the products of members: G = sum of M M' over the slabs M (members by
samples) that the other two columns give. So slabs add up their products in parts, a matrix of weights is made from each sum,
and each slab is multiplied by it; no task holds more than a slab and a matrix of members squared.

Null arrays, trials, pulses and channels take no part and give no row; segments that are missing count as zeros. Arrays must
have one length and known, finite values. Segments are told by their three numbers, which must be of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.checkpoints import written

AXES = ("trial", "pulse", "channel")


def weights(g: np.ndarray, k: int, band: int = 1, after: bool = False) -> np.ndarray:
    """(d, d) W so that M' W, samples by members, is clean: column n takes from member n its regression on the first ``k``
    components of the members outside the ``band`` of members around n (n itself, then one after it, one before, ...). With
    ``after``, components are those of all members and the band's part in them is left out only then."""
    d = len(g)
    out = np.eye(d)
    for n in range(d):
        far = np.ones(d, bool)
        far[max(0, n - (band - 1) // 2) : n + band // 2 + 1] = False
        known = np.arange(d) if after else np.flatnonzero(far)
        values, vectors = np.linalg.eigh(g[np.ix_(known, known)])
        kept = np.argsort(values)[::-1][:k]
        kept = kept[values[kept] > 1e-12 * max(np.trace(g), 0)]
        parts = np.zeros((d, len(kept)))
        parts[known] = vectors[:, kept]
        parts[~far] = 0
        out[:, n] -= parts @ (np.linalg.pinv(parts.T @ g @ parts, rcond=1e-12, hermitian=True) @ (parts.T @ g[:, n]))
    return out


def _slabs(batch: pa.RecordBatch, d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Members' numbers and the (d, samples) matrix of each row's ``_s``."""
    s = batch.column(batch.schema.get_field_index("_s"))
    if not len(s):
        return
    flat = s.flatten()
    i, x = flat.field("i").to_numpy(), flat.field("x").flatten().to_numpy(zero_copy_only=False)
    x = x.reshape(len(i), -1)
    ends = np.cumsum(s.value_lengths().to_numpy())
    for a, b in zip(np.r_[0, ends[:-1]], ends):
        m = np.zeros((d, x.shape[1]))
        m[i[a:b]] = x[a:b]
        yield i[a:b], m


def clean_over(df: DataFrame, over: str, k: int, band: int = 1, by: str | None = None, after: bool = False) -> DataFrame:
    """(trial, pulse, channel, samples) of centred segments, cleaned over one of the three; with ``by``, another of them, each
    of its members has components of its own."""
    rest = [c for c in AXES if c != over]
    index = df.select(F.col(over).alias("_m")).distinct().withColumn("_i", F.row_number().over(Window.orderBy("_m")) - 1)
    index = written(index)  # members of one axis, whose products a task holds anyway
    d = index.count()
    rows = df.join(index, F.col(over) == F.col("_m"))
    rows = rows.repartition(by) if by else rows
    slabs = rows.groupBy(*rest).agg(F.sort_array(F.collect_list(F.struct(F.col("_i").alias("i"), F.col("samples").alias("x")))).alias("_s"))
    slabs = written(slabs.withColumn("_by", F.col(by) if by else F.lit(0)))
    kind = slabs.schema["_by"].dataType

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict = {}
            for name, (_, m) in zip(batch.column(batch.schema.get_field_index("_by")).to_pylist(), _slabs(batch, d)):
                sums[name] = sums.get(name, 0) + m @ m.T
            for name, g in sums.items():
                at = pa.array(np.arange(d * d, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([name] * (d * d), batch.schema.field("_by").type), at, pa.array(g.ravel())], ["_by", "at", "v"])

    def solved(part: pd.DataFrame) -> pd.DataFrame:
        g = np.zeros(d * d)
        g[part["at"]] = part["v"]
        return pd.DataFrame({"_of": part["_by"].iloc[:1], "_w": [weights(g.reshape(d, d), k, band, after).ravel()]})

    summed = slabs.select("_by", "_s").mapInArrow(products, T.StructType([T.StructField("_by", kind), T.StructField("at", T.IntegerType()), T.StructField("v", T.DoubleType())]))
    summed = summed.groupBy("_by", "at").agg(F.sum("v").alias("v"))
    made = summed.groupBy("_by").applyInPandas(solved, T.StructType([T.StructField("_of", kind), T.StructField("_w", T.ArrayType(T.DoubleType()))]))
    schema = T.StructType([*(slabs.schema[c] for c in rest), T.StructField("_i", T.IntegerType()), T.StructField("samples", T.ArrayType(T.DoubleType()))])

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = batch.column(batch.schema.get_field_index("_w"))
            for n, (i, m) in enumerate(_slabs(batch, d)):
                out = w[n].values.to_numpy().reshape(d, d).T[i] @ m
                keys = [batch.column(c).take(pa.array(np.full(len(i), n))) for c in range(len(rest))]
                x = pa.ListArray.from_arrays(pa.array(np.arange(len(i) + 1, dtype=np.int32) * m.shape[1]), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([*keys, pa.array(i.astype(np.int32)), x], schema.names)

    done = slabs.join(made, F.col("_by") == F.col("_of")).select(*rest, "_s", "_w").mapInArrow(applied, schema)
    return done.join(index, "_i").select(*(F.col("_m").alias(over) if c == over else F.col(c) for c in AXES), "samples")


def centred(df: DataFrame, trial: str, pulse: str, channel: str, samples: str) -> DataFrame:
    """Segments less their means, in the columns that ``clean_over`` takes."""
    rows = df.select(F.col(trial).alias("trial"), F.col(pulse).alias("pulse"), F.col(channel).alias("channel"), F.col(samples).cast("array<double>").alias("samples")).dropna()
    mean = F.aggregate("samples", F.lit(0.0), lambda s, v: s + v) / F.size("samples")
    rows = rows.where(F.size("samples") > 0).withColumn("_mean", mean)
    return rows.select(*AXES, F.transform("samples", lambda v: v - F.col("_mean")).alias("samples"))


def clean_pulses(df: DataFrame, trial: str, pulse: str, channel: str, samples: str, channels: int = 4, pulses: int = 2, trials: int = 4, band: tuple[int, int, int] = (1, 1, 1), each_trial: bool = True, after: bool = False) -> DataFrame:
    """(trial, pulse, channel, samples): segments cleaned over channels (of each trial by itself, or of all), then over pulses,
    then over trials, by so many components each; 0 leaves a step out."""
    out = centred(df, trial, pulse, channel, samples)
    for over, k, width, by in (("channel", channels, band[0], "trial" if each_trial else None), ("pulse", pulses, band[1], None), ("trial", trials, band[2], None)):
        if k:
            out = clean_over(out, over, k, width, by, after)
    return out


def into_pulses(df: DataFrame, samples: str, before: int, length: int, pulses: int) -> DataFrame:
    """A row for each pulse of the arrays, with ``pulse`` from 0: ``length`` samples each, after the first ``before``. Arrays
    that are too short give none."""
    long = df.where(F.size(samples) >= before + length * pulses)
    return long.withColumn("pulse", F.explode(F.sequence(F.lit(0), F.lit(pulses - 1)))).withColumn(samples, F.slice(samples, F.lit(before + 1) + F.col("pulse") * length, F.lit(length)))


def from_pulses(whole: DataFrame, cleaned: DataFrame, trial: str, channel: str, samples: str, before: int, length: int, pulses: int) -> DataFrame:
    """``whole`` with the cleaned pulses in their places; what lies around them stays, as do arrays without all pulses."""
    packed = cleaned.groupBy(F.col("trial").alias("_t"), F.col("channel").alias("_c")).agg(F.count(F.lit(1)).alias("_n"), F.sort_array(F.collect_list(F.struct("pulse", F.col("samples").alias("x")))).alias("_p"))
    joined = whole.join(packed.where(F.col("_n") == pulses), (F.col(trial) == F.col("_t")) & (F.col(channel) == F.col("_c")), "left")
    own = F.col(samples).cast("array<double>")
    new = F.concat(F.slice(own, 1, before), F.flatten(F.transform("_p", lambda p: p["x"])), F.slice(own, F.lit(before + length * pulses + 1), F.size(own)))
    return joined.withColumn(samples, F.when(F.col("_p").isNotNull(), new).otherwise(own)).drop("_t", "_c", "_n", "_p")
