"""Waveforms as arrays: means, signal to noise, features, nearest centroids, greedy detection and clustering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _long(df: DataFrame, wave: str, *keep: str) -> DataFrame:
    return df.select(*keep, F.posexplode(F.col(wave).cast("array<double>")).alias("k", "v")).withColumn("k", F.col("k").cast("long"))


def mean_waveform(df: DataFrame, wave: str, cluster: str) -> DataFrame:
    """(cluster, k, m)."""
    return _long(df, wave, cluster).groupBy(cluster, "k").agg(F.avg("v").alias("m"))


def snr(df: DataFrame, wave: str, cluster: str) -> DataFrame:
    """(cluster, snr): range of the mean over five deviations of all residuals. The residuals' variance comes from sums, so
    samples aren't joined to their means: within a cluster residuals have mean 0."""
    each = _long(df, wave, cluster).groupBy(cluster, "k").agg(F.avg("v").alias("m"), F.var_pop("v").alias("s"), F.count("v").alias("n"))
    out = each.groupBy(cluster).agg((F.max("m") - F.min("m")).alias("range"), F.sqrt(F.sum(F.col("s") * F.col("n")) / (F.sum("n") - 1)).alias("sd"))
    return out.select(cluster, F.try_divide(F.col("range"), 5 * F.col("sd")).alias("snr"))


def centroids(df: DataFrame, wave: str, cluster: str) -> DataFrame:
    """(cluster, c array): one row for each cluster."""
    m = mean_waveform(df, wave, cluster)
    return m.groupBy(F.col(cluster).alias("cluster")).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "m"))), lambda x: x["m"]).alias("c"))


def nearest_centroid(df: DataFrame, key: str, wave: str, cluster: str, most_clusters: int = 10_000) -> DataFrame:
    """(key, cluster, distance): squared distance to the nearest centroid. Centroids are a row for each cluster: beyond
    ``most_clusters`` they are refused rather than broadcast."""
    c = centroids(df, wave, cluster)
    if c.count() > most_clusters:
        raise ValueError(f"more than {most_clusters} centroids")
    packed = c.agg(F.sort_array(F.collect_list(F.struct("cluster", "c"))).alias("all"))
    distance = lambda x: F.aggregate(F.zip_with(x["c"], F.col(wave).cast("array<double>"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)
    ranked = df.join(F.broadcast(packed)).withColumn("_best", F.array_min(F.transform("all", lambda x: F.struct(distance(x).alias("d"), x["cluster"].alias("cluster")))))
    return ranked.select(key, F.col("_best.cluster").alias("cluster"), F.col("_best.d").alias("distance"))


def knn_vote(queries: DataFrame, labelled: DataFrame, key: str, features: str, label: str, k: int, most: float | None = None, block: int = 256) -> DataFrame:
    """(key, label, votes) of each query: the label of most of its k nearest labelled rows (squared distance, at most ``most``), of equal
    numbers the least label. All queries are compared with all labelled rows of other keys: queries go by blocks of ``block``
    rows, sent once to each part of the labelled rows, whose own k nearest are then merged by key."""
    parts = labelled.select(F.col(key).alias("_key"), F.col(features).cast("array<double>").alias("_f"), F.col(label).alias("_label")).where("_f is not null and _label is not null")
    asked = queries.select(F.col(key).alias("_q"), F.col(features).cast("array<double>").alias("_x")).where("_x is not null")
    q_blocks = max(1, -(-asked.count() // block))
    l_blocks = max(1, -(-parts.count() // (16 * block)))
    spread = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = asked.withColumn("_i", spread("_q", q_blocks)).withColumn("_j", every(l_blocks)).groupBy("_i", "_j")
    b = parts.withColumn("_j", spread("_key", l_blocks)).withColumn("_i", every(q_blocks)).groupBy("_i", "_j")
    schema = T.StructType([T.StructField("_q", queries.schema[key].dataType), T.StructField("_d", T.DoubleType()), T.StructField("_key", labelled.schema[key].dataType), T.StructField("_label", labelled.schema[label].dataType)])

    def near(x: pa.Table, y: pa.Table) -> pa.Table:
        x, y = x.combine_chunks(), y.combine_chunks()
        asker, given = [], []
        distance: list[float] = []
        if x.num_rows and y.num_rows:
            p, q = np.stack(x.column("_x").to_numpy()), np.stack(y.column("_f").to_numpy())
            own, keys = x.column("_q").to_numpy(), y.column("_key").to_numpy()
            for i in range(len(p)):
                d = ((q - p[i]) ** 2).sum(1)
                ok = np.flatnonzero((keys != own[i]) & (d <= (np.inf if most is None else most)))
                order = ok[np.lexsort((keys[ok], d[ok]))][:k]
                asker += [i] * len(order)
                given += order.tolist()
                distance += d[order].tolist()
        at, of = pa.array(asker, pa.int64()), pa.array(given, pa.int64())
        return pa.table([x.column("_q").take(at), pa.array(distance, pa.float64()), y.column("_key").take(of), y.column("_label").take(of)], schema.names)

    found = a.cogroup(b).applyInArrow(near, schema)
    first = Window.partitionBy("_q").orderBy("_d", "_key")
    nearest = found.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k)
    votes = nearest.groupBy("_q", "_label").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("_q").agg(F.max("votes").alias("votes"))
    return best.join(votes, ["_q", "votes"]).groupBy(F.col("_q").alias(key), "votes").agg(F.min("_label").alias(label))


def top_features(df: DataFrame, wave: str, k: int) -> DataFrame:
    """The k samples of largest variance."""
    return _long(df, wave).groupBy("k").agg(F.var_samp("v").alias("variance")).orderBy(F.desc("variance")).limit(k)


def features(df: DataFrame, wave: str) -> DataFrame:
    """Adds ``trough`` (index of the least sample) and ``height`` (peak to trough)."""
    w = F.col(wave).cast("array<double>")
    return df.withColumn("trough", F.array_position(w, F.array_min(w)) - 1).withColumn("height", F.array_max(w) - F.array_min(w))


def covariance(df: DataFrame, wave: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, sample covariance and number of the arrays that aren't null. Tasks give sums and products about one of the
    arrays, which are added up by place: the driver gets numbers of the arrays' length squared, whatever the rows."""
    rows = df.select(F.col(wave).cast("array<double>").alias("x")).where("x is not null")
    first = rows.first()
    if first is None:
        return np.zeros(0), np.zeros((0, 0)), 0
    origin = np.array(first.x)
    d = len(origin)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, np.zeros(d), np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d) - origin
                n, total, products = n + len(x), total + x.sum(0), products + x.T @ x
        yield pa.RecordBatch.from_pydict({"k": pa.array(range(1 + d + d * d), pa.int32()), "v": np.r_[float(n), total, products.ravel()]})

    got = {r.k: r.v for r in rows.mapInArrow(sums, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()}
    n, total = int(got[0]), np.array([got[1 + i] for i in range(d)])
    products = np.array([got[1 + d + i] for i in range(d * d)]).reshape(d, d)
    return origin + total / n, (products - np.outer(total, total) / n) / max(1, n - 1), n


def principal_axes(df: DataFrame, wave: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, (k, length) axes of largest variance and all variances in falling order. An axis points to where its largest
    entry is positive."""
    mean, cov, _ = covariance(df, wave)
    values, vectors = np.linalg.eigh(cov) if len(mean) else (np.zeros(0), np.zeros((0, 0)))
    axes = vectors.T[::-1][:k]
    top = np.abs(np.round(axes, 9)).argmax(1) if len(axes) else np.zeros(0, int)
    return mean, axes * np.where(axes[np.arange(len(axes)), top] < 0, -1, 1)[:, None], np.maximum(values[::-1], 0)


def principal_scores(df: DataFrame, wave: str, k: int) -> DataFrame:
    """Adds ``scores``: the places of the arrays, less their mean, on the k axes of largest variance; null for null arrays."""
    mean, axes, _ = principal_axes(df, wave, k)
    sent = df.sparkSession.sparkContext.broadcast((mean, axes))  # k + 1 arrays

    def batch(x: pd.Series) -> pd.Series:
        mean, axes = sent.value
        known = x.notna().to_numpy()
        found = iter((np.stack(x[known].to_numpy()) - mean) @ axes.T if known.any() else ())
        return pd.Series([next(found) if k else None for k in known], dtype=object)

    batch.__annotations__ = {"x": pd.Series, "return": pd.Series}
    return df.withColumn("scores", F.pandas_udf(batch, "array<double>")(F.col(wave).cast("array<double>")))


def explained_variance(df: DataFrame, wave: str) -> DataFrame:
    """(k, variance, share): variances along the principal axes, from 1 on, and their shares of the whole."""
    _, _, values = principal_axes(df, wave, 0)
    total = float(values.sum()) or 1.0
    return df.sparkSession.createDataFrame([(i + 1, float(v), float(v) / total) for i, v in enumerate(values)], "k int, variance double, share double")


def kmeans(df: DataFrame, wave: str, k: int, seed: int = 1) -> DataFrame:
    v = df.withColumn("_v", array_to_vector(F.col(wave).cast("array<double>")))
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(v).transform(v).drop("_v")


def keep_after_refractory(df: DataFrame, at: str, keys: list[str], gap: int) -> DataFrame:
    """Events of each key more than ``gap`` after the last kept one, as ``at`` and the keys.

    Greedy, so no window frame has it: stretches between pauses longer than the gap are independent, and each is walked
    in order; they are dealt to tasks, not whole channels."""
    w = Window.partitionBy(*keys).orderBy(at)
    parts = df.select(*keys, at).withColumn("_new", F.when(F.col(at) - F.lag(at).over(w) > gap, 1).otherwise(0))
    parts = parts.withColumn("_part", F.xxhash64(*keys, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    schema = df.select(*keys, at).schema

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = last = None
        for batch in batches:
            kept = []
            for p, t in zip(batch.column(len(keys) + 1).to_pylist(), batch.column(len(keys)).to_pylist()):
                kept.append(p != part or t - last > gap)
                if kept[-1]:
                    part, last = p, t
            yield pa.RecordBatch.from_arrays(batch.columns[: len(keys) + 1], schema.names).filter(pa.array(kept, pa.bool_()))

    dealt = parts.select(*keys, at, "_part").repartition("_part").sortWithinPartitions("_part", at)
    return dealt.mapInArrow(walk, schema)
