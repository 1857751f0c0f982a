"""Sorting of event waveforms: detection, alignment, mixtures, cluster quality, outliers and merging.

Waveforms are arrays, a row each. Statistics of clusters are sums over long rows; where a model goes to all tasks it has a
row for each cluster and is refused beyond a stated number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.checkpoints import checkpoint

MOST_CLUSTERS = 10_000
#: Rows of a block that is compared with another at most, and where tables are so small that few tasks would be left.
NEIGHBOUR_BLOCK, NEIGHBOUR_LEAST = 65_536, 4096
#: Blocks at most, on either side, while they have fewer rows than that.
NEIGHBOUR_BLOCKS = 8
#: Distances that are held at once.
NEIGHBOUR_CELLS = 1 << 20
#: Counts of distinct values that a chunk of a rank-sum test has, some.
RANKED = 4096


def detect(df: DataFrame, keep: list[str], samples: str, threshold: Column, before: int, after: int, dead: int, polarity: str = "neg") -> DataFrame:
    """(keep, at, w): waveforms of ``before`` samples and ``after`` from each sample past the threshold on, of which the next
    ``dead`` samples are left out; those that leave the row's samples are dropped. A row is a trial or a chunk.

    polarity: neg, pos, either, or both (the opposite threshold is passed within the waveform too)."""
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("at", T.LongType()), T.StructField("w", T.ArrayType(T.DoubleType()))])
    rows = df.select(*keep, F.col(samples).cast("array<double>").alias("_s"), F.abs(threshold).alias("_t")).where("_s is not null and _t is not null")

    def run(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                x, t = np.asarray(r[-2], float), float(r[-1])
                low, high = x < -t, x > t
                past = {"neg": low, "pos": high, "either": low | high, "both": low}[polarity]
                next_free = -1
                for i in np.flatnonzero(past).tolist():
                    if i <= next_free:
                        continue
                    next_free = i + dead
                    a, e = i - before, i + after
                    if a < 0 or e > len(x) or (polarity == "both" and not high[a:e].any()):
                        continue
                    out.append((*r[: len(keep)], i, x[a:e].tolist()))
            yield pd.DataFrame(out, columns=[*keep, "at", "w"])

    return rows.mapInPandas(run, schema)


def modal_alignment(df: DataFrame, wave: str, by: list[str], side: str = "min") -> DataFrame:
    """Waveforms shifted so that their extreme lies at the most common place of it; ends are repeated. ``shift`` is the move."""
    w = F.col(wave).cast("array<double>")
    top = F.array_position(w, F.array_min(w) if side == "min" else F.array_max(w)).cast("int")
    placed = df.withColumn("_at", top)
    n = placed.groupBy(*by, "_at").count()
    common = n.groupBy(*by).agg(F.max_by("_at", F.struct("count", -F.col("_at"))).alias("_common"))
    placed = placed.join(common, by) if by else placed.join(F.broadcast(common))  # one row
    shift = F.col("_at") - F.col("_common")
    size = F.size(wave)
    moved = F.transform(F.sequence(F.lit(1), size), lambda i: F.element_at(F.col(wave), F.least(F.greatest(i + F.col("_at") - F.col("_common"), F.lit(1)), size)))
    return placed.withColumn(wave, moved).withColumn("shift", shift).drop("_at", "_common")


def mixture(df: DataFrame, features: str, ks: list[int], seed: int = 1) -> DataFrame:
    """Adds ``cluster`` and ``probability`` of the Gaussian mixture whose number of components has the least Bayesian
    information criterion."""
    v = df.withColumn("_v", array_to_vector(F.col(features).cast("array<double>"))).persist()
    n, d = v.count(), len(v.select(features).first()[0])
    best = None
    for k in ks:
        model = GaussianMixture(k=k, seed=seed, featuresCol="_v", predictionCol="cluster", probabilityCol="_p").fit(v)
        score = -2 * model.summary.logLikelihood + (k - 1 + k * d + k * d * (d + 1) / 2) * np.log(n)
        if best is None or score < best[0]:
            best = (score, model)
    v.unpersist()
    return best[1].transform(v).withColumn("probability", F.array_max(vector_to_array("_p"))).drop("_v", "_p")


def _shapes(df: DataFrame, features: str, cluster: str) -> dict:
    """Mean and covariance of each cluster, from sums of products."""
    v = df.withColumn("_v", array_to_vector(F.col(features).cast("array<double>")))
    long = df.select(F.col(cluster).alias("c"), F.col(features).cast("array<double>").alias("x")).where("x is not null")
    means = v.groupBy(F.col(cluster).alias("c")).agg(Summarizer.mean(F.col("_v")).alias("m"), F.count(F.lit(1)).alias("n"))
    if (k := means.count()) > MOST_CLUSTERS:
        raise ValueError(f"{k} clusters: more than {MOST_CLUSTERS}")
    rows = {r.c: (np.array(r.m), r.n) for r in means.collect()}

    def products(batches):
        for b in batches:
            for c, g in b.groupby("c", dropna=False):
                x = np.stack(g["x"].to_numpy()).astype(float) - rows[c][0]
                yield pd.DataFrame({"c": [c], "s": [(x.T @ x).ravel().tolist()]})

    kind = df.schema[cluster].dataType.simpleString()
    parts = long.mapInPandas(products, f"c {kind}, s array<double>")
    sums = parts.select("c", F.posexplode("s").alias("k", "v")).groupBy("c", "k").agg(F.sum("v").alias("v")).groupBy("c").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("s"))
    out = {}
    for r in sums.collect():
        m, n = rows[r.c]
        out[r.c] = (m, np.array([x.v for x in r.s]).reshape(len(m), len(m)) / max(1, n - 1), n)
    return out


def mahalanobis(df: DataFrame, features: str, cluster: str) -> DataFrame:
    """Adds ``distance``: squared Mahalanobis distance to the row's own cluster."""
    shapes = {c: (m, np.linalg.pinv(s, hermitian=True)) for c, (m, s, _) in _shapes(df, features, cluster).items()}
    sent = df.sparkSession.sparkContext.broadcast(shapes)  # MOST_CLUSTERS at most

    def batch(x: pd.Series, c: pd.Series) -> pd.Series:
        out = np.full(len(x), np.nan)
        known = x.notna().to_numpy()
        for k, rows in c.groupby(c).indices.items():
            rows = rows[known[rows]]
            if k in sent.value and len(rows):
                m, s = sent.value[k]
                d = np.stack(x.iloc[rows].to_numpy()).astype(float) - m
                out[rows] = np.einsum("ij,jk,ik->i", d, s, d, optimize=True)
        return pd.Series(out)

    batch.__annotations__ = {"x": pd.Series, "c": pd.Series, "return": pd.Series}
    return df.withColumn("distance", F.pandas_udf(batch, "double")(F.col(features).cast("array<double>"), F.col(cluster)))


def without_outliers(df: DataFrame, features: str, cluster: str, p: float = 0.999) -> DataFrame:
    """Rows within the chi-square quantile p of their own cluster."""
    from tidemark.functions.distributions import chi_square_quantile

    return mahalanobis(df, features, cluster).where(F.col("distance") <= chi_square_quantile(F.lit(p), F.size(features))).drop("distance")


def gaussian_overlap(df: DataFrame, features: str, cluster: str) -> DataFrame:
    """(a, b, false_positive, false_negative) for each ordered pair of clusters, from the Gaussians fitted to them: the mean
    probability that rows of a belong to b, and that rows of b belong to a. Rows give their sums of posteriors in part."""
    shapes = _shapes(df, features, cluster)
    names = sorted(shapes)
    sent = df.sparkSession.sparkContext.broadcast([(shapes[c][0], np.linalg.pinv(shapes[c][1] + 1e-9 * np.eye(len(shapes[c][0])), hermitian=True), np.linalg.slogdet(shapes[c][1] + 1e-9 * np.eye(len(shapes[c][0])))[1], shapes[c][2]) for c in names])
    kind = df.schema[cluster].dataType.simpleString()

    def run(batches):
        for g in batches:
            if not len(g):
                continue
            x = np.stack(g["x"].to_numpy()).astype(float)
            logs = np.stack([np.log(n) - 0.5 * (det + np.einsum("ij,jk,ik->i", x - m, s, x - m)) for m, s, det, n in sent.value], axis=1)
            p = np.exp(logs - logs.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            part = pd.DataFrame(p).groupby(g["c"].to_numpy()).sum()
            yield pd.DataFrame({"a": np.repeat(part.index.to_numpy(), len(names)), "b": names * len(part), "p": part.to_numpy().ravel()})

    rows = df.select(F.col(cluster).alias("c"), F.col(features).cast("array<double>").alias("x")).where("c is not null and x is not null")
    sums = rows.mapInPandas(run, f"a {kind}, b {kind}, p double").groupBy("a", "b").agg(F.sum("p").alias("p"))
    size = rows.groupBy(F.col("c").alias("a")).agg(F.count(F.lit(1)).alias("n"))
    of = sums.join(size, "a")
    back = of.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("p").alias("q"))
    return of.join(back, ["a", "b"]).where("a != b").select("a", "b", (F.col("p") / F.col("n")).alias("false_positive"), (F.col("q") / F.col("n")).alias("false_negative"))


def refractory_share(df: DataFrame, at: str, by: list[str], unit: float, bins: int = 3) -> DataFrame:
    """(by, percent, single): percent of events whose interval to the last one lies in the first ``bins`` units, over the
    number of events; a single unit has three percent at most."""
    gap = F.col(at) - F.lag(at).over(Window.partitionBy(*by).orderBy(at))
    out = df.withColumn("_g", gap).groupBy(*by).agg((100.0 * F.coalesce(F.sum(F.when(F.col("_g") < bins * unit, 1)), F.lit(0)) / F.count(F.lit(1))).alias("percent"))
    return out.withColumn("single", F.col("percent") <= 3)


def missed_share(df: DataFrame, height: str, by: list[str], threshold: float) -> DataFrame:
    """(by, missed): share of a normal distribution of heights that lies under the detection threshold."""
    from tidemark.functions.distributions import normal_p

    m = df.groupBy(*by).agg(F.avg(height).alias("_m"), F.stddev_samp(height).alias("_s"))
    return m.select(*by, F.coalesce(normal_p(F.try_divide(F.lit(float(threshold)) - F.col("_m"), F.col("_s"))), F.lit(0.0)).alias("missed"))


def censored_share(df: DataFrame, at: str, by: list[str], dead: float, span: float) -> DataFrame:
    """(by, censored): share of the time that other units' detections keep blind, dead time times their rate."""
    n = df.groupBy(*by[:-1], by[-1]).agg(F.count(at).alias("n"))
    rest = by[:-1]
    total = n.groupBy(*rest).agg(F.sum("n").alias("_all"))
    both = n.join(total, rest) if rest else n.join(F.broadcast(total))  # one row
    return both.select(*by, F.least(F.lit(1.0), (F.col("_all") - F.col("n")) * dead / span).alias("censored"))


def nearest_quality(df: DataFrame, key: str, features: str, cluster: str, k: int = 10, block: int | None = None) -> DataFrame:
    """(cluster, false_positive, false_negative): of a cluster's rows, the mean share of their k nearest neighbours that
    belong to another; and the neighbours in it of other clusters' rows, as shares summed, over its own rows. Every row is
    compared with all rows of other keys, exactly: blocks of rows with blocks, whose k nearest are then merged. Ties go by
    key. A row is moved once for each block, with its values as they are: up to NEIGHBOUR_BLOCKS times while blocks can
    grow, and by one more time for each NEIGHBOUR_BLOCK rows beyond that. ``block`` sets their size."""
    single = isinstance(kind := df.schema[features].dataType, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    rows = df.select(F.col(key).alias("key"), F.col(features).cast("array<float>" if single else "array<double>").alias("x"), F.col(cluster).alias("c")).where("c is not null and x is not null")
    rows = checkpoint(rows.withColumn("row", F.monotonically_increasing_id()))  # the numbers must not change
    sizes = rows.groupBy("c").count()
    all_rows = rows.count()
    n = max(1, -(-all_rows // block) if block else max(min(NEIGHBOUR_BLOCKS, -(-all_rows // NEIGHBOUR_LEAST)), -(-all_rows // NEIGHBOUR_BLOCK)))
    own, each = F.pmod(F.xxhash64("row"), F.lit(n)), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = rows.select("row", "key", "x", own.alias("q"), each.alias("r")).groupBy("q", "r")
    given = rows.select("key", "x", "c", own.alias("r"), each.alias("q")).groupBy("q", "r")
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("d", T.DoubleType()), T.StructField("key", df.schema[key].dataType), T.StructField("c", df.schema[cluster].dataType)])

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"row": [], "d": [], "key": [], "c": []})
        b = b.sort_values("key", kind="stable")
        points, keys = np.stack(b["x"].to_numpy()).astype(float), b["key"].to_numpy()
        middle = points.mean(axis=0)
        shifted = points - middle
        norm = (shifted**2).sum(axis=1)
        out_row, out_d, out_at = [], [], []
        step = max(1, min(256, NEIGHBOUR_CELLS // len(b)))
        for start in range(0, len(a), step):
            part = a.iloc[start : start + step]
            x = np.stack(part["x"].to_numpy()).astype(float)
            y = x - middle
            size = (y**2).sum(axis=1)
            d = size[:, None] + norm[None, :] - 2 * y @ shifted.T
            d[part["key"].to_numpy()[:, None] == keys[None, :]] = np.inf
            m = min(k, d.shape[1])
            # what rounding may have put beyond the k-th is measured too; then differences decide
            limit = np.partition(d, m - 1, axis=1)[:, m - 1] + 1e-9 * (size + norm.max())
            for i, row in enumerate(part["row"].to_numpy()):
                at = np.flatnonzero((d[i] <= limit[i]) & (d[i] < np.inf))
                exact = ((points[at] - x[i]) ** 2).sum(axis=1)
                best = np.argsort(exact, kind="stable")[:k]
                out_row.append(np.full(len(best), row)), out_d.append(exact[best]), out_at.append(at[best])
        at = np.concatenate(out_at)
        return pd.DataFrame({"row": np.concatenate(out_row), "d": np.concatenate(out_d), "key": keys[at], "c": b["c"].to_numpy()[at]})

    found = asked.cogroup(given).applyInPandas(nearest, schema)
    near = found.groupBy("row").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "key", "c"))), 1, k).alias("near"))
    shares = rows.select("row", F.col("c").alias("a")).join(near, "row").select("a", F.explode("near.c").alias("b"), (1 / F.size("near")).alias("p"))
    sums = shares.groupBy("a", "b").agg(F.sum("p").alias("p"))
    out = sums.where("a != b").groupBy(F.col("a").alias("c")).agg(F.sum("p").alias("fp"))
    into = sums.where("a != b").groupBy(F.col("b").alias("c")).agg(F.sum("p").alias("fn"))
    both = sizes.join(out, "c", "left").join(into, "c", "left")
    return both.select(F.col("c").alias("cluster"), (F.coalesce("fp", F.lit(0.0)) / F.col("count")).alias("false_positive"), (F.coalesce("fn", F.lit(0.0)) / F.col("count")).alias("false_negative"))


def rank_sum(df: DataFrame, value: str, group: str, by: list[str]) -> DataFrame:
    """(by, a, b, z) of each pair of groups a < b: normal approximation of the rank-sum test, ties averaged.

    The counts of distinct values are sorted once, by ranges, and tasks read them in chunks. A chunk gives each pair's wins
    within it, value over value and half of ties, and its groups' counts; what a chunk's rows win over the chunks before
    are products of counts. So no task holds a pair's values, and a value is moved once, not once a pair. Rows without a
    value, a group or a key take no part."""
    fine = F.col(value).isNotNull() & F.col(group).isNotNull()
    for k in by:
        fine = fine & F.col(k).isNotNull()
    keys = [f"k{i}" for i in range(len(by))]
    named = [F.col(c).alias(k) for c, k in zip(by, keys)]
    counts = df.where(fine).groupBy(*named, F.col(group).alias("g"), F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.repartitionByRange(*keys, "v").sortWithinPartitions(*keys, "v")
    kept = [*(counts.schema[k] for k in keys), T.StructField("part", T.IntegerType()), T.StructField("chunk", T.IntegerType())]
    kind = counts.schema["g"].dataType
    schema = T.StructType([*kept, T.StructField("a", kind), T.StructField("b", kind), T.StructField("u", T.DoubleType()), T.StructField("n", T.LongType())])

    def wins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), -1
        for rows in _chunks(batches, keys, RANKED):
            at += 1
            groups = rows.column("g").combine_chunks().dictionary_encode()
            names, g = groups.dictionary, groups.indices.to_numpy()
            n = np.zeros((len(names), len(rows)))
            n[g, _codes(rows.column("v"))] = rows.column("n").to_numpy()
            u = n @ (np.cumsum(n, axis=1) - n / 2).T
            i, j = np.nonzero(~np.eye(len(names), dtype=bool))
            own = len(names)
            head = [pa.array([rows.column(k)[0].as_py()] * (own + len(i)), rows.schema.field(k).type) for k in keys]
            a = pa.concat_arrays([names, names.take(pa.array(i))])
            b = pa.concat_arrays([pa.nulls(own, names.type), names.take(pa.array(j))])
            yield pa.RecordBatch.from_arrays([*head, pa.array(np.full(len(a), part, np.int32)), pa.array(np.full(len(a), at, np.int32)), a, b, pa.array(np.r_[np.zeros(own), u[i, j]]), pa.array(np.r_[n.sum(axis=1), np.zeros(len(i))].astype(np.int64))], schema.names)

    found = checkpoint(counts.mapInArrow(wins, schema))
    own = found.where("b is null").select(*keys, "part", "chunk", F.col("a").alias("g"), "n")
    before = Window.partitionBy(*keys, "g").orderBy("part", "chunk")
    # what a chunk of a has over the chunks of b before: counts up to each chunk, of those groups too that have none in it
    steps = own.select(*keys, "part", "chunk").distinct()
    groups = own.groupBy(*keys, "g").agg(F.sum("n").alias("total"))
    grid = steps.join(groups, keys) if keys else steps.crossJoin(groups)
    grid = grid.join(own, [*keys, "part", "chunk", "g"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    grid = grid.withColumn("prior", F.sum("n").over(before) - F.col("n"))
    first = grid.where("n > 0").select(*keys, "part", "chunk", F.col("g").alias("a"), F.col("n").alias("na"))
    second = grid.where("prior > 0").select(*keys, "part", "chunk", F.col("g").alias("b"), "prior")
    later = first.join(second, [*keys, "part", "chunk"]).where("a < b").select(*keys, "a", "b", (F.col("na").cast("double") * F.col("prior")).alias("u"))
    u = found.where("b is not null and a < b").select(*keys, "a", "b", "u").unionByName(later).groupBy(*keys, "a", "b").agg(F.sum("u").alias("u"))
    pairs = [groups.select(*keys, F.col("g").alias(c), F.col("total").alias(m)) for c, m in (("a", "n"), ("b", "m"))]
    pairs = pairs[0].join(pairs[1], keys) if keys else pairs[0].crossJoin(pairs[1])
    s = pairs.where("a < b").join(u, [*keys, "a", "b"], "left")
    mean, spread = F.col("n") * F.col("m") / 2.0, F.sqrt(F.col("n") * F.col("m") * (F.col("n") + F.col("m") + 1) / 12.0)
    return s.select(*(F.col(k).alias(c) for k, c in zip(keys, by)), "a", "b", F.coalesce(F.try_divide(F.coalesce("u", F.lit(0.0)) - mean, spread), F.lit(0.0)).alias("z"))


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers of the values of a sorted column, equal ones alike; NaN equals NaN."""
    x = column.to_numpy()
    same = (x[1:] == x[:-1]) | ((x[1:] != x[1:]) & (x[:-1] != x[:-1]))
    return np.r_[0, np.cumsum(~same.astype(bool))]


def _chunks(batches: Iterator[pa.RecordBatch], keys: list[str], most: int) -> Iterator[pa.Table]:
    """Sorted rows of one key in tables of some ``most`` rows, cut between values."""

    def cut(rows: pa.Table, last: bool) -> Iterator[pa.Table | None]:
        while len(rows):
            differs = np.zeros(len(rows) - 1, bool)
            for k in keys:
                differs |= np.diff(_codes(rows.column(k))) > 0
            ends = np.flatnonzero(differs) + 1
            end = int(ends[0]) if len(ends) else len(rows)
            if end > most:
                steps = np.flatnonzero(np.diff(_codes(rows.column("v").slice(0, end)))) + 1
                if len(steps := steps[steps >= most]):
                    end = int(steps[0])
            if end == len(rows) and not last:
                break
            yield rows.slice(0, end)
            rows = rows.slice(end)
        left.append(rows)

    left: list[pa.Table] = []
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([left.pop(), rows]).combine_chunks() if left else rows
        yield from cut(rows, False)
    if left:
        yield from cut(left.pop(), True)

