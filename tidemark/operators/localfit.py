"""Local regression and likelihood in one variable, per key, with an adaptive evaluation structure.

A local polynomial is fitted at vertices and interpolated between them. The bandwidth at a vertex is the distance to the
nearest share ``nn`` of the key's points, ``h`` at least. The tree of vertices starts with the ends of the key's range, and
a cell between two is halved while it is longer than ``cut`` times the smaller of its ends' bandwidths.

Points are packed into blocks of BLOCK of a key; a block meets the key's vertices, some dozens, as one row, and gives its
sums for each, which are added up. So no task holds a key's points, and the work is points times vertices. Order
statistics of distances are found exactly by radix: in each of four rounds blocks count the next 16 bits of the distances
that are still in question. Fits other than Gaussian are rounds of Newton's steps.

Points with a null or non-finite x or y, or a weight that isn't above 0, take no part; a null key is a key. A vertex with
fewer distinct points in its window than the polynomial has terms gets the least-squares solution of least norm.
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

BLOCK = 4096
#: Digits that a task holds before it counts them: two bytes each.
COUNTED = 4_000_000
#: Levels by which a cell is looked at in one round, and rounds at most.
AHEAD, ROUNDS = 4, 6

KERNELS = {
    "tcub": lambda u: (1 - np.abs(u) ** 3) ** 3,
    "epan": lambda u: 1 - u**2,
    "bisq": lambda u: (1 - u**2) ** 2,
    "tria": lambda u: 1 - np.abs(u),
    "trwt": lambda u: (1 - u**2) ** 3,
    "rect": lambda u: np.ones_like(u),
    "gauss": lambda u: np.exp(-((2.5 * u) ** 2) / 2),
}


@dataclass(frozen=True)
class Smooth:
    """family: gaussian (identity), binomial (logit; y counts of w trials) or poisson (log; w exposures)."""

    nn: float = 0.7
    h: float = 0.0
    degree: int = 2
    kernel: str = "tcub"
    family: str = "gaussian"
    cut: float = 0.8

    def weight(self, u: np.ndarray) -> np.ndarray:
        return np.where(np.abs(u) < 1 if self.kernel != "gauss" else True, KERNELS[self.kernel](u), 0.0)

    def mean(self, eta: np.ndarray) -> np.ndarray:
        if self.family == "binomial":
            return 1 / (1 + np.exp(-np.clip(eta, -500, 500)))
        return np.exp(np.clip(eta, -500, 500)) if self.family == "poisson" else eta

    def spread(self, mean: np.ndarray) -> np.ndarray:
        """The slope of the mean by the linear predictor."""
        return {"binomial": lambda: mean * (1 - mean), "poisson": lambda: mean, "gaussian": lambda: np.ones_like(mean)}[self.family]()

    def likelihood(self, eta: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Log likelihood of points, less that of a perfect fit."""
        m = self.mean(eta)
        if self.family == "gaussian":
            return -w * (y - m) ** 2 / 2
        log = lambda a, b: np.where(a > 0, a * np.log(np.maximum(a, 1e-300) / np.maximum(b, 1e-300)), 0.0)
        if self.family == "poisson":
            return -(log(y, w * m) - (y - w * m))
        return -(log(y, w * m) + log(w - y, w * (1 - m)))


def packed(df: DataFrame, keys: list[str], x: str, y: str, w: str | None = None) -> DataFrame:
    """(_k, x, y, w): arrays of at most BLOCK points of a key, written. A large key is spread over many tasks."""
    point = [F.col(c).cast("double") for c in (x, y)] + [F.col(w).cast("double") if w else F.lit(1.0)]
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    rows = df.select(F.to_json(F.struct(*keys)).alias("_k"), *(p.alias(n) for p, n in zip(point, "xyw"))).where(fine(F.col("x")) & fine(F.col("y")) & fine(F.col("w")) & (F.col("w") > 0))
    spread = F.pmod(F.xxhash64("x", "y", F.monotonically_increasing_id()), F.lit(64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def block() -> pa.RecordBatch:
            x, y, w = (np.concatenate(c) for c in zip(*held))
            return pa.RecordBatch.from_pydict({"_k": [key], "x": pa.array([x], pa.list_(pa.float64())), "y": pa.array([y], pa.list_(pa.float64())), "w": pa.array([w], pa.list_(pa.float64()))})

        for batch in batches:
            names = batch.column(0).to_numpy(zero_copy_only=False)
            values = [batch.column(i).to_numpy() for i in (1, 2, 3)]
            starts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]]) if len(names) else []
            for a, b in zip(starts, [*starts[1:], len(names)]):
                if held and names[a] != key:
                    yield block()
                    held = []
                key = names[a]
                for s in range(a, b, BLOCK):
                    held.append([v[s : min(b, s + BLOCK)] for v in values])
                    if sum(len(h[0]) for h in held) >= BLOCK:
                        yield block()
                        held = []
        if held:
            yield block()

    return written(rows.repartition("_k", spread).sortWithinPartitions("_k").mapInArrow(run, "_k string, x array<double>, y array<double>, w array<double>"))


def _at_vertices(blocks: DataFrame, vertices: DataFrame, columns: list[str], prefix: str = "v_") -> DataFrame:
    """Blocks with their key's vertices as arrays; these are a row for each key."""
    arrays = vertices.groupBy("_k").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("s")).select(F.col("_k"), *(F.col(f"s.{c}").alias(f"{prefix}{c}") for c in columns))
    return blocks.join(arrays, "_k")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """The rows of batches, arrays as views of their values."""
    for batch in batches:
        for i in range(batch.num_rows):
            values = [c[i] for c in batch.columns]
            yield [v.values.to_numpy(zero_copy_only=False) if isinstance(v, pa.ListScalar) else v.as_py() for v in values]


def order_statistic(blocks: DataFrame, vertices: DataFrame) -> DataFrame:
    """(_k, v, distance): the ``left``-th least distance of the key's points from each vertex, for (_k, v, left). Distances
    are taken as the bits of doubles, 16 in a round."""
    state = vertices.select("_k", "v", "left", F.lit(0).cast("long").alias("bits"))
    for shift in (48, 32, 16, 0):

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, waiting = {}, 0

            def told() -> Iterator[pa.RecordBatch]:
                for (k, v), digits in held.items():
                    digit, n = np.unique(np.concatenate(digits), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(digit), pa.string()), pa.array(np.full(len(digit), v)), pa.array(digit.astype(np.int32)), pa.array(n)], ["_k", "v", "digit", "n"])

            for k, x, vs, states in _rows(batches):
                for v, bits in zip(vs, states):
                    d = np.abs(x - v).view(np.int64)
                    d = d if shift == 48 else d[(d >> (shift + 16)) == bits >> (shift + 16)]
                    if len(d):
                        held.setdefault((k, v), []).append(((d >> shift) & 0xFFFF).astype(np.uint16))
                        waiting += len(d)
                if waiting >= COUNTED:
                    yield from told()
                    held, waiting = {}, 0
            yield from told()

        met = _at_vertices(blocks.select("_k", "x"), state, ["v", "bits"])
        found = met.select("_k", "x", "v_v", "v_bits").mapInArrow(count, "_k string, v double, digit int, n long").groupBy("_k", "v", "digit").agg(F.sum("n").alias("n"))

        def step(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values("digit")
            left = int(g["left"].iloc[0])
            total = g["n"].cumsum().to_numpy()
            i = min(int(np.searchsorted(total, left)), len(g) - 1)
            bits = int(g["bits"].iloc[0]) | int(g["digit"].iloc[i]) << shift
            return pd.DataFrame({"_k": g["_k"].iloc[:1], "v": g["v"].iloc[:1], "left": [left - int(total[i] - g["n"].iloc[i])], "bits": [bits]})

        # at most 65536 digits of a vertex
        state = written(found.join(state, ["_k", "v"]).groupBy("_k", "v").applyInPandas(step, "_k string, v double, left long, bits long"))
    return state.select("_k", "v", F.expr("bits").alias("bits")).mapInPandas(lambda bs: (b.assign(distance=b["bits"].to_numpy(np.int64).view(np.float64))[["_k", "v", "distance"]] for b in bs), "_k string, v double, distance double")


def bandwidths(blocks: DataFrame, vertices: DataFrame, ranges: DataFrame, smooth: Smooth) -> DataFrame:
    """(_k, v, h) for (_k, v). With ``nn`` of 1 or more it is that many times the largest distance."""
    asked = vertices.join(ranges, "_k")
    if smooth.nn <= 0:
        return asked.select("_k", "v", F.lit(float(smooth.h)).alias("h"))
    if smooth.nn >= 1:
        return asked.select("_k", "v", F.greatest(smooth.nn * F.greatest(F.col("v") - F.col("lo"), F.col("hi") - F.col("v")), F.lit(float(smooth.h))).alias("h"))
    k = F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") * smooth.nn + 1e-9).cast("long"))
    found = order_statistic(blocks, asked.select("_k", "v", k.alias("left")))
    return found.select("_k", "v", F.greatest("distance", F.lit(float(smooth.h))).alias("h"))


def ranges_of(blocks: DataFrame) -> DataFrame:
    return written(blocks.groupBy("_k").agg(F.min(F.array_min("x")).alias("lo"), F.max(F.array_max("x")).alias("hi"), F.sum(F.size("x")).alias("n")))


def grid(ranges: DataFrame, points: int) -> DataFrame:
    """(_k, v): evenly spaced vertices over each key's range."""
    share = F.explode(F.expr(f"sequence(0, {points - 1})"))
    return ranges.select("_k", "lo", "hi", share.alias("i")).select("_k", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / max(1, points - 1)).alias("v")).distinct()


def tree(blocks: DataFrame, ranges: DataFrame, smooth: Smooth) -> DataFrame:
    """(_k, v, h): the vertices of the adaptive structure. A round takes the bandwidths of the next AHEAD halvings of all
    cells that are open, and keeps the vertices that the rule reaches."""
    cells = ranges.select("_k", F.col("lo").alias("a"), F.col("hi").alias("b"), F.lit(None).cast("double").alias("ha"), F.lit(None).cast("double").alias("hb"))
    kept = None
    halves = 2**AHEAD
    schema = "_k string, v double, h double, a double, b double, ha double, hb double"

    def descend(g: pd.DataFrame) -> pd.DataFrame:
        a, b = float(g["a"].iloc[0]), float(g["b"].iloc[0])
        at = {v: h for v, h in zip(g["v"], g["h"])}
        points = [a + (b - a) * i / halves for i in range(halves)] + [b]
        h = [at[p] for p in points]
        out, stack = [], [(0, halves)]
        ends = [(a, h[0]), (b, h[-1])] if pd.isna(g["ha"].iloc[0]) else []
        rows = [(v, x, None, None, None, None) for v, x in dict(ends).items()]
        while stack:
            i, j = stack.pop()
            if points[j] - points[i] > smooth.cut * min(h[i], h[j]) and points[j] > points[i]:
                if j - i == 1:
                    out.append((None, None, points[i], points[j], h[i], h[j]))
                else:
                    m = (i + j) // 2
                    rows.append((points[m], h[m], None, None, None, None))
                    stack += [(i, m), (m, j)]
        return pd.DataFrame([(g["_k"].iloc[0], *r) for r in rows + out], columns=["_k", "v", "h", "a", "b", "ha", "hb"])

    for _ in range(ROUNDS):
        steps = F.explode(F.expr(f"sequence(0, {halves})"))
        laid = cells.select("*", steps.alias("i")).withColumn("v", F.when(F.col("i") == halves, F.col("b")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("i") / halves))
        h = bandwidths(blocks, laid.select("_k", "v").distinct(), ranges, smooth)
        found = written(laid.drop("i").distinct().join(h, ["_k", "v"]).groupBy("_k", "a", "b").applyInPandas(descend, schema))
        own = found.where("v is not null").select("_k", "v", "h")
        kept = own if kept is None else kept.unionByName(own)
        cells = found.where("v is null").select("_k", "a", "b", "ha", "hb")
        if cells.isEmpty():
            break
    return kept


def fit_at(blocks: DataFrame, vertices: DataFrame, smooth: Smooth, steps: int = 25) -> DataFrame:
    """(_k, v, h, value, slope, influence, variance) of the local fits at (_k, v, h). ``influence`` is the fit's slope by
    a response at the vertex of weight 1, ``variance`` that of the fit for a dispersion of 1."""
    p = smooth.degree + 1

    def told(held: dict[tuple, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.string()), pa.array([v for _, v in held], pa.float64()), pa.array(list(held.values()), pa.list_(pa.float64()))], ["_k", "v", "s"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for key, x, y, w, vs, hs, coefs in _rows(batches):
            for v, h, coef in zip(vs, hs, coefs):
                u = (x - v) / h if h > 0 else np.where(x == v, 0.0, np.inf)
                kernel = smooth.weight(u)
                on = kernel > 0
                a = u[on, None] ** np.arange(p)
                mean = smooth.mean(a @ coef)
                k, own = kernel[on], w[on]
                # counts of trials and of exposures stand for themselves, other responses for their means
                error = own * (y[on] - mean) if smooth.family == "gaussian" else y[on] - own * mean
                info = k * own * smooth.spread(mean)
                s = np.concatenate([a.T @ (k * error), (a.T @ (info[:, None] * a)).ravel(), (a.T @ ((info * k)[:, None] * a)).ravel()])
                held[key, v] = held[key, v] + s if (key, v) in held else s
            if len(held) >= 10_000:
                yield told(held)
                held = {}
        yield told(held)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            coefs, moved, values = [], [], []
            for r in b.itertuples(index=False):
                s, old = np.asarray(r.s), np.asarray(r.coef)
                info = s[p : p + p * p].reshape(p, p)
                inverse = np.linalg.pinv(info, rcond=1e-12, hermitian=True)
                step = inverse @ s[:p]
                step = step if smooth.family == "gaussian" else step / max(1.0, np.abs(step).max() / 5)
                new = old + step
                middle = s[p + p * p :].reshape(p, p)
                zero = float(smooth.spread(smooth.mean(new[:1]))[0])
                coefs.append(new)
                moved.append(float(np.abs(step).max()))
                values.append((new[0], new[1] / r.h if p > 1 and r.h > 0 else 0.0, float(smooth.weight(np.zeros(1))[0]) * inverse[0, 0] * zero, float((inverse @ middle @ inverse)[0, 0])))
            v = np.array(values).reshape(len(values), 4)
            yield pd.DataFrame({"_k": b["_k"], "v": b["v"], "h": b["h"], "coef": coefs, "moved": moved, "value": v[:, 0], "slope": v[:, 1], "influence": v[:, 2], "variance": v[:, 3]})

    state = vertices.select("_k", "v", "h", F.array(*[F.lit(0.0)] * p).alias("coef"))
    schema = "_k string, v double, h double, coef array<double>, moved double, value double, slope double, influence double, variance double"
    for _ in range(1 if smooth.family == "gaussian" else steps):
        met = _at_vertices(blocks, state, ["v", "h", "coef"])
        parts = met.select("_k", "x", "y", "w", "v_v", "v_h", "v_coef").mapInArrow(sums, "_k string, v double, s array<double>").select("_k", "v", F.posexplode("s").alias("i", "x"))
        total = parts.groupBy("_k", "v", "i").agg(F.sum("x").alias("x")).groupBy("_k", "v").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda z: z["x"]).alias("s"))
        state = written(total.join(state.select("_k", "v", "h", "coef"), ["_k", "v"]).mapInPandas(solve, schema))
        if smooth.family != "gaussian" and (state.agg(F.max("moved")).first()[0] or 0.0) < 1e-9:
            break
    return state.drop("coef", "moved")


def interpolate(at: np.ndarray, v: np.ndarray, value: np.ndarray, slope: np.ndarray | None = None) -> np.ndarray:
    """Between vertices: cubic by values and slopes; without slopes, for what is above 0, a line of logarithms. Beyond the ends as the end cells."""
    if len(v) == 1:
        return value[0] + (slope[0] * (at - v[0]) if slope is not None else 0.0) + np.zeros_like(at)
    i = np.clip(np.searchsorted(v, at, side="right") - 1, 0, len(v) - 2)
    d = v[i + 1] - v[i]
    t = (at - v[i]) / d
    if slope is None:
        return np.maximum(value[i], 1e-300) ** (1 - t) * np.maximum(value[i + 1], 1e-300) ** t
    return value[i] * (1 + 2 * t) * (1 - t) ** 2 + slope[i] * d * t * (1 - t) ** 2 + value[i + 1] * t**2 * (3 - 2 * t) - slope[i + 1] * d * t**2 * (1 - t)


@dataclass
class Fit:
    """Vertices of all keys (_k, v, h, value, slope, influence, variance), the points, and what was asked for."""

    keys: list[str]
    names: DataFrame
    blocks: DataFrame
    vertices: DataFrame
    smooth: Smooth
    ranges: DataFrame
    halvings: int

    def named(self, df: DataFrame) -> DataFrame:
        return self.names.join(df, "_k").drop("_k")

    def table(self) -> DataFrame:
        """The vertices with the keys' columns; values are linear predictors."""
        return self.named(self.vertices)

    def predict(self, df: DataFrame, x: str, column: str = "fit") -> DataFrame:
        """``df`` with the fit at ``x``: the mean by the family. Rows of unknown keys, or without x, have null."""
        smooth = self.smooth
        arrays = self.vertices.groupBy("_k").agg(F.sort_array(F.collect_list(F.struct("v", "value", "slope"))).alias("_s")).select(F.col("_k").alias("_own"), *(F.col(f"_s.{c}").alias(f"_{c}") for c in ("v", "value", "slope")))
        met = df.withColumn("_k", F.to_json(F.struct(*self.keys))).join(arrays, F.col("_k") == F.col("_own"), "left")

        def run(x: pd.Series, v: pd.Series, value: pd.Series, slope: pd.Series) -> pd.Series:
            out = [None if a is None or pd.isna(b) else float(smooth.mean(interpolate(np.array([b]), np.asarray(a), np.asarray(c), np.asarray(d)))[0]) for b, a, c, d in zip(x, v, value, slope)]
            return pd.Series(out, dtype=object)

        run.__annotations__ = {"x": pd.Series, "v": pd.Series, "value": pd.Series, "slope": pd.Series, "return": pd.Series}
        return met.withColumn(column, F.pandas_udf(run, "double")(F.col(x).cast("double"), "_v", "_value", "_slope")).drop("_k", "_own", "_v", "_value", "_slope")

    def finer(self) -> DataFrame:
        """The vertices and those of ``halvings`` of their cells."""
        if not self.halvings:
            return self.vertices
        cells = self.vertices.groupBy("_k").agg(F.sort_array(F.collect_list("v")).alias("s")).select("_k", F.explode(F.expr("slice(arrays_zip(s, slice(s, 2, size(s))), 1, size(s) - 1)")).alias("c")).select("_k", F.col("c")["s"].alias("a"), F.col("c")["1"].alias("b"))
        between = cells.withColumn("i", F.explode(F.expr(f"sequence(1, {2**self.halvings - 1})"))).select("_k", (F.col("a") + (F.col("b") - F.col("a")) * F.col("i") / 2**self.halvings).alias("v"))
        return self.vertices.unionByName(fit_at(self.blocks, bandwidths(self.blocks, between, self.ranges, self.smooth), self.smooth))

    def criteria(self) -> DataFrame:
        """(keys, n, likelihood, df0, df1, gcv, lcv, aic): df0 and df1 are the traces of H and of H'H, lcv is the deviance
        of points left out, by their influences. Influences and variances bend more than the fit, so they are interpolated
        between vertices with ``halvings`` of each cell besides."""
        smooth = self.smooth

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for k, x, y, w, v, value, slope, fine, influence, variance in _rows(batches):
                eta = interpolate(x, v, value, slope)
                share = w * interpolate(x, fine, influence)
                own = w * smooth.spread(smooth.mean(eta))
                mean = smooth.mean(eta)
                error = y - mean if smooth.family == "gaussian" else (y - w * mean) / np.maximum(own, 1e-300)
                left = eta - error * share / np.maximum(1 - share, 1e-12)
                sums = [float(smooth.likelihood(eta, y, w).sum()), float(share.sum()), float((own * interpolate(x, fine, variance)).sum()), float(smooth.likelihood(left, y, w).sum())]
                yield pa.RecordBatch.from_pydict({"_k": [k], "n": [len(x)]} | {c: [z] for c, z in zip(("likelihood", "df0", "df1", "left"), sums)})

        met = _at_vertices(_at_vertices(self.blocks, self.finer(), ["v", "influence", "variance"], "f_"), self.vertices, ["v", "value", "slope"])
        columns = ["_k", "x", "y", "w", "v_v", "v_value", "v_slope", "f_v", "f_influence", "f_variance"]
        parts = met.select(*columns).mapInArrow(run, "_k string, n long, likelihood double, df0 double, df1 double, left double")
        total = parts.groupBy("_k").agg(*(F.sum(c).alias(c) for c in ("n", "likelihood", "df0", "df1", "left")))
        gcv = F.try_divide(-2 * F.col("n") * F.col("likelihood"), (F.col("n") - F.col("df0")) ** 2)
        return self.named(total.select("_k", "n", "likelihood", "df0", "df1", gcv.alias("gcv"), (-2 * F.col("left")).alias("lcv"), (-2 * F.col("likelihood") + 2 * F.col("df0")).alias("aic")))


def local_fit(df: DataFrame, keys: list[str], x: str, y: str, w: str | None = None, smooth: Smooth = Smooth(), ev: str = "tree", points: int = 50, halvings: int = 3) -> Fit:
    """ev: tree (adaptive), grid (``points`` vertices a key) or data (each distinct x a vertex, for keys of few points)."""
    blocks = packed(df, keys, x, y, w)
    ranges = ranges_of(blocks)
    if ev == "tree":
        vertices = tree(blocks, ranges, smooth)
    else:
        asked = grid(ranges, points) if ev == "grid" else blocks.select("_k", F.explode("x").alias("v")).distinct()
        vertices = bandwidths(blocks, asked, ranges, smooth)
    names = df.select(*keys).distinct().withColumn("_k", F.to_json(F.struct(*keys)))
    return Fit(keys, names, blocks, fit_at(blocks, vertices, smooth), smooth, ranges, 0 if ev == "data" else halvings)
