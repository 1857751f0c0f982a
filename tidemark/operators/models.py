"""Linear and robust models, resampling and fits.

Linear models add up their normal equations in Spark, so a group of any size ends as one row of sums; only those are solved
in Arrow batches. Robust and nonlinear fits need a group's points together: they are for groups of bounded size (a voxel's
volumes, a channel's conditions), and say so.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.distributions import gamma_pdf, norm_cdf, norm_inv


def haemodynamic(tr: float, length: float = 32.0, peak: float = 5.0, under: float = 15.0, ratio: float = 6.0) -> list[float]:
    """Two-gamma response sampled every ``tr`` seconds, with sum 1."""
    t = np.arange(0, length + tr / 2, tr)
    h = gamma_pdf(t, peak + 1) - gamma_pdf(t, under + 1) / ratio
    return (h / h.sum()).tolist()


def design(onsets: DataFrame, run: str, predictor: str, on: str, off: str, volumes: int, response: list[float], weight: str | None = None) -> DataFrame:
    """(run, predictor, volume, x): boxcars of [on, off) volumes, weighted, convolved with the response; zeros are left
    out. Each onset gives its own volumes, and sums meet in one aggregate."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    box = onsets.where(F.col(off) > F.col(on)).select(run, predictor, F.explode(F.sequence(F.col(on).cast("long"), F.col(off).cast("long") - 1)).alias("_v"), w.alias("_w"))
    h = F.posexplode(F.array(*map(F.lit, response))).alias("_k", "_h")
    spread = box.select(run, predictor, "_v", "_w", h).withColumn("volume", F.col("_v") + F.col("_k")).where((F.col("volume") >= 0) & (F.col("volume") < volumes))
    return spread.groupBy(run, predictor, "volume").agg(F.sum(F.col("_w") * F.col("_h")).alias("x"))


def impulse_columns(onsets: DataFrame, run: str, predictor: str, on: str, lags: int) -> DataFrame:
    """(run, predictor, lag, volume, x): one column for each lag after an onset."""
    each = onsets.select(run, predictor, F.col(on).cast("long").alias("_v"), F.explode(F.sequence(F.lit(0), F.lit(lags - 1))).alias("lag"))
    return each.groupBy(run, predictor, "lag", (F.col("_v") + F.col("lag")).alias("volume")).agg(F.count(F.lit(1)).cast("double").alias("x"))


def _sums(y: str, xs: list[str]) -> list[Column]:
    cols = [*map(F.col, xs), F.col(y)]
    return [F.sum(a * b) for i, a in enumerate(cols) for b in cols[i:]]


def linear(df: DataFrame, y: str, xs: list[str], by: list[str], contrast: list[float] | None = None) -> DataFrame:
    """(by, betas, se, dof, r2, t) of least squares on the given columns (add a constant column for an intercept). t is of
    the contrast, or of the last column. Rows with a null are left out; singular designs use the least-norm solution."""
    xs = list(xs)
    k, c = len(xs), contrast or [0.0] * (len(xs) - 1) + [1.0]
    clean = df.select(*by, *(F.col(x).cast("double").alias(f"_x{i}") for i, x in enumerate(xs)), F.col(y).cast("double").alias("_y")).dropna(subset=[*(f"_x{i}" for i in range(k)), "_y"])
    sums = clean.groupBy(*by).agg(F.array(*_sums("_y", [f"_x{i}" for i in range(k)])).alias("_s"), F.count(F.lit(1)).alias("_n"), F.sum("_y").alias("_sy"))

    def solve(s: pd.Series, n: pd.Series, sy: pd.Series) -> pd.DataFrame:
        out = []
        upper = np.triu_indices(k + 1)
        for v, m, total in zip(s, n, sy):
            g = np.zeros((k + 1, k + 1))
            g[upper] = np.asarray(v, float)
            g = g + np.triu(g, 1).T
            inverse = np.linalg.pinv(g[:k, :k], hermitian=True)
            b = inverse @ g[:k, k]
            rest = max(0.0, g[k, k] - b @ g[:k, k])
            dof = int(m) - np.linalg.matrix_rank(g[:k, :k])
            var = rest / dof if dof > 0 else np.nan
            spread = g[k, k] - total * total / m
            se = np.sqrt(np.maximum(0, np.diag(inverse)) * var)
            e = math.sqrt(max(0.0, float(np.array(c) @ inverse @ np.array(c)) * var)) if dof > 0 else np.nan
            t = float(np.array(c) @ b) / e if e and e == e else 0.0
            out.append((b.tolist(), se.tolist(), dof, 1 - rest / spread if spread > 0 else 0.0, t))
        return pd.DataFrame(out, columns=["betas", "se", "dof", "r2", "t"])

    solve.__annotations__ = {"s": pd.Series, "n": pd.Series, "sy": pd.Series, "return": pd.DataFrame}
    fit = F.pandas_udf(solve, "betas array<double>, se array<double>, dof long, r2 double, t double")
    return sums.select(*by, fit("_s", "_n", "_sy").alias("_f")).select(*by, "_f.*")


def prewhitened(df: DataFrame, y: str, xs: list[str], by: list[str], order: str, step: float = 0.05) -> DataFrame:
    """Columns y and xs less rho times those of the row before, rho being the lag-one correlation of the least-squares
    residuals of each group, rounded to ``step``; the first row of a group goes."""
    fits = linear(df, y, xs, by).select(*by, "betas")
    w = Window.partitionBy(*by).orderBy(order)
    fitted = F.lit(0.0)
    for i, x in enumerate(xs):
        fitted = fitted + F.col(x) * F.col("betas")[i]
    r = df.join(fits, by).withColumn("_r", F.col(y) - fitted).withColumn("_q", F.lag("_r").over(w))
    rho = r.groupBy(*by).agg((F.round(F.coalesce(F.try_divide(F.sum(F.col("_r") * F.col("_q")), F.sum(F.col("_q") * F.col("_q"))), F.lit(0.0)) / step) * step).alias("rho"))
    out = df.join(rho, by)
    return out.select(*by, order, "rho", *((F.col(c) - F.col("rho") * F.lag(c).over(w)).alias(c) for c in (y, *xs))).where(F.col(y).isNotNull())


def bisquare(x: np.ndarray, y: np.ndarray, tune: float = 4.685, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and weights of a robust fit with bisquare weights; the scale is the median absolute residual / 0.6745
    without the p smallest ones, and leverage is taken out."""
    n, p = x.shape
    h = np.minimum(0.9999, np.einsum("ij,ji->i", x, np.linalg.pinv(x)))
    adjust, w = 1 / np.sqrt(1 - h), np.ones(n)
    least = 1e-6 * (y.std() or 1.0)
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    for _ in range(rounds):
        r = (y - x @ b) * adjust
        s = np.sort(np.abs(r))[max(0, p - 1) :]
        u = r / (max(float(np.median(s)) / 0.6745, least) * tune)
        w = np.where(np.abs(u) < 1, (1 - u * u) ** 2, 0.0)
        new = np.linalg.lstsq(x * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
        if np.all(np.abs(new - b) <= 1e-8 * np.maximum(np.abs(new), np.abs(b)) + 1e-14):
            return new, w
        b = new
    return b, w


def robust(df: DataFrame, y: str, xs: list[str], by: list[str]) -> DataFrame:
    """(by, betas, weight): robust fits of groups of bounded size; ``weight`` is the mean weight of the group's rows. With
    xs = [a constant column] it is a robust mean."""
    part = df.select(*by, *(F.col(x).cast("double").alias(x) for x in xs), F.col(y).cast("double").alias("_y")).dropna(subset=[*xs, "_y"])
    schema = ", ".join([*(f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by), "betas array<double>", "weight double"])

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        b, w = bisquare(group[xs].to_numpy(float), group["_y"].to_numpy(float))
        return pd.DataFrame([[*(group[k].iloc[0] for k in by), b.tolist(), float(w.mean())]], columns=[*by, "betas", "weight"])

    return part.groupBy(*by).applyInPandas(fit, schema)


def _poisson(uniform: Column) -> Column:
    """A Poisson variate of mean 1 from a uniform one: cut points of its distribution."""
    cuts, total, p = [], 0.0, math.exp(-1)
    for k in range(9):
        total += p
        cuts.append(total)
        p /= k + 1
    out = F.lit(0)
    for c in cuts:
        out = out + F.when(uniform > c, 1).otherwise(0)
    return out


def bootstrap_mean(df: DataFrame, value: str, row_id: str, by: list[str], rounds: int = 200, level: float = 0.05, seed: int = 1, corrected: bool = False) -> DataFrame:
    """(by, mean, low, high): percentile interval of the mean, or the bias-corrected and accelerated one.

    Each row draws its weight of each round from a hash of its id, so rounds need no resampled copies, are the same
    wherever the row lies, and add up in partial sums."""
    u = F.pmod(F.xxhash64(F.col(row_id), F.col("round"), F.lit(seed)), F.lit(1 << 40)).cast("double") / float(1 << 40)
    rows = df.where(F.col(value).isNotNull())
    each = rows.select(*by, F.col(value).cast("double").alias("_v"), row_id, F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")).withColumn("_w", _poisson(u))
    means = each.groupBy(*by, "round").agg(F.try_divide(F.sum(F.col("_w") * F.col("_v")), F.sum("_w").cast("double")).alias("_m")).where("_m is not null")
    whole = rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.skewness(value).alias("_skew"), F.count(F.lit(1)).alias("_n"))
    packed = means.groupBy(*by).agg(F.sort_array(F.collect_list("_m")).alias("_all"))  # ``rounds`` numbers

    def ends(drawn: pd.Series, mean: pd.Series, skew: pd.Series, n: pd.Series) -> pd.DataFrame:
        out = []
        for v, m, g, k in zip(drawn, mean, skew, n):
            v = np.asarray(v, float)
            p = np.array([level / 2, 1 - level / 2])
            if corrected and len(v):
                share = np.clip((v < m).mean(), 0.5 / len(v), 1 - 0.5 / len(v))
                z0, a = float(norm_inv(np.array([share]))[0]), (g if g == g and g is not None else 0.0) / (6 * math.sqrt(max(1, k)))
                z = norm_inv(p)
                p = norm_cdf(z0 + (z0 + z) / (1 - a * (z0 + z)))
            out.append(np.quantile(v, p) if len(v) else (np.nan, np.nan))
        return pd.DataFrame(out, columns=["low", "high"])

    ends.__annotations__ = {x: pd.Series for x in ("drawn", "mean", "skew", "n")} | {"return": pd.DataFrame}
    joined = whole.join(packed, by) if by else whole.join(F.broadcast(packed))  # one row on each side
    return joined.select(*by, "mean", F.pandas_udf(ends, "low double, high double")("_all", "mean", "_skew", "_n").alias("_e")).select(*by, "mean", "_e.low", "_e.high")


def sign_permutation(df: DataFrame, value: str, row_id: str, by: list[str], rounds: int = 500, seed: int = 1) -> DataFrame:
    """(by, p): share of seeded sign flips whose mean lies below the observed one, ties half, kept 0.5 / rounds off the ends."""
    sign = F.when(F.xxhash64(F.col(row_id), F.col("round"), F.lit(seed)) % 2 == 0, 1.0).otherwise(-1.0)
    rows = df.where(F.col(value).isNotNull())
    sums = rows.select(*by, F.col(value).cast("double").alias("_v"), row_id, F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")).groupBy(*by, "round").agg(F.sum(sign * F.col("_v")).alias("_s"), F.sum("_v").alias("_t"))
    won = F.when(F.abs(F.col("_t") - F.col("_s")) < 1e-12, 0.5).when(F.col("_t") > F.col("_s"), 1.0).otherwise(0.0)
    edge = 0.5 / rounds
    return sums.groupBy(*by).agg(F.greatest(F.lit(edge), F.least(F.lit(1 - edge), F.avg(won))).alias("p"))


def mediation(df: DataFrame, x: str, m: str, y: str, by: list[str]) -> DataFrame:
    """(by, a, b, direct, indirect, z): paths x to m and m to y beside x, and the Sobel test of their product."""
    one = df.withColumn("_one", F.lit(1.0))
    first = linear(one, m, ["_one", x], by).select(*by, F.col("betas")[1].alias("a"), F.col("se")[1].alias("sa"))
    second = linear(one, y, ["_one", x, m], by).select(*by, F.col("betas")[1].alias("direct"), F.col("betas")[2].alias("b"), F.col("se")[2].alias("sb"))
    both = first.join(second, by) if by else first.join(F.broadcast(second))  # one row on each side
    spread = F.sqrt(F.col("a") ** 2 * F.col("sb") ** 2 + F.col("b") ** 2 * F.col("sa") ** 2)
    return both.select(*by, "a", "b", "direct", (F.col("a") * F.col("b")).alias("indirect"), F.try_divide(F.col("a") * F.col("b"), spread).alias("z"))


def intraclass(df: DataFrame, value: str, subject: str, by: list[str]) -> DataFrame:
    """(by, icc): one-way intraclass correlation of subjects with k values each on average."""
    s = df.where(F.col(value).isNotNull()).groupBy(*by, subject).agg(F.count(value).alias("k"), F.avg(value).alias("m"), F.coalesce(F.var_pop(value) * F.count(value), F.lit(0.0)).alias("w"))
    t = s.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("nk"), F.sum("w").alias("within"), (F.sum(F.col("k") * F.col("m") ** 2) - F.sum(F.col("k") * F.col("m")) ** 2 / F.sum("k")).alias("between"))
    msb, msw, k = F.try_divide(F.col("between"), F.col("n") - 1), F.try_divide(F.col("within"), F.col("nk") - F.col("n")), F.col("nk") / F.col("n")
    return t.select(*by, F.try_divide(msb - msw, msb + (k - 1) * msw).alias("icc"))


def _levenberg(f, start: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Damped least squares of the residuals f(p) within bounds, with differences for slopes."""
    p, damp = np.clip(start, low, high), 1e-2
    r = f(p)
    for _ in range(rounds):
        h = 1e-6 * np.maximum(1e-3, np.abs(p))
        j = np.stack([(f(p + np.eye(len(p))[k] * h[k]) - r) / h[k] for k in range(len(p))], axis=1)
        g = j.T @ j
        new = np.clip(p - np.linalg.solve(g + damp * np.diag(np.diag(g) + 1e-12), j.T @ r), low, high)
        q = f(new)
        if q @ q < r @ r:
            if r @ r - q @ q < 1e-12 * (r @ r):
                return new
            p, r, damp = new, q, max(1e-12, damp / 5)
        else:
            damp *= 4
            if damp > 1e12:
                break
    return p


def _fits(df: DataFrame, x: str, y: str, by: list[str], names: list[str], one) -> DataFrame:
    """(by, names): ``one(x, y)`` of each group; groups are averaged by x first, so their size is the number of stimuli."""
    points = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(x).cast("double").alias("_x")).agg(F.avg(F.col(y).cast("double")).alias("_y"), F.count(F.lit(1)).alias("_n"))
    schema = ", ".join([*(f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by), *(f"{n} double" for n in names)])

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_x")
        values = one(group["_x"].to_numpy(float), group["_y"].to_numpy(float), group["_n"].to_numpy(float))
        return pd.DataFrame([[*(group[k].iloc[0] for k in by), *map(float, values)]], columns=[*by, *names])

    return points.groupBy(*by).applyInPandas(fit, schema)


def gaussian_tuning(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by, height, centre, width, base, r2) of height exp(-(x - centre)^2 / (2 width^2)) + base, within the range of x."""

    def one(u, v, n):
        span = max(float(np.ptp(u)), 1e-9)
        low, high = np.array([0.0, u.min(), span / (4 * max(1, len(u))), -np.inf]), np.array([np.inf, u.max(), 2 * span, np.inf])
        curve = lambda p: p[0] * np.exp(-((u - p[1]) ** 2) / (2 * p[2] ** 2)) + p[3]
        best = min((_levenberg(lambda p: (curve(p) - v) * np.sqrt(n), np.array([np.ptp(v), c, w, v.min()]), low, high) for c in (u[v.argmax()], (u * n).sum() / n.sum()) for w in (span / 8, span / 3)), key=lambda p: float((n * (curve(p) - v) ** 2).sum()))
        total = (n * (v - (v * n).sum() / n.sum()) ** 2).sum()
        return (*best, 1 - (n * (curve(best) - v) ** 2).sum() / total if total > 0 else 0.0)

    return _fits(df, x, y, by, ["height", "centre", "width", "base", "r2"], one)


def weibull_fit(df: DataFrame, x: str, y: str, by: list[str], guess: float = 0.5) -> DataFrame:
    """(by, scale, shape, lapse, r2) of guess + (1 - guess - lapse) (1 - exp(-(x / scale)^shape))."""

    def one(u, v, n):
        curve = lambda p: guess + (1 - guess - p[2]) * (1 - np.exp(-((np.maximum(u, 0) / p[0]) ** p[1])))
        top = max(float(u.max()), 1e-9)
        starts = [np.array([s, k, 0.02]) for s in (top / 4, top / 2) for k in (1.0, 3.0)]
        best = min((_levenberg(lambda p: (curve(p) - v) * np.sqrt(n), s, np.array([top * 1e-3, 0.1, 0.0]), np.array([top * 10, 20.0, 0.2])) for s in starts), key=lambda p: float((n * (curve(p) - v) ** 2).sum()))
        total = (n * (v - (v * n).sum() / n.sum()) ** 2).sum()
        return (*best, 1 - (n * (curve(best) - v) ** 2).sum() / total if total > 0 else 0.0)

    return _fits(df, x, y, by, ["scale", "shape", "lapse", "r2"], one)


def logistic_fit(df: DataFrame, x: str, y: str, by: list[str], link: str = "logit") -> DataFrame:
    """(by, middle, slope): binary y on x by iterated least squares; ``link`` logit or probit. Where the classes part without
    overlap the slope is what 50 rounds reach."""

    def one(u, v, n):
        a = np.c_[np.ones(len(u)), (u - u.mean()) / (u.std() or 1.0)]
        b = np.zeros(2)
        for _ in range(50):
            eta = np.clip(a @ b, -30 if link == "logit" else -6, 30 if link == "logit" else 6)
            mu = 1 / (1 + np.exp(-eta)) if link == "logit" else norm_cdf(eta)
            d = mu * (1 - mu) if link == "logit" else np.exp(-eta * eta / 2) / math.sqrt(2 * math.pi)
            w = n * d * d / np.maximum(1e-10, mu * (1 - mu))
            step = np.linalg.solve(a.T @ (a * w[:, None]) + 1e-9 * np.eye(2), a.T @ (w * (v - mu) / np.maximum(1e-10, d)))
            b = b + step
            if np.abs(step).max() < 1e-9:
                break
        slope = b[1] / (u.std() or 1.0)
        return (u.mean() - b[0] / slope if slope else np.nan), slope

    return _fits(df, x, y, by, ["middle", "slope"], one)


def repeated_anova(df: DataFrame, value: str, subject: str, within: str, by: list[str]) -> DataFrame:
    """(by, f, df_effect, df_error): one within-subject factor; subjects and levels are averaged first."""
    cell = df.where(F.col(value).isNotNull()).groupBy(*by, subject, within).agg(F.avg(value).alias("v"))
    mean = lambda name, *keys: cell.groupBy(*keys).agg(F.avg("v").alias(name))
    m = cell.join(mean("_s", *by, subject), [*by, subject]).join(mean("_c", *by, within), [*by, within])
    m = m.join(mean("_g", *by), by) if by else m.join(F.broadcast(mean("_g")))  # one row
    s = m.groupBy(*by).agg(F.sum((F.col("_c") - F.col("_g")) ** 2).alias("effect"), F.sum((F.col("v") - F.col("_s") - F.col("_c") + F.col("_g")) ** 2).alias("error"), F.countDistinct(subject).alias("n"), F.countDistinct(within).alias("k"))
    d1, d2 = F.col("k") - 1, (F.col("k") - 1) * (F.col("n") - 1)
    return s.select(*by, F.try_divide(F.try_divide(F.col("effect"), d1), F.try_divide(F.col("error"), d2)).alias("f"), d1.alias("df_effect"), d2.alias("df_error"))
