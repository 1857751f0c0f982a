"""Operators over ordered samples of a channel: differences, crossings, baselines, ranks, smoothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def crossings(df: DataFrame, value: str, keys: list[str], order: list[str], threshold: Column | float, falling: bool = False) -> DataFrame:
    """Rows at which the value first goes past the threshold: above (or below) it now, not before."""
    past = (F.col(value) < threshold) if falling else (F.col(value) > threshold)
    return df.withColumn("_past", past).withColumn("_was", F.lag("_past").over(_by(keys, order))).where(F.col("_past") & (F.col("_was") == False)).drop("_past", "_was")  # noqa: E712


def first_edge(df: DataFrame, value: str, keys: list[str], order: list[str], threshold: float) -> DataFrame:
    """(keys, first crossing order value)."""
    return crossings(df, value, keys, order, threshold).groupBy(*keys).agg(F.min(order[0]).alias("edge"))


def nonlinear_energy(df: DataFrame, value: str, keys: list[str], order: list[str]) -> DataFrame:
    """x^2 - x(-1) x(+1); null at both ends."""
    w = _by(keys, order)
    return df.withColumn("energy", F.col(value) * F.col(value) - F.lag(value).over(w) * F.lead(value).over(w))


def second_difference(df: DataFrame, value: str, keys: list[str], order: list[str], scale: float = -0.3, spacing: float = 1.0) -> DataFrame:
    """Current source density over neighbouring channels: scale * second difference / spacing^2, ends duplicated."""
    w = _by(keys, order)
    d = F.lag(value).over(w), F.lead(value).over(w)
    return df.withColumn("csd", F.lit(scale / spacing**2) * (F.coalesce(d[0], F.col(value)) - 2 * F.col(value) + F.coalesce(d[1], F.col(value))))


def three_point_filter(df: DataFrame, value: str, keys: list[str], order: list[str], side: float = 0.23, middle: float = 0.54) -> DataFrame:
    """Weighted mean with both neighbours, zero outside."""
    w = _by(keys, order)
    zero = F.lit(0.0)
    return df.withColumn("smooth", (F.lit(side) * F.coalesce(F.lag(value).over(w), zero) + F.lit(middle) * F.col(value) + F.lit(side) * F.coalesce(F.lead(value).over(w), zero)) / F.lit(2 * side + middle))


def baseline_subtract(df: DataFrame, value: str, keys: list[str], order: list[str], first: int) -> DataFrame:
    """Value less the mean of the first ``first`` rows of its keys."""
    n = F.row_number().over(_by(keys, order))
    base = F.avg(F.when(F.col("_n") <= first, F.col(value))).over(Window.partitionBy(*keys))
    return df.withColumn("_n", n).withColumn("corrected", F.col(value) - base).drop("_n")


def _with_means(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Rows with ``_mean`` and ``_sd`` of their keys, from sums that are joined on: a key's rows never meet in one task."""
    m = df.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_sd"))
    if not keys:
        return df.join(F.broadcast(m))  # one row
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & df[k].eqNullSafe(m[f"_k{i}"])
    return df.join(m, on).drop(*(f"_k{i}" for i in range(len(keys))))


def percent_signal_change(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """100 x / mean; 0 where the mean is 0 or missing."""
    return _with_means(df, value, keys).withColumn("psc", F.coalesce(F.try_divide(100 * F.col(value), F.col("_mean")), F.lit(0.0))).drop("_mean", "_sd")


def z_transform(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(x - mean) / sample deviation; 0 where undefined."""
    z = F.try_divide(F.col(value) - F.col("_mean"), F.col("_sd"))
    return _with_means(df, value, keys).withColumn("z", F.coalesce(z, F.lit(0.0))).drop("_mean", "_sd")


def rank_transform(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Ranks from 1 with ties averaged."""
    ranked = df.withColumn("_r", F.rank().over(_by(keys, [value])))
    return ranked.withColumn("rank", F.col("_r") + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / F.lit(2.0)).drop("_r")


def local_maxima(df: DataFrame, value: str, keys: list[str], order: list[str], least: float | None = None) -> DataFrame:
    """Rows no less than both neighbours (ends count as their own neighbours)."""
    w = _by(keys, order)
    top = (F.col(value) >= F.coalesce(F.lag(value).over(w), F.col(value))) & (F.col(value) >= F.coalesce(F.lead(value).over(w), F.col(value)))
    out = df.withColumn("_top", top).where("_top").drop("_top")
    return out if least is None else out.where(F.col(value) >= least)


def moving_average(df: DataFrame, value: str, keys: list[str], order: list[str], side: int) -> DataFrame:
    return df.withColumn("average", F.avg(value).over(_by(keys, order).rowsBetween(-side, side)))


def opening(df: DataFrame, value: str, keys: list[str], order: list[str], side: int) -> DataFrame:
    """Morphological opening: rolling minimum, then rolling maximum."""
    w = _by(keys, order).rowsBetween(-side, side)
    return df.withColumn("_low", F.min(value).over(w)).withColumn("opened", F.max("_low").over(w)).drop("_low")


def closing(df: DataFrame, value: str, keys: list[str], order: list[str], side: int) -> DataFrame:
    """Morphological closing: rolling maximum, then rolling minimum."""
    w = _by(keys, order).rowsBetween(-side, side)
    return df.withColumn("_high", F.max(value).over(w)).withColumn("closed", F.min("_high").over(w)).drop("_high")


def smoothed(df: DataFrame, value: str, keys: list[str], order: list[str], side: int) -> DataFrame:
    """Moving average over ``side`` rows on both sides, with the first and last values repeated beyond the ends."""
    all_rows = _by(keys, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = _by(keys, order).rowsBetween(-side, side)
    before = F.greatest(F.lit(0), F.lit(side + 1) - F.row_number().over(_by(keys, order)))
    after = F.lit(2 * side + 1) - before - F.count(F.lit(1)).over(near)
    total = F.sum(value).over(near) + before * F.first(value).over(all_rows) + after * F.last(value).over(all_rows)
    return df.withColumn("smooth", total / F.lit(2 * side + 1))


def running_line(df: DataFrame, value: str, keys: list[str], index: str, length: int, step: int) -> DataFrame:
    """Adds ``line``: lines fitted by least squares in windows of ``length`` rows every ``step``, blended with tricube weights.
    ``index`` counts the rows of the keys from 0 without gaps. Rows beyond the last window get its line. Windows are frames
    of one sort by keys and index, so rows are shuffled once; rows with a null key are left out."""
    every = Window.partitionBy(*keys).orderBy(index)
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ahead, behind = every.rowsBetween(0, length - 1), every.rowsBetween(-(length - 1), 0)
    # windows begin at 0, step, ... and lie within the rows; the last one is the longest that fits
    last = F.greatest(F.ceil((F.max(index).over(whole) + 1 - length) / F.lit(step)) - 1, F.lit(0))
    rows = df.dropna(subset=keys).withColumn("_last", last.cast("long"))
    rows = rows.withColumn("_y1", F.avg(value).over(ahead)).withColumn("_m", F.count(value).over(ahead)).withColumn("_own", F.collect_list(F.struct(F.col(index).alias("i"), F.col(value).cast("double").alias("v"))).over(ahead))
    full = (F.col(index) % step == 0) & (F.col(index) <= F.col("_last") * step) & (F.size("_own") == length)
    rows = rows.withColumn("_full", full)
    moment = F.aggregate("_own", F.lit(0.0), lambda s, x: s + F.coalesce((x["i"] - F.col(index) + 1) * x["v"], F.lit(0.0)))
    rows = rows.withColumn("_y2", F.when(F.col("_full"), F.try_divide(moment, F.col("_m")) * 2 / (length + 1))).drop("_own", "_m")
    rows = rows.withColumn("_a", (F.col("_y2") - F.col("_y1")) * (6 / (length - 1))).withColumn("_b", F.col("_y1") - F.col("_a") * ((length + 1) / 2))
    fit = F.when(F.col("_full"), F.struct(F.col(index).alias("i"), F.col("_a").alias("a"), F.col("_b").alias("b")))
    rows = rows.withColumn("_near", F.collect_list(fit).over(behind)).withColumn("_tail", F.max(F.when(F.col(index) == F.col("_last") * step, fit)).over(whole))
    place = lambda x: F.col(index) - x["i"] + 1
    weight = lambda x: F.pow(1 - F.pow(F.abs((place(x) - length / 2) / (length / 2)), 3), 3)
    weights = F.aggregate("_near", F.lit(0.0), lambda s, x: s + weight(x))
    lines = F.aggregate("_near", F.lit(0.0), lambda s, x: s + weight(x) * (place(x) * x["a"] + x["b"]))
    beyond = (F.col(index) - F.col("_last") * step + 1) * F.col("_tail.a") + F.col("_tail.b")
    line = F.when(F.col(index) >= F.col("_last") * step + length - 1, beyond).otherwise(F.coalesce(F.try_divide(lines, weights), F.lit(0.0)))
    return rows.withColumn("line", line).select(*df.columns, "line")


def running_count(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("count", F.count(F.lit(1)).over(_by(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def mad_threshold(df: DataFrame, value: str, keys: list[str], times: float) -> DataFrame:
    """(keys, threshold): times * median(abs(x)) / 0.6745, exact."""
    return df.groupBy(*keys).agg((F.lit(times) * F.percentile(F.abs(value), F.lit(0.5)) / F.lit(0.6745)).alias("threshold"))


def noise_deviation(df: DataFrame, value: str, keys: list[str], method: int = 1) -> DataFrame:
    """(keys, sd) of the rows within two deviations of the median: their deviation (1), or the median of absolute
    distances from their mean over 0.6745 (2)."""
    if method not in (1, 2):
        raise ValueError("method is 1 or 2")
    stats = df.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("_m"), F.stddev_samp(value).alias("_s"))
    near = df.join(stats, keys).where(F.abs(F.col(value) - F.col("_m")) <= 2 * F.col("_s"))
    if method == 1:
        return near.groupBy(*keys).agg(F.stddev_samp(value).alias("sd"))
    centred = near.withColumn("_d", F.abs(F.col(value) - F.avg(value).over(Window.partitionBy(*keys))))
    return centred.groupBy(*keys).agg((F.percentile("_d", F.lit(0.5)) / F.lit(0.6745)).alias("sd"))


def moving_windows(df: DataFrame, index: str, keys: list[str], length: int, step: int) -> DataFrame:
    """Each row once for every window [w step, w step + length) that holds it, as ``window``."""
    last = F.floor(F.col(index) / F.lit(step)).cast("long")
    first = F.greatest(F.floor((F.col(index) - F.lit(length)) / F.lit(step)).cast("long") + 1, F.lit(0))
    return df.withColumn("window", F.explode(F.sequence(first, last)))


def winsorize(df: DataFrame, value: str, keys: list[str], low: float, high: float) -> DataFrame:
    """Clamps to the exact percentiles of the keys."""
    limits = df.groupBy(*keys).agg(F.percentile(value, F.lit(low)).alias("_low"), F.percentile(value, F.lit(high)).alias("_high"))
    return df.join(limits, keys).withColumn("clamped", F.least(F.greatest(F.col(value), F.col("_low")), F.col("_high"))).drop("_low", "_high")
