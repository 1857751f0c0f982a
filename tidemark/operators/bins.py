"""Histograms, conditional sums, rates around events, interval histograms and cross-correlograms."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.intervals import peri_event, range_join, theta_pairs


def bin_of(x: Column, width: float, start: float = 0.0) -> Column:
    """Half-open bin [start + i width, start + (i + 1) width)."""
    return F.floor((x - F.lit(start)) / F.lit(width)).cast("long")


def histogram(df: DataFrame, value: str, width: float, by: list[str] | None = None, weight: str | None = None, start: float = 0.0, stop: float | None = None) -> DataFrame:
    """(by, bin, n): counts, or sums of ``weight``. Null and NaN values and those outside [start, stop) are left out."""
    x = F.col(value).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x) & (x >= start))
    if stop is not None:
        rows = rows.where(x < stop)
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return rows.groupBy(*(by or []), bin_of(x, width, start).alias("bin")).agg(n.alias("n"))


def histogram_2d(df: DataFrame, x: str, y: str, width_x: float, width_y: float) -> DataFrame:
    return df.groupBy(bin_of(F.col(x), width_x).alias("bin_x"), bin_of(F.col(y), width_y).alias("bin_y")).agg(F.count(F.lit(1)).alias("n"))


def conditional_sum(df: DataFrame, key: str, value: str, most: int) -> DataFrame:
    """(key, total) for keys 1 to ``most``: rows with a null, NaN or infinite key or value, or a key beyond, are ignored;
    keys without rows give 0."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    sums = df.where(finite(key) & finite(value)).where(F.col(key).between(1, most)).groupBy(F.col(key).cast("long").alias("key")).agg(F.sum(value).alias("total"))
    spine = df.sparkSession.range(1, most + 1).withColumnRenamed("id", "key")
    return spine.join(sums, "key", "left").select("key", F.coalesce("total", F.lit(0.0)).alias("total"))


def psth(points: DataFrame, markers: DataFrame, at: str, marker_at: str, unit: str, before: int, after: int, width: int, keys: list[str] | None = None) -> DataFrame:
    """(unit, bin, n, mean, norm): counts in half-open bins around markers, their mean over all markers, and the mean over
    the largest of the unit. Bins without points are there with 0."""
    counts = peri_event(points, markers, at, marker_at, before, after, keys).groupBy(unit, bin_of(F.col("lag"), width, -before).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = F.explode(F.sequence(F.lit(0).cast("long"), F.lit((before + after) // width - 1).cast("long")))
    spine = points.select(unit).distinct().select(unit, bins.alias("bin"))
    total = markers.agg(F.count(F.lit(1)).alias("_markers"))  # one row
    full = spine.join(counts, [unit, "bin"], "left").select(unit, "bin", F.coalesce("n", F.lit(0)).alias("n")).join(F.broadcast(total))
    full = full.withColumn("mean", F.try_divide(F.col("n").cast("double"), F.col("_markers"))).drop("_markers")
    return full.withColumn("norm", F.coalesce(F.try_divide("mean", F.max("mean").over(Window.partitionBy(unit))), F.lit(0.0)))


def count_by_condition(counts: DataFrame, by: list[str], repeat: str) -> DataFrame:
    """(by, n_repeats, mean_count, sem): counts of points per repeat, over ragged repeats."""
    each = counts.groupBy(*by, repeat).agg(F.count(F.lit(1)).alias("c"))
    return each.groupBy(*by).agg(F.count(F.lit(1)).alias("n_repeats"), F.avg("c").alias("mean_count"), (F.stddev_samp("c") / F.sqrt(F.count(F.lit(1)))).alias("sem"))


def intervals(df: DataFrame, at: str, by: list[str], order: list[str] | None = None) -> DataFrame:
    """Time since the previous event of the same keys, as ``isi``; first events are left out."""
    w = Window.partitionBy(*by).orderBy(at, *(order or []))
    return df.withColumn("isi", F.col(at) - F.lag(at).over(w)).where("isi is not null")


def isi_histogram(df: DataFrame, at: str, by: list[str], width: int, stop: int) -> DataFrame:
    """Counts of intervals in bins centred on multiples of ``width`` from 0 to ``stop``."""
    near = F.floor((F.col("isi") + F.lit(width / 2)) / F.lit(width)).cast("long")
    return intervals(df, at, by).where(F.col("isi") <= stop).groupBy(*by, near.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def refractory_share(df: DataFrame, at: str, by: list[str], limit: int) -> DataFrame:
    """(by, n_spikes, n_violations, share): intervals under the limit over the number of events."""
    w = Window.partitionBy(*by).orderBy(at)
    each = df.withColumn("_short", (F.col(at) - F.lag(at).over(w) < limit).cast("long"))
    return each.groupBy(*by).agg(F.count(F.lit(1)).alias("n_spikes"), F.coalesce(F.sum("_short"), F.lit(0)).alias("n_violations")).withColumn("share", F.col("n_violations") / F.col("n_spikes"))


def contamination(df: DataFrame, at: str, by: list[str], refractory: int) -> DataFrame:
    """Share of foreign events: violations / (2 refractory n) over the rate n / duration, at most 1; 0 where undefined."""
    share = refractory_share(df, at, by, refractory)
    span = df.groupBy(*by).agg((F.max(at) - F.min(at)).alias("_span"))
    expected = F.try_divide(2.0 * refractory * F.col("n_spikes") * F.col("n_spikes"), F.col("_span").cast("double"))
    return share.join(span, by).select(*by, "n_spikes", "n_violations", F.least(F.coalesce(F.try_divide(F.col("n_violations").cast("double"), expected), F.lit(0.0)), F.lit(1.0)).alias("contamination"))


def correlogram(a: DataFrame, b: DataFrame, at: str, keys: list[str], reach: int, width: int) -> DataFrame:
    """(lag, n): pairs of events of two trains of the same keys by lag (a - b) in bins centred on multiples of width."""
    pairs = theta_pairs(a.withColumnRenamed(at, "_a"), b.select(*keys, F.col(at).alias("_b")), "_a", "_b", reach, keys)
    return pairs.groupBy(F.floor((F.col("_a") - F.col("_b") + F.lit(width / 2)) / F.lit(width)).cast("long").alias("lag")).agg(F.count(F.lit(1)).alias("n"))


def correlogram_norm(pairs: DataFrame, n_a: int, n_b: int, kind: str = "geometric") -> DataFrame:
    """Divides by: ``first`` n_a, ``second`` n_b, ``geometric`` sqrt(n_a n_b), ``union`` n_a + n_b - n. 0 where undefined."""
    by = {"first": F.lit(float(n_a)), "second": F.lit(float(n_b)), "geometric": F.lit((n_a * n_b) ** 0.5), "union": F.lit(float(n_a + n_b)) - F.col("n")}[kind]
    return pairs.withColumn("c", F.coalesce(F.try_divide(F.col("n").cast("double"), by), F.lit(0.0)))


def shift_predictor(a: DataFrame, b: DataFrame, at: str, trial: str, width: int, reach: int) -> DataFrame:
    """(lag, mean): pairs across different trials i != j up to ``reach`` bins apart, as means over ordered trial pairs. From
    binned counts of all trials: products of totals less those within a trial, so no pair of trials is ever joined. Each
    bin asks for the bins at its lags by equality."""
    binned = lambda df, n: df.groupBy(trial, F.floor(F.col(at) / F.lit(width)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias(n))
    x, y = binned(a, "x"), binned(b, "y")
    tx, ty = x.groupBy("bin").agg(F.sum("x").alias("x")), y.groupBy(F.col("bin").alias("bin_y")).agg(F.sum("y").alias("y"))
    asked = lambda df: df.withColumn("lag", F.explode(F.sequence(F.lit(-reach).cast("long"), F.lit(reach).cast("long")))).withColumn("bin_y", F.col("bin") - F.col("lag"))
    total = asked(tx).join(ty, "bin_y").groupBy("lag").agg(F.sum(F.col("x") * F.col("y")).alias("all"))
    same = asked(x).join(y.withColumnRenamed("bin", "bin_y"), [trial, "bin_y"]).groupBy("lag").agg(F.sum(F.col("x") * F.col("y")).alias("own"))
    trials = a.select(trial).union(b.select(trial)).distinct().agg(F.count(F.lit(1)).alias("_n"))
    out = total.join(same, "lag", "left").join(F.broadcast(trials))
    return out.select("lag", F.try_divide((F.col("all") - F.coalesce("own", F.lit(0))).cast("double"), (F.col("_n") * (F.col("_n") - 1)).cast("double")).alias("mean"))


def joint_predictor(a: DataFrame, b: DataFrame, at: str, trial: str, width: int, reach: int) -> DataFrame:
    """(lag, mean): what two trains would give by their mean rates alone: products of the mean counts of bins ``lag`` apart (a - b),
    over the trials that either has. It is what the joint histogram of a pair is freed of."""
    n = a.select(trial).union(b.select(trial)).distinct().agg(F.count(F.lit(1)).alias("_n"))
    binned = lambda df, name: df.groupBy(F.floor(F.col(at) / F.lit(width)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias(name))
    x = binned(a, "x").withColumn("lag", F.explode(F.sequence(F.lit(-reach).cast("long"), F.lit(reach).cast("long")))).withColumn("_other", F.col("bin") - F.col("lag"))
    y = binned(b, "y").withColumnRenamed("bin", "_other")
    out = x.join(y, "_other").groupBy("lag").agg(F.sum(F.col("x") * F.col("y")).alias("_s")).join(F.broadcast(n))
    return out.select("lag", (F.col("_s") / (F.col("_n") * F.col("_n"))).alias("mean"))


def jitter_predictor(a: DataFrame, b: DataFrame, at: str, trial: str, width: int, window: int, reach: int) -> DataFrame:
    """(lag, expected): pairs by lag when each event of ``a`` moves to any bin of its window of ``window`` bins with equal
    chance: the mean of all jittered trains, without drawing any. Counts of a window are spread over its bins."""
    binned = lambda df, size, name: df.groupBy(trial, F.floor(F.col(at) / F.lit(size)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias(name))
    start = F.col("bin") * window
    x = binned(a, width * window, "x").withColumn("_at", F.explode(F.sequence(start, start + (window - 1))))
    x = x.withColumn("lag", F.explode(F.sequence(F.lit(-reach).cast("long"), F.lit(reach).cast("long")))).withColumn("_other", F.col("_at") - F.col("lag"))
    y = binned(b, width, "y").withColumnRenamed("bin", "_other")
    return x.join(y, [trial, "_other"]).groupBy("lag").agg((F.sum(F.col("x") * F.col("y")) / F.lit(float(window))).alias("expected"))


def jittered(df: DataFrame, at: str, keys: list[str], window: int, rounds: int, seed: int = 0) -> DataFrame:
    """(round, keys, at): trains with each event drawn anew in its window, ``rounds`` times. Draws go by a hash of round and event,
    so they are the same on every run and in every partition."""
    draw = F.pmod(F.xxhash64("round", F.lit(seed), *keys, at), F.lit(window))
    return df.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn(at, F.col(at) - F.pmod(F.col(at), F.lit(window)) + draw)


def correlogram_band(a: DataFrame, b: DataFrame, at: str, keys: list[str], reach: int, width: int, window: int, rounds: int = 100, share: float = 0.95, seed: int = 0) -> DataFrame:
    """(lag, n, low, high): the correlogram and the band that holds ``share`` of those of jittered trains."""
    own = correlogram(a, b, at, keys, reach, width)
    drawn = jittered(a.select(*keys, at), at, keys, window, rounds, seed)
    pairs = theta_pairs(drawn.withColumnRenamed(at, "_a"), b.select(*keys, F.col(at).alias("_b")), "_a", "_b", reach, keys)
    lag = F.floor((F.col("_a") - F.col("_b") + F.lit(width / 2)) / F.lit(width)).cast("long")
    counts = pairs.groupBy("round", lag.alias("lag")).agg(F.count(F.lit(1)).alias("n"))
    # rounds without a pair at a lag have none in the list of counts: they are zeros
    full = F.concat(F.collect_list("n"), F.array_repeat(F.lit(0).cast("long"), (F.lit(rounds) - F.count(F.lit(1))).cast("int")))
    ranked = counts.groupBy("lag").agg(F.array_sort(full).alias("_n"))
    place = lambda q: F.lit(max(1, min(rounds, round(q * rounds))))
    band = ranked.select("lag", F.element_at("_n", place((1 - share) / 2)).alias("low"), F.element_at("_n", place((1 + share) / 2)).alias("high"))
    return own.join(band, "lag", "full").select("lag", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "low", "high")))


def interval_jackknife(df: DataFrame, at: str, trial: str, width: int, stop: int) -> DataFrame:
    """(bin, n, error): counts of intervals within trials in bins centred on multiples of ``width``, and the jackknife error over
    trials; it is null for four trials or fewer."""
    near = F.floor((F.col("isi") + F.lit(width / 2)) / F.lit(width)).cast("long")
    own = intervals(df, at, [trial])
    each = own.where(F.col("isi") <= stop).groupBy(trial, near.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    trials = df.select(trial).distinct().agg(F.count(F.lit(1)).alias("_t"))
    sums = each.groupBy("bin").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("_q")).join(F.broadcast(trials))
    # leaving out trial i gives (n - c_i) / (t - 1): their spread is that of the counts
    spread = (F.col("_q") - F.col("n") * F.col("n") / F.col("_t")) / (F.col("_t") * (F.col("_t") - 1))
    return sums.select("bin", "n", F.when(F.col("_t") > 4, F.sqrt(F.greatest(spread, F.lit(0.0)))).alias("error"))


def interval_bins(df: DataFrame, at: str, by: list[str]) -> DataFrame:
    """(by, bins, longest): the number of bins for a histogram of intervals: a thirtieth of their number, times longest over
    median, ten at least."""
    own = intervals(df, at, by).groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.max("isi").alias("longest"), F.percentile("isi", F.lit(0.5)).alias("_median"))
    n = F.floor(F.floor(F.col("_n") / 30) * F.try_divide(F.col("longest").cast("double"), F.col("_median")))
    return own.select(*by, F.greatest(F.coalesce(n, F.lit(0)), F.lit(10)).cast("long").alias("bins"), "longest")


def _mean_rate(df: DataFrame, at: str, grid: DataFrame, point: str, sigma: Column, reach: Column, width: int, trials: int) -> DataFrame:
    spans = grid.withColumn("_sigma", sigma).withColumn("_from", (F.col(point) - reach).cast("long")).withColumn("_to", (F.col(point) + reach).cast("long"))
    pairs = range_join(df.select(at), spans.where("_sigma is not null"), at, "_from", "_to", width, closed="both")
    bell = F.exp(-F.pow((F.col(at) - F.col(point)) / F.col("_sigma"), 2) / 2) / (F.col("_sigma") * (2 * math.pi) ** 0.5)
    sums = pairs.groupBy(point).agg((F.sum(bell) / trials).alias("_rate"))
    return spans.join(sums, point, "left").select(point, "_sigma", F.coalesce("_rate", F.lit(0.0)).alias("rate"))


def trial_rate(df: DataFrame, at: str, grid: DataFrame, point: str, sigma: float, trials: int, adaptive: bool = False, reach: float = 4.0) -> DataFrame:
    """(point, rate, error): mean over trials of Gaussians of ``sigma`` at the events, with the Poisson error sqrt(rate / (2 trials
    sigma sqrt(pi))). ``adaptive``: once more with a sigma for each point, the mean rate over its rate times sigma; points of
    no rate keep the first."""
    first = _mean_rate(df, at, grid, point, F.lit(float(sigma)), F.lit(reach * sigma), max(1, int(2 * reach * sigma)), trials)
    if adaptive:
        mean = first.agg(F.avg("rate").alias("_mean"))  # one row
        own = first.join(F.broadcast(mean)).withColumn("_own", F.coalesce(F.try_divide(F.col("_mean") * F.lit(float(sigma)), F.col("rate")), F.lit(float(sigma))))
        # beyond what the whole grid spans a wider bell is flat there
        span = grid.agg((F.max(point) - F.min(point)).cast("double").alias("_span"))
        own = own.join(F.broadcast(span)).withColumn("_own", F.least("_own", F.greatest("_span", F.lit(float(sigma)))))
        first = _mean_rate(df, at, own.select(point, "_own"), point, F.col("_own"), reach * F.col("_own"), max(1, int(2 * reach * sigma)), trials)
    return first.select(point, "rate", F.sqrt(F.col("rate") / (F.col("_sigma") * (2 * trials * math.pi**0.5))).alias("error"))


def kernel_rate(df: DataFrame, at: str, grid: DataFrame, point: str, sigma: float, reach: float = 4.0) -> DataFrame:
    """Sum of Gaussians of ``sigma`` at each grid point, from events within ``reach`` sigmas."""
    pairs = peri_event(df, grid, at, point, int(reach * sigma), int(reach * sigma), closed="both")
    rate = F.exp(-F.pow(F.col("lag") / F.lit(sigma), 2) / 2) / F.lit(sigma * (2 * 3.141592653589793) ** 0.5)
    sums = pairs.groupBy(point).agg(F.sum(rate).alias("rate"))
    return grid.join(sums, point, "left").select(point, F.coalesce("rate", F.lit(0.0)).alias("rate"))


def pattern_shifted(df: DataFrame, at: str, keys: list[str], window: int, rounds: int, seed: int = 0) -> DataFrame:
    """(round, keys, at): trains whose events move window by window, those of a window by one step, drawn from all that keep
    them in it; intervals within a window stay. Draws go by a hash of round, keys and window."""
    own = df.select(*keys, at, (F.col(at) - F.pmod(F.col(at), F.lit(window))).alias("_w"))
    span = own.groupBy(*keys, "_w").agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    drawn = span.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    room = F.lit(window) - (F.col("_hi") - F.col("_lo"))
    drawn = drawn.withColumn("_step", F.col("_w") - F.col("_lo") + F.pmod(F.xxhash64("round", F.lit(seed), *keys, "_w"), room))
    named = [F.col(k).alias(f"_{i}") for i, k in enumerate(keys)]
    same = [F.col(f"_{i}").eqNullSafe(F.col(k)) for i, k in enumerate(keys)]
    met = own.join(drawn.select("round", "_step", F.col("_w").alias("_own"), *named), [F.col("_w") == F.col("_own"), *same])
    return met.select("round", *keys, (F.col(at) + F.col("_step")).alias(at))


#: Trials that are reassigned together; more are dealt to blocks, anew in each round.
TRIALS = 4096


def reassigned(df: DataFrame, at: str, trial: str, window: int, rounds: int, seed: int = 0) -> DataFrame:
    """(round, trial, at): trains drawn so that in each window every trial keeps its number of events, and every place its
    number of events over all trials; a trial has one event at a place at most. Pairs of trials again and again pool the
    events that only one of them has and deal them out by chance, which leaves both counts as they are. Draws go by a hash
    of round, window and block, and trials are taken in order, so that they are the same on every run."""
    own = df.select(F.col(trial).alias("trial"), F.col(at).cast("long").alias("at")).where("at is not null").distinct()
    n = own.select("trial").distinct().count()
    parts = max(1, -(-n // TRIALS))
    rows = own.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("w", F.floor(F.col("at") / F.lit(window)).cast("long"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("round", F.lit(seed), "trial"), F.lit(parts))).withColumn("draw", F.xxhash64("round", F.lit(seed), "w", "block"))

    def deal(t: pa.Table) -> pa.Table:
        t = t.sort_by([("trial", "ascending"), ("at", "ascending")])
        rng = np.random.default_rng(t.column("draw")[0].as_py() & (2**63 - 1))
        names = t.column("trial").dictionary_encode().combine_chunks()
        code = names.indices.fill_null(len(names.dictionary)).to_numpy()
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        at = t.column("at").to_numpy()
        sets = [set(x.tolist()) for x in np.split(at, first[1:])]
        n = len(sets)
        meetings = 5 * n if n > 1 else 0
        one = rng.integers(0, n, meetings)
        other = rng.integers(0, max(1, n - 1), meetings)
        other += other >= one
        chance = random.Random(int(rng.integers(2**62)))
        for i, j in zip(one.tolist(), other.tolist()):
            x, y = sets[i], sets[j]
            if (a := x - y) and (b := y - x):
                both, pool = x & y, sorted(a) + sorted(b)
                chance.shuffle(pool)
                sets[i], sets[j] = both.union(pool[: len(a)]), both.union(pool[len(a) :])
        out = np.concatenate([sorted(s) for s in sets])  # a trial keeps its number of rows
        return t.select(["round", "trial"]).append_column("at", pa.array(out, pa.int64()))

    kind = df.schema[trial].dataType.simpleString()
    out = rows.groupBy("round", "w", "block").applyInArrow(deal, f"round int, trial {kind}, at long")
    return out.select("round", F.col("trial").alias(trial), F.col("at").alias(at))


def resampled_band(a: DataFrame, b: DataFrame, drawn_a: DataFrame, drawn_b: DataFrame, at: str, keys: list[str], reach: int, width: int, rounds: int, share: float = 0.95) -> DataFrame:
    """(lag, n, mean, low, high): the correlogram, and the mean and the band of those of trains drawn ``rounds`` times
    (round, keys, at). The band's ends are the drawn values at the places floor(rounds q), the first at least."""
    own = correlogram(a, b, at, keys, reach, width)
    pairs = theta_pairs(drawn_a.withColumnRenamed(at, "_a"), drawn_b.select("round", *keys, F.col(at).alias("_b")), "_a", "_b", reach, ["round", *keys])
    lag = F.floor((F.col("_a") - F.col("_b") + F.lit(width / 2)) / F.lit(width)).cast("long")
    counts = pairs.groupBy("round", lag.alias("lag")).agg(F.count(F.lit(1)).alias("n"))
    # rounds without a pair at a lag have none in the list of counts: they are zeros
    full = F.array_sort(F.concat(F.collect_list("n"), F.array_repeat(F.lit(0).cast("long"), (F.lit(rounds) - F.count(F.lit(1))).cast("int"))))
    place = lambda q: F.lit(max(1, math.floor(rounds * q + 1e-9)))
    band = counts.groupBy("lag").agg((F.sum("n") / rounds).alias("mean"), full.alias("_n"))
    band = band.select("lag", "mean", F.element_at("_n", place((1 - share) / 2)).alias("low"), F.element_at("_n", place((1 + share) / 2)).alias("high"))
    return own.join(band, "lag", "full").select("lag", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "mean", "low", "high")))
