"""Averages of sampled fields around events, and of trials.

A sample is a row (keys, index, value). Events ask for the samples at their lags by equality of index, so all is equi joins
and aggregates in parts: a field with a hot channel is split by Spark, and no event gathers its samples in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.bins import bin_of
from tidemark.operators.intervals import peri_event


def sem(x: Column | str) -> Column:
    return F.stddev_samp(x) / F.sqrt(F.count(x))


def samples_at_lags(spikes: DataFrame, field: DataFrame, keys: list[str], at: str, index: str, value: str, first: int, last: int) -> DataFrame:
    """The spikes' rows once for each lag from ``first`` to ``last`` samples, with the field's ``value`` there. A spike
    between two samples (``at`` in samples, with a fraction) gets the line between them. Spikes whose lags go beyond the
    field of their keys are left out."""
    w = Window.partitionBy(*keys).orderBy(index)
    ends = field.groupBy(*keys).agg(F.min(index).alias("_low"), F.max(index).alias("_high"))
    pairs = field.select(*keys, F.col(index).alias("_index"), F.col(value).alias("_value"), F.lead(value).over(w).alias("_next"))
    inside = spikes.join(ends, keys).where((F.col(at) + first >= F.col("_low")) & (F.col(at) + last <= F.col("_high"))).drop("_low", "_high")
    asked = inside.withColumn("lag", F.explode(F.sequence(F.lit(first), F.lit(last)))).withColumn("_index", F.floor(at).cast("long") + F.col("lag"))
    part = F.col(at) - F.floor(at)
    line = F.when(part > 0, F.col("_value") * (1 - part) + F.col("_next") * part).otherwise(F.col("_value"))
    return asked.join(pairs, [*keys, "_index"]).withColumn(value, line).drop("_index", "_value", "_next")


def spike_triggered_average(spikes: DataFrame, field: DataFrame, keys: list[str], at: str, index: str, value: str, first: int, last: int, by: list[str] | None = None) -> DataFrame:
    """(by, lag, n, mean, sem) of the field around spikes."""
    each = samples_at_lags(spikes, field, keys, at, index, value, first, last)
    return each.groupBy(*(by or []), "lag").agg(F.count(value).alias("n"), F.avg(value).alias("mean"), sem(value).alias("sem"))


def moving_spike_triggered_average(spikes: DataFrame, field: DataFrame, keys: list[str], at: str, index: str, value: str, first: int, last: int, length: int, step: int) -> DataFrame:
    """(window, lag, n, mean, sem) of the spikes in each window [w step, w step + length) of samples."""
    newest = F.floor(F.col(at) / F.lit(step)).cast("long")
    oldest = F.greatest(F.floor((F.col(at) - F.lit(length)) / F.lit(step)).cast("long") + 1, F.lit(0).cast("long"))
    each = samples_at_lags(spikes, field, keys, at, index, value, first, last)
    return each.withColumn("window", F.explode(F.sequence(oldest, newest))).groupBy("window", "lag").agg(F.count(value).alias("n"), F.avg(value).alias("mean"), sem(value).alias("sem"))


def evoked_mean(samples: DataFrame, by: list[str], k: str, value: str) -> DataFrame:
    """(by, k, n, mean, sem) over the trials that have the k-th sample."""
    return samples.groupBy(*by, k).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), sem(value).alias("sem"))


def event_related_average(points: DataFrame, markers: DataFrame, at: str, marker_at: str, marker: str, value: str, before: int, after: int, width: int, keys: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """(by, bin, n, mean, sem): values around markers in bins of ``width`` from ``-before`` on, less each marker's mean before it;
    markers without a value before them are left out. Bins of a marker are averaged before markers are."""
    lags = peri_event(points, markers, at, marker_at, before, after, keys)
    by = by or []
    base = lags.where("lag < 0").groupBy(marker).agg(F.avg(value).alias("_base"))
    each = lags.groupBy(*by, marker, bin_of(F.col("lag"), width, -before).alias("bin")).agg(F.avg(value).alias("_v"))
    rest = each.join(base, marker).withColumn("_v", F.col("_v") - F.col("_base"))
    return rest.groupBy(*by, "bin").agg(F.count("_v").alias("n"), F.avg("_v").alias("mean"), sem("_v").alias("sem"))


def mapped_clock(rows: DataFrame, bad: DataFrame, good: DataFrame, trial: str, at: str, keys: list[str]) -> DataFrame:
    """Rows of a recorder whose clock jumped, as ``repaired``: their time from the trial's anchor in ``bad`` is kept, and counted from
    the trial's anchor in ``good``. Trials without both anchors are left out."""
    b = bad.select(*keys, trial, F.col(at).alias("_bad"))
    g = good.select(*keys, trial, F.col(at).alias("_good"))
    return rows.join(b, [*keys, trial]).join(g, [*keys, trial]).withColumn("repaired", F.col(at) - F.col("_bad") + F.col("_good")).drop("_bad", "_good")
