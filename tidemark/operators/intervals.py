"""Interval, peri-event and as-of joins, and segmentation by markers.

Times are integers (microseconds or samples). Range joins deal both sides into buckets of fixed width, so they are equi
joins on the bucket that Spark can shuffle, split on skew or broadcast by itself; the exact bounds are a filter on top.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucket(x: Column, width: int) -> Column:
    return F.floor(x / F.lit(width)).cast("long")


def range_join(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, width: int, keys: list[str] | None = None, closed: str = "left") -> DataFrame:
    """Points inside intervals, a row for each pair. ``closed``: left [start, end), right (start, end], both or neither.

    ``keys`` must agree on both sides and are kept once. ``width`` is the bucket: about the usual length of an interval.
    """
    keys = keys or []
    p = points.withColumn("_bucket", _bucket(F.col(at), width))
    i = intervals.where(F.col(start) <= F.col(end)).withColumn("_bucket", F.explode(F.sequence(_bucket(F.col(start), width), _bucket(F.col(end), width))))
    low = F.col(at) >= F.col(start) if closed in ("left", "both") else F.col(at) > F.col(start)
    high = F.col(at) <= F.col(end) if closed in ("right", "both") else F.col(at) < F.col(end)
    return p.join(i, [*keys, "_bucket"]).where(low & high).drop("_bucket")


def peri_event(points: DataFrame, markers: DataFrame, at: str, marker_at: str, before: int, after: int, keys: list[str] | None = None, closed: str = "left") -> DataFrame:
    """Points around markers with ``lag`` = point - marker, in [-before, after) unless ``closed`` says otherwise."""
    m = markers.withColumn("_from", F.col(marker_at) - before).withColumn("_to", F.col(marker_at) + after)
    out = range_join(points, m, at, "_from", "_to", max(1, before + after), keys, closed)
    return out.withColumn("lag", F.col(at) - F.col(marker_at)).drop("_from", "_to")


def asof_last(events: DataFrame, is_marker: Column, at: str, keys: list[str], value: Column, name: str, order: list[str] | None = None) -> DataFrame:
    """Adds the value of the last marker at or before each event of the same keys; null before the first."""
    w = Window.partitionBy(*keys).orderBy(at, *(order or [])).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn(name, F.last(F.when(is_marker, value), ignorenulls=True).over(w))


def segment_by_marker(events: DataFrame, is_marker: Column, at: str, keys: list[str], order: list[str] | None = None, name: str = "segment") -> DataFrame:
    """Numbers the stretches that begin with each marker; what comes before the first is segment 0."""
    w = Window.partitionBy(*keys).orderBy(at, *(order or [])).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn(name, F.sum(F.when(is_marker, 1).otherwise(0)).over(w))


def split_by_gap(events: DataFrame, at: str, keys: list[str], gap: int, order: list[str] | None = None, name: str = "part") -> DataFrame:
    """Numbers the parts between pauses longer than ``gap``, and splits too where time runs backwards in ``order``."""
    by = Window.partitionBy(*keys).orderBy(*(order or [at]))
    step = F.col(at) - F.lag(at).over(by)
    fresh = F.when((step > gap) | (step < 0), 1).otherwise(0)
    return events.withColumn("_fresh", fresh).withColumn(name, F.sum("_fresh").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_fresh")


def slice_samples(samples: DataFrame, trials: DataFrame, index: str, align: str, start: int, end: int, keys: list[str]) -> DataFrame:
    """Samples of each trial from ``start`` to ``end`` (inclusive) relative to its alignment sample, as ``k``."""
    t = trials.withColumn("_from", F.col(align) + start).withColumn("_to", F.col(align) + end)
    out = range_join(samples, t, index, "_from", "_to", max(1, end - start), keys, "both")
    return out.withColumn("k", F.col(index) - F.col(align)).drop("_from", "_to")


def theta_pairs(a: DataFrame, b: DataFrame, a_at: str, b_at: str, reach: int, keys: list[str]) -> DataFrame:
    """Pairs of two trains of the same keys with abs(b - a) <= reach, as a range join."""
    return peri_event(b, a, b_at, a_at, reach, reach, keys, "both")
