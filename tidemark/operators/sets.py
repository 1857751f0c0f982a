"""Unions, comparisons, updates, selections and top rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_aligned(*frames: DataFrame) -> DataFrame:
    """Union by column name; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def first_occurrences(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order, which is kept as a column."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def compare(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, status): only_left, only_right, differs or equal, over a full outer join."""
    both = a.select(*keys, F.col(value).alias("_a"), F.lit(1).alias("_in_a")).join(b.select(*keys, F.col(value).alias("_b"), F.lit(1).alias("_in_b")), keys, "full_outer")
    status = F.when(F.col("_in_b").isNull(), "only_left").when(F.col("_in_a").isNull(), "only_right").when(F.col("_a").eqNullSafe(F.col("_b")), "equal").otherwise("differs")
    return both.select(*keys, status.alias("status"))


def update_by_id(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` with the non-null values of ``changes`` for the same id; ids that only changes has are left out."""
    columns = [c for c in changes.columns if c != key and c in df.columns]
    new = changes.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in columns))
    joined = df.join(new, F.col(key) == F.col("_key"), "left")
    return joined.select(*(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns))


def top_k(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def match_all(conditions: dict[str, list]) -> Column:
    """True where each column has one of its values."""
    return reduce(lambda a, b: a & b, (F.col(c).isin(v) for c, v in conditions.items()), F.lit(True))


def text_equal(column: str, pattern: str) -> Column:
    """Equality without case; with a ``*``, a match of the pattern without case."""
    if "*" not in pattern:
        return F.lower(column) == pattern.lower()
    return F.lower(column).like(pattern.lower().replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%"))


def has_codes(codes: str, wanted: list) -> Column:
    """True where the array holds all wanted codes."""
    return F.size(F.array_intersect(F.col(codes), F.array(*map(F.lit, wanted)))) == len(set(wanted))


def append_recording(a: DataFrame, b: DataFrame, at: str) -> DataFrame:
    """b after a, its times shifted to begin one unit after the last of a."""
    last = a.agg((F.max(at) + 1).alias("_last"))  # one row
    return a.unionByName(b.join(F.broadcast(last)).withColumn(at, F.col(at) + F.coalesce("_last", F.lit(0))).drop("_last"))
