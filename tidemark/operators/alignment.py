"""Trial tables of two systems brought together: greedy alignment of codes in order, and repair of missing trials."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def greedy_merge(a: DataFrame, b: DataFrame, keys: list[str], at: str, code: str, other_at: str = "other") -> DataFrame:
    """(keys, at, code, other): rows of ``a`` and ``b`` of the same keys aligned in order of ``at``. A row of ``a`` whose code
    is that of the next row of ``b`` not yet met is paired with it; else it is one too many, and has no ``other``. Rows of
    ``b`` that no row of ``a`` meets are given without ``at``. A null code meets nothing, so from there on nothing is paired.

    The walk is sequential within keys, a recording or session each, whose codes come together in a task."""
    schema = T.StructType([*(a.schema[k] for k in keys), T.StructField(at, a.schema[at].dataType), T.StructField(code, a.schema[code].dataType), T.StructField(other_at, b.schema[at].dataType)])
    picked = lambda df: df.select(*(F.col(c).alias(c) for c in [*keys, at, code])).where(F.col(at).isNotNull()).groupBy(*keys)

    def walk(key: tuple, x: pa.Table, y: pa.Table) -> pa.Table:
        order = [(at, "ascending"), (code, "ascending")]
        x, y = x.sort_by(order), y.sort_by(order)
        theirs, met, j = y.column(code).to_pylist(), [], 0
        for c in x.column(code).to_pylist():
            hit = j < len(theirs) and c is not None and c == theirs[j]
            met.append(j if hit else None)
            j += hit
        rest = y.slice(j)
        columns = {k: pa.array([v.as_py()] * (x.num_rows + rest.num_rows), v.type) for k, v in zip(keys, key)}
        columns[at] = pa.chunked_array([*x.column(at).chunks, pa.nulls(rest.num_rows, x.schema.field(at).type)])
        columns[code] = pa.chunked_array([*x.column(code).chunks, *(c.cast(x.schema.field(code).type) for c in rest.column(code).chunks)])
        columns[other_at] = pa.chunked_array([*y.column(at).take(pa.array(met, pa.int64())).chunks, *rest.column(at).chunks])
        return pa.table(columns)

    return picked(a).cogroup(picked(b)).applyInArrow(walk, schema)


def repaired_trials(bad: DataFrame, good: DataFrame, keys: list[str], trial: str, anchor: str, times: list[str]) -> DataFrame:
    """(keys, trial, times, repaired): the trials of ``good`` by the clock of ``bad``. Clocks differ by what ``anchor``, one of
    ``times``, differs by at the last trial of the keys that both have; trials that ``bad`` lacks, or whose anchor is null
    there, have the times of ``good`` moved by that, and null times where no trial is shared. Trials of ``bad`` alone stay."""
    own = bad.select(*keys, trial, *(F.col(t).alias(f"_b_{t}") for t in times))
    met = good.select(*keys, trial, *(F.col(t).alias(f"_g_{t}") for t in times)).join(own, [*keys, trial], "full")
    both = F.col(f"_b_{anchor}").isNotNull() & F.col(f"_g_{anchor}").isNotNull()
    last = F.max_by(F.when(both, F.col(f"_b_{anchor}") - F.col(f"_g_{anchor}")), F.when(both, F.col(trial)))
    moved = met.withColumn("_d", last.over(Window.partitionBy(*keys)))
    missing = F.col(f"_b_{anchor}").isNull()
    return moved.select(*keys, trial, *(F.when(missing, F.col(f"_g_{t}") + F.col("_d")).otherwise(F.col(f"_b_{t}")).alias(t) for t in times), missing.alias("repaired"))
