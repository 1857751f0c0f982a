"""Arrow and pandas batches in pieces of bounded size, so that what a worker holds depends on no session setting."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of Arrow data that are worked on at once.
BATCH_BYTES = 4 << 20
#: Samples of equally long arrays that are stacked at once.
STACK = 1 << 16


def sliced(batches: Iterator[pa.RecordBatch], limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most ``limit`` bytes or one row."""
    for batch in batches:
        left = [batch]
        while left:
            part = left.pop()
            if part.nbytes > limit and part.num_rows > 1:
                half = part.num_rows // 2
                left += [part.slice(half), part.slice(0, half)]
            elif part.num_rows:
                yield part


def ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, starts, values) of arrays of numbers; null arrays have no length, null numbers are nan."""
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return n, np.cumsum(n) - n, column.flatten().to_numpy(zero_copy_only=False)


def stacks(batches: Iterator[pa.RecordBatch], keys: int, inputs: int) -> Iterator[tuple[tuple, pa.RecordBatch, np.ndarray, list[np.ndarray]]]:
    """(key, batch, places, arrays) of rows with equal keys (the first columns) and equal lengths of their arrays (the next
    ones), stacked as (rows, samples); rows with a null or empty array are left out."""
    for batch in sliced(batches):
        arrays = [ragged(c) for c in batch.columns[keys : keys + inputs]]
        names = list(zip(*(c.to_pylist() for c in batch.columns[:keys]))) if keys else [()] * batch.num_rows
        groups: dict[tuple, list[int]] = {}
        for i, group in enumerate(zip(names, zip(*(a[0].tolist() for a in arrays)))):
            if all(group[1]):
                groups.setdefault(group, []).append(i)
        for (key, lengths), rows in groups.items():
            most = max(1, STACK // max(lengths))
            for at in range(0, len(rows), most):
                places = np.array(rows[at : at + most])
                yield key, batch, places, [values[starts[places][:, None] + np.arange(n)] for n, (_, starts, values) in zip(lengths, arrays)]


def pieces_of(rows: Sequence[np.ndarray | None]) -> list[tuple[int, int]]:
    """Borders [a, b) of pieces that end where BATCH_BYTES of numbers are reached."""
    sizes = np.array([0 if v is None else 8 * len(v) for v in rows], np.int64)
    out, at, held = [], 0, 0
    for i, size in enumerate(sizes.tolist()):
        held += size
        if held >= BATCH_BYTES or i == len(sizes) - 1:
            out.append((at, i + 1))
            at, held = i + 1, 0
    return out


def mapped(f: Callable[[np.ndarray], object], x: Column | str) -> Column:
    """f over each array of numbers, an array of numbers; null stays null, empty stays empty. Results leave the worker by
    pieces of the session's batches."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            rows = batch.to_numpy()
            for a, b in pieces_of(rows) or [(0, 0)]:
                yield pd.Series([None if v is None else f(np.asarray(v, float)) if len(v) else [] for v in rows[a:b]], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<double>")(F.col(x).cast("array<double>") if isinstance(x, str) else x.cast("array<double>"))
