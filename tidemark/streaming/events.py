"""Structured Streaming counterparts: windowed counts, trial segments, pauses, refractory removal and running fits with
kept state.

Windowed counts are built-in aggregations under a watermark. The stateful ones depend on the order of rows. With ``late``
(and ``time``, a timestamp column) a key's rows are kept until the watermark has passed them and are then taken in order of
time, so rows may come in any order within that bound; Spark drops those that come later. A key without rows for more than
``idle`` is ended: what it still holds is given and its state removed, and rows after that begin anew. Without ``late`` nothing is kept back: rows must come in order, and state stays as long as the query.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.tracking import Tracker


def windowed_counts(events: DataFrame, at: str, keys: list[str], length: str, step: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(keys, start, end, n) of fixed windows, or of hopping ones every ``step``."""
    w = F.window(at, length, step) if step else F.window(at, length)
    return events.withWatermark(at, late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def session_counts(events: DataFrame, at: str, keys: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """(keys, start, end, n) of stretches without a pause of ``gap``."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


Step = Callable[[pd.DataFrame, object], tuple[pd.DataFrame, object]]


def _stateful(events: DataFrame, keys: list[str], columns: list[str], extra: str, step: Step, time: str | None, late: str | None, idle: str, finish: Callable[[object], pd.DataFrame] | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """Rows of each key in order go through ``step`` with what it left the last time (None at first). Rows give the columns,
    without those of ``drop``, and ``extra``; ``finish`` gives what is held when a key ends."""
    given = [c for c in columns if c not in drop]
    fields = ", ".join([*(f"`{c}` {events.schema[c].dataType.simpleString()}" for c in [*keys, *given]), *([extra] if extra else [])])
    if late and not time:
        raise ValueError("a watermark needs a column of time")
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def named(out: pd.DataFrame, key: tuple) -> pd.DataFrame:
        for k, v in zip(keys, key):
            out[k] = v
        return out[[*keys, *[c for c in out.columns if c not in (*keys, *drop, "_us")]]]

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        waiting, inner, last = pickle.loads(held.get[0]) if held.exists else (None, None, 0)
        rows = pd.concat([x for x in ([waiting] if waiting is not None else []) + list(batches) if len(x)] or [pd.DataFrame()])
        mark = held.getCurrentWatermarkMs() if late else None
        if held.hasTimedOut and not len(rows):
            held.remove()
            if finish is not None and inner is not None:
                yield named(finish(inner), key)
            return
        if late and len(rows):
            ready = rows["_us"] <= mark * 1000
            rows, waiting = rows[ready], rows[~ready]
        else:
            waiting = None
        if len(rows):
            rows = rows.sort_values(["_us", *columns] if late else columns[:1], kind="stable")
            parts = [rows]
            if late:  # where a key was idle it ends, in whatever batches its rows came
                before = np.r_[last if inner is not None else int(rows["_us"].iloc[0] // 1000), rows["_us"].to_numpy()[:-1] // 1000]
                starts = np.flatnonzero(rows["_us"].to_numpy() // 1000 - before > idle_ms).tolist()
                parts = [rows.iloc[a:b] for a, b in zip([0, *starts], [*starts, len(rows)])]
                last = int(rows["_us"].iloc[-1] // 1000)
            for k, part in enumerate(parts):
                if k:
                    if finish is not None and inner is not None:
                        yield named(finish(inner), key)
                    inner = None
                if len(part):
                    out, inner = step(part[columns], inner)
                    yield named(out, key)
        held.update((pickle.dumps((waiting, inner, last)),))
        if late:
            at = int(waiting["_us"].min() // 1000) if waiting is not None and len(waiting) else last + idle_ms
            held.setTimeoutTimestamp(max(at, mark) + 1)

    rows = events.withWatermark(time, late) if late else events
    names = [*keys, *[c for c in columns if c not in keys]]
    picked = rows.select(*names, *([F.unix_micros(time).alias("_us")] if late else []), *([time] if late and time not in names else []))
    return picked.groupBy(*keys).applyInPandasWithState(run, fields, "held binary", "append", GroupStateTimeout.EventTimeTimeout if late else GroupStateTimeout.NoTimeout)


def refractory(events: DataFrame, at: str, keys: list[str], gap: int, time: str | None = None, late: str | None = None, idle: str = "1 hour") -> DataFrame:
    """Events more than ``gap`` after the last one kept of their key; ``at`` is a whole number."""

    def step(rows: pd.DataFrame, last) -> tuple[pd.DataFrame, object]:
        keep = []
        for t in rows[at]:
            ok = last is None or t - last > gap
            keep.append(ok)
            last = int(t) if ok else last
        return rows[keep].copy(), last

    return _stateful(events.where(F.col(at).isNotNull()), keys, [at], "", step, time, late, idle)


def segments(events: DataFrame, at: str, code: str, keys: list[str], marker: int, time: str | None = None, late: str | None = None, idle: str = "1 hour") -> DataFrame:
    """Events with ``trial``: how many markers their key has had; markers themselves and what comes before the first are
    left out."""

    def step(rows: pd.DataFrame, n) -> tuple[pd.DataFrame, object]:
        trial = (n or 0) + (rows[code] == marker).cumsum()
        out = rows.assign(trial=trial.astype("int64"))
        return out[(out[code] != marker) & (out["trial"] > 0)].copy(), int(trial.iloc[-1])

    return _stateful(events.where(F.col(at).isNotNull()), keys, [at, code], "trial long", step, time, late, idle)


def stretches(events: DataFrame, at: str, keys: list[str], gap: int, time: str | None = None, late: str | None = None, idle: str = "1 hour") -> DataFrame:
    """Events with ``stretch``, which grows after each pause of more than ``gap``."""

    def step(rows: pd.DataFrame, held) -> tuple[pd.DataFrame, object]:
        last, n = held or (None, 0)
        before = rows[at].shift()
        if last is not None:
            before.iloc[0] = last
        n_of = n + ((rows[at] - before) > gap).cumsum()
        return rows.assign(stretch=n_of.astype("int64")), (int(rows[at].iloc[-1]), int(n_of.iloc[-1]))

    return _stateful(events.where(F.col(at).isNotNull()), keys, [at], "stretch long", step, time, late, idle)


def without_drift(samples: DataFrame, at: str, value: str, keys: list[str], noise: float, time: str | None = None, late: str | None = None, idle: str = "1 hour", **given) -> DataFrame:
    """Samples less a running cubic fit: (keys, at, clean), null where the fit leaves them out (tracking.Tracker, to which
    ``given`` goes). ``at`` numbers the samples of a key; where numbers are missing a signal ends and another begins, and
    one that repeats is left out. Samples come out as soon as later ones, or the key's end, have settled them."""

    def told(clean: np.ndarray, first: int) -> pd.DataFrame:
        return pd.DataFrame({at: np.arange(first, first + len(clean), dtype=np.int64), "clean": [None if np.isnan(v) else float(v) for v in clean]})

    def step(rows: pd.DataFrame, held) -> tuple[pd.DataFrame, object]:
        tracker, origin, fed = held or (None, 0, 0)
        rows = rows.drop_duplicates(at)
        numbers, values = rows[at].to_numpy(np.int64), rows[value].to_numpy(float)
        if tracker is not None:
            numbers, values = numbers[numbers >= fed], values[numbers >= fed]
        out = []
        for part in np.split(np.arange(len(numbers)), np.flatnonzero(np.diff(numbers) != 1) + 1):
            if not len(part):
                continue
            if tracker is not None and numbers[part[0]] != fed:
                out.append(finish((tracker, origin, fed)))
                tracker = None
            if tracker is None:
                tracker, origin = Tracker(noise, **given), int(numbers[part[0]])
            first = origin + tracker.next
            out.append(told(tracker.feed(values[part]), first))
            fed = int(numbers[part[-1]]) + 1
        return pd.concat(out) if out else told(np.zeros(0), 0), (tracker, origin, fed)

    def finish(held) -> pd.DataFrame:
        tracker, origin, _ = held
        first = origin + tracker.next
        return told(tracker.feed(np.zeros(0), True), first)

    rows = samples.where(F.col(at).isNotNull() & F.col(value).isNotNull()).withColumn(at, F.col(at).cast("long"))
    return _stateful(rows, keys, [at, value], "clean double", step, time, late, idle, finish, (value,))
