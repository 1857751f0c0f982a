"""Stateful streams under a watermark: rows in any order within the bound give what a batch in order gives."""

import datetime

import numpy as np
import pytest
from test_tracking import signal, walk

from tidemark.operators import waveforms
from tidemark.streaming import events as streams

START = datetime.datetime(2024, 1, 1)


def run(spark, folder, name, batches, schema, f):
    """Each batch is a file and a micro-batch."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}/{i:03d}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{folder}/{name}/*")
    q = f(source).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/{name}-state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return spark.table(name).collect()


SCHEMA = "k string, t long, code int, at timestamp"


def shuffled(rows, seed, bound, parts):
    """Rows dealt to batches so that each comes at most ``bound`` seconds after a later one, and at last a row that moves
    the watermark on."""
    rng = np.random.default_rng(seed)
    order = sorted(range(len(rows)), key=lambda i: rows[i][1] + rng.uniform(0, bound))
    out = [[(*rows[i], START + datetime.timedelta(seconds=rows[i][1])) for i in part] for part in np.array_split(order, parts)]
    far = lambda s: [("zz", s, 5, START + datetime.timedelta(seconds=s))]
    return [*out, far(50_000), far(60_000)]


@pytest.fixture(scope="module")
def events():
    rng = np.random.default_rng(3)
    return [(k, int(t), int(rng.integers(0, 6))) for k in "ab" for t in np.sort(rng.choice(3000, 150, replace=False))]


def test_refractory_in_any_order(spark, tmp_path, events):
    got = run(spark, tmp_path, "w_refractory", shuffled(events, 1, 50, 6), SCHEMA, lambda s: streams.refractory(s, "t", ["k"], 30, "at", "60 seconds"))
    batch = waveforms.keep_after_refractory(spark.createDataFrame(events, "k string, t long, code int"), "t", ["k"], 30)
    assert sorted((r.k, r.t) for r in got if r.k != "zz") == sorted((r.k, r.t) for r in batch.collect())


def test_segments_in_any_order_and_late_rows(spark, tmp_path, events):
    late = ("a", 1, 3, START + datetime.timedelta(seconds=1))
    batches = shuffled(events, 2, 50, 5)
    got = run(spark, tmp_path, "w_segments", [*batches, [late]], SCHEMA, lambda s: streams.segments(s, "t", "code", ["k"], 0, "at", "60 seconds"))
    want, n = [], {}
    for k, t, code in sorted(events):
        n[k] = n.get(k, 0) + (code == 0)
        if code and n[k]:
            want.append((k, t, code, n[k]))
    assert sorted((r.k, r.t, r.code, r.trial) for r in got if r.k != "zz") == sorted(want)


def test_keys_end_after_a_while(spark, tmp_path):
    """A key begins anew when it was idle, so that its stretches do too."""
    at = lambda s: START + datetime.timedelta(seconds=s)
    rows = [[("a", 0, 0, at(0)), ("a", 100, 0, at(100))], [("zz", 9000, 0, at(9000))], [("zz", 9001, 0, at(9001))], [("a", 9100, 0, at(9100))], [("zz", 99_000, 0, at(99_000))], [("zz", 99_001, 0, at(99_001))]]
    got = run(spark, tmp_path, "w_idle", rows, SCHEMA, lambda s: streams.stretches(s, "t", ["k"], 10, "at", "10 seconds", "20 minutes"))
    assert sorted((r.t, r.stretch) for r in got if r.k == "a") == [(0, 0), (100, 1), (9100, 0)]


@pytest.mark.parametrize("parts,bound", [(4, 0), (9, 40)])
def test_running_fit_across_chunks(spark, tmp_path, parts, bound):
    """Two channels, one with a gap, in chunks of any size and order; ends come when the keys are idle."""
    x, y = signal(1), signal(2)
    rows = [("x", i, float(v)) for i, v in enumerate(x)] + [("y", i if i < 700 else i + 50, float(v)) for i, v in enumerate(y)]
    rng = np.random.default_rng(parts)
    order = sorted(range(len(rows)), key=lambda i: rows[i][1] + rng.uniform(0, bound))
    at = lambda i: START + datetime.timedelta(seconds=int(i))
    batches = [[(*rows[i], at(rows[i][1])) for i in part] for part in np.array_split(order, parts)]
    batches += [[("zz", s, 0.0, at(s))] for s in (80_000, 160_000)]
    got = run(spark, tmp_path, f"w_fit_{parts}", batches, "k string, i long, v double, at timestamp", lambda s: streams.without_drift(s, "i", "v", ["k"], 1.5, "at", "60 seconds", half=20, low=-90.0, high=90.0))
    given = (1.5, 20, -90, 90, 5, 5, 15)
    want = {("x", i): v for i, v in enumerate(walk(x, *given))} | {("y", i): v for i, v in enumerate(walk(y[:700], *given))} | {("y", i + 750): v for i, v in enumerate(walk(y[700:], *given))}
    found = {(r.k, r.i): np.nan if r.clean is None else r.clean for r in got if r.k != "zz"}
    assert found.keys() == want.keys() and len(got) - len(found) < 3
    assert np.allclose([found[k] for k in want], list(want.values()), equal_nan=True, atol=1e-8)
