"""What is exploded in a task is never the side of a join that is sent through the driver."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import maps, spectral, windows
from tidemark.operators.spectral import Taper


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def trials(spark, n=6):
    rng = np.random.default_rng(5)
    return spark.createDataFrame([("all", i % 2, i // 2, rng.normal(size=64).tolist(), rng.normal(size=64).tolist()) for i in range(n)], "g string, ch long, trial long, x array<double>, y array<double>")


def test_jackknife_spectrum_sends_no_parts(spark):
    got = spectral.jackknife_spectrum(trials(spark), ["g"], "x", Taper())
    assert "BroadcastHashJoin" not in plan(got) and got.count() == 33


def test_jackknife_coherence_sends_no_parts(spark):
    got = spectral.jackknife_coherence(trials(spark), ["g"], "x", "y", Taper())
    assert "BroadcastHashJoin" not in plan(got) and got.count() == 33


def test_jackknife_joins_totals_of_many_keys(spark, monkeypatch):
    df, p = trials(spark), Taper()
    few = spectral.jackknife_spectrum(df, ["ch"], "x", p).orderBy("ch", "f").collect()
    monkeypatch.setattr(spectral, "BROADCAST_TOTALS", 0)
    many = spectral.jackknife_spectrum(df, ["ch"], "x", p).orderBy("ch", "f").collect()
    assert len(few) == 66 and np.allclose(np.array(few, float), np.array(many, float))


def test_coherence_matrix_sends_no_transforms(spark):
    got = spectral.coherence_matrix(trials(spark), ["g"], "trial", "ch", "x", Taper())
    assert "BroadcastHashJoin" not in plan(got) and got.count() == 33


def test_trials_are_summed_in_tasks(spark):
    df = spark.range(400, numPartitions=1).select(F.lit("a").alias("g"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.sin(i * F.col("id")).cast("double")).alias("x"))
    one = lambda x: (np.arange(64.0), len(x), x.sum(axis=0))
    sums = spectral._summed(df, ["g"], ["x"], ["s"], one)
    assert sums.where("n != 400").isEmpty() and sums.count() == 64
    spans = spectral.spectrogram(df, ["g"], "x", Taper(), 32, 16)
    assert "Generate" not in plan(spans) and spans.select("t").distinct().count() == 3


def test_significant_lines_only(spark):
    df, p = trials(spark), Taper(pad=1)
    all_lines = spectral.line_test(df, ["trial", "ch"], "x", p, 0.2).where("ratio > limit").orderBy("trial", "ch", "f").collect()
    assert all_lines and all_lines == spectral.line_test(df, ["trial", "ch"], "x", p, 0.2, found=True).orderBy("trial", "ch", "f").collect()


def test_running_line_joins_nothing(spark):
    df = spark.range(90).select((F.col("id") % 2).alias("k"), F.floor(F.col("id") / 2).alias("i"), F.sin("id").alias("v"))
    got = windows.running_line(df, "v", ["k"], "i", 10, 4)
    assert "Join" not in plan(got) and plan(got).count("Exchange hashpartitioning") == 1 and got.count() == 90


def test_drawn_places_are_not_broadcast(spark):
    foci = spark.range(400).select((F.col("id") % 3).alias("s"), (F.col("id") % 7).cast("int").alias("x"), (F.col("id") % 11).cast("int").alias("y"))
    drawn = maps.placed(foci, foci, ["x", "y"], "s", 4)
    assert "BroadcastHashJoin [_n" in plan(drawn) and "BuildLeft" not in plan(drawn) and drawn.count() == 1600


def test_signals_leave_a_worker_in_pieces(spark, monkeypatch):
    from tidemark.operators import batches, signals, tracking

    df = spark.createDataFrame([(i, None if i == 3 else [] if i == 4 else [float(i + j % 5) for j in range(20)]) for i in range(9)], "i long, x array<double>").coalesce(1)
    whole = df.select("i", signals.smooth("x", 3).alias("s"), tracking.tracked("x", 50.0, 3).alias("t")).orderBy("i").collect()
    monkeypatch.setattr(batches, "BATCH_BYTES", 1)
    f = batches.pieces_of([None if r.s is None else np.array(r.s) for r in whole])
    assert [b - a for a, b in f] == [1, 1, 1, 3, 1, 1, 1]
    assert whole[3].s is None and whole[4].s == [] and whole[3].t is None and len(whole[5].t) == 20


def test_dense_arrays_build_a_map_once(spark):
    from tidemark.plans import numeric

    df = spark.createDataFrame([(1, 0, 2.0), (1, 3, 4.0), (2, 1, 1.0)], "u long, h int, v double")
    got = numeric.dense(df, ["u"], 4, x=F.struct("h", "v"))
    assert {r.u: r.x for r in got.collect()} == {1: [2.0, 0.0, 0.0, 4.0], 2: [0.0, 1.0, 0.0, 0.0]}
    loop = got._jdf.queryExecution().optimizedPlan().toString()
    assert "element_at(map_from_entries" not in loop and "element_at(_x" in loop
