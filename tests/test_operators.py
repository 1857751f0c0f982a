"""Edges of the relational operators: nulls, ties, repeated rows, empty tables, clashing names."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bins, intervals, sets, stats, windows


@pytest.fixture(scope="module")
def trains(spark):
    return spark.createDataFrame([("a", 0), ("a", 10), ("a", 10), ("a", 25), ("b", 5), ("b", None), (None, 7)], "k string, t long")


@pytest.mark.parametrize("closed,want", [("left", {0, 10}), ("right", {10, 20}), ("both", {0, 10, 20}), ("neither", {10})])
@pytest.mark.parametrize("width", [1, 7, 1000])
def test_interval_bounds_do_not_depend_on_buckets(spark, closed, want, width):
    p = spark.createDataFrame([("a", t) for t in (-5, 0, 10, 20, 21)], "k string, t long")
    i = spark.createDataFrame([("a", 0, 20), ("a", 30, 10), ("b", 0, 99)], "k string, s long, e long")
    got = [r.t for r in intervals.range_join(p, i, "t", "s", "e", width, ["k"], closed).collect()]
    assert sorted(got) == sorted(want)


def test_peri_event_counts_each_pair(spark, trains):
    m = spark.createDataFrame([("a", 10), ("a", 11)], "k string, m long")
    got = sorted((r.t, r.m, r.lag) for r in intervals.peri_event(trains, m, "t", "m", 1, 1, ["k"]).collect())
    assert got == [(10, 10, 0), (10, 10, 0), (10, 11, -1), (10, 11, -1)]


def test_segments_and_gaps(spark):
    df = spark.createDataFrame([("a", t, c) for t, c in ((0, 1), (1, 9), (5, 2), (6, 9), (50, 3))], "k string, t long, c int")
    seg = intervals.segment_by_marker(df, F.col("c") == 9, "t", ["k"]).orderBy("t").collect()
    assert [r.segment for r in seg] == [0, 1, 1, 2, 2]
    parts = intervals.split_by_gap(df, "t", ["k"], 10).orderBy("t").collect()
    assert [r.part for r in parts] == [0, 0, 0, 0, 1]
    last = intervals.asof_last(df, F.col("c") == 9, "t", ["k"], F.col("t"), "m").orderBy("t").collect()
    assert [r.m for r in last] == [None, 1, 1, 6, 6]


def test_bins_leave_out_what_is_not_a_number(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (float("nan"),), (None,), (-1.0,)], "v double")
    assert {r.bin: r.n for r in bins.histogram(df, "v", 1.0, stop=2.0).collect()} == {0: 2, 1: 1}
    d = spark.createDataFrame([(1.0, 2.0), (1.0, float("inf")), (3.0, 1.0), (9.0, 1.0), (None, 1.0)], "k double, v double")
    assert {r.key: r.total for r in bins.conditional_sum(d, "k", "v", 3).collect()} == {1: 2.0, 2: 0.0, 3: 1.0}


def test_shift_predictor_is_the_mean_over_pairs_of_trials(spark):
    a, b = [(1, 0), (1, 2), (2, 1)], [(1, 1), (2, 1), (3, 0)]
    df = lambda rows: spark.createDataFrame(rows, "trial long, t long")
    got = {r.lag: r["mean"] for r in bins.shift_predictor(df(a), df(b), "t", "trial", 1, 3).collect()}
    want = {}
    for i, x in a:
        for j, y in b:
            want[x - y] = want.get(x - y, 0) + (i != j) / 6
    assert {k: round(v, 9) for k, v in got.items() if v} == {k: round(v, 9) for k, v in want.items() if v}


def test_transforms_over_null_keys_and_constant_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), (None, 2.0), (None, 4.0), ("c", None)], "k string, v double")
    z = {(r.k, r.v): r.z for r in windows.z_transform(df, "v", ["k"]).collect()}
    assert len(z) == 6 and abs(z[("a", 3.0)] - 0.7071067811865475) < 1e-12 and z[("b", 5.0)] == 0 and z[("c", None)] == 0 and z[(None, 2.0)] < 0
    p = {(r.k, r.v): r.psc for r in windows.percent_signal_change(df, "v", ["k"]).collect()}
    assert p[("a", 3.0)] == 150 and p[("b", 5.0)] == 100
    assert windows.z_transform(df, "v", []).count() == 6
    ranks = sorted((r.v, r["rank"]) for r in windows.rank_transform(spark.createDataFrame([("a", v) for v in (1.0, 2.0, 2.0, 9.0)], "k string, v double"), "v", ["k"]).collect())
    assert ranks == [(1.0, 1.0), (2.0, 2.5), (2.0, 2.5), (9.0, 4.0)]


def test_sets(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id long, v string")
    b = spark.createDataFrame([(2, "z"), (3, None), (4, "w")], "id long, v string")
    assert {r.id: r.status for r in sets.compare(a, b, ["id"], "v").collect()} == {1: "only_left", 2: "differs", 3: "equal", 4: "only_right"}
    assert sorted((r.id, r.v) for r in sets.update_by_id(a, b, "id").collect() if r.v) == [(1, "x"), (2, "z")]
    assert sets.union_aligned(a, b.withColumn("w", F.lit(1))).where("w is null").count() == 3
    names = spark.createDataFrame([("Some%Name",), ("someXname",)], "n string")
    assert [r.n for r in names.where(sets.text_equal("n", "some%*")).collect()] == ["Some%Name"]


def test_statistics_of_too_few_rows(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", None, None)], "k string, v double, w double")
    assert {r.k: r.t for r in stats.one_sample_t(df, "v", ["k"]).collect()} == {"a": 0.0, "b": 0.0}
    assert stats.one_sample_t(df.limit(0), "v", ["k"]).count() == 0
    assert stats.fdr(df.limit(0), "v", ["k"], 0.05).count() == 0
    p = spark.createDataFrame([("a", x) for x in (0.01, 0.02, 0.03, 0.5)] + [("b", 0.9)], "k string, p double")
    assert {r.k: round(r.threshold, 6) for r in stats.fdr(p, "p", ["k"], 0.05).collect()} == {"a": 0.03, "b": round(0.9 / 2.001, 6)}
