"""Components: few rounds where tasks can contract what they hold, and the same labels as by hand."""

import numpy as np
import pytest

from tidemark.operators import maps


def closure(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        u, v = find(a), find(b)
        root[max(u, v)] = min(u, v)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("held", [500_000, 7])
def test_components(spark, monkeypatch, held):
    monkeypatch.setattr(maps, "CONTRACTED", held)
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(-400, 400, (350, 2))] + [(900, 900), (900, 900), (7, 7), (-(2**63), 2**63 - 1)]
    got = maps.connected(spark.createDataFrame([*edges, (None, 3)], "a long, b long").repartition(3)).collect()
    assert {r.node: r.label for r in got} == closure(edges) and len(got) == len(closure(edges))


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    calls, plain = [], maps.checkpoint
    monkeypatch.setattr(maps, "checkpoint", lambda df: calls.append(1) or plain(df))
    chain = [(int(x), int(x) + 1) for x in np.random.default_rng(1).permutation(3000)]
    labels = maps.connected(spark.createDataFrame(chain, "a long, b long").coalesce(1))
    assert labels.count() == 3001 and labels.where("label != 0").isEmpty() and len(calls) <= 4


def test_rounds_move_an_edge_a_node(spark, monkeypatch):
    """Edges that are dealt over many tasks, many to a node, as those of a large group of near copies."""
    sizes, plain, was = [], maps.checkpoint, spark.conf.get("spark.sql.shuffle.partitions")

    def counted(df):
        sizes.append((out := plain(df)).count())
        return out

    monkeypatch.setattr(maps, "checkpoint", counted)
    edges = [(a, b) for a in range(40) for b in range(100, 400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        got = maps.connected(spark.createDataFrame(edges, "a long, b long").repartition(200)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.node: r.label for r in got} == closure(edges) and len(got) == 340
    assert max(sizes) < 340 + 24 * 40


def test_chains_that_interleave_take_few_rounds(spark, monkeypatch):
    calls, plain, was = [], maps.checkpoint, spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(maps, "checkpoint", lambda df: calls.append(1) or plain(df))
    edges = [(k, k + 2) for k in range(400)] + [(400, 500), (401, 500)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = maps.connected(spark.createDataFrame(edges, "a long, b long").repartition(60)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.node: r.label for r in got} == closure(edges) and len(calls) <= 24


def test_later_rounds_write_few_files(spark, monkeypatch):
    tasks, plain, was = [], maps.checkpoint, spark.conf.get("spark.sql.shuffle.partitions")

    def counted(df):
        tasks.append((out := plain(df)).rdd.getNumPartitions())
        return out

    monkeypatch.setattr(maps, "checkpoint", counted)
    edges = [(k, k + 2) for k in range(400)] + [(400, 500), (401, 500)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = maps.connected(spark.createDataFrame(edges, "a long, b long").repartition(60)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.node: r.label for r in got} == closure(edges) and len(tasks) > 2 and set(tasks[1:]) == {1}
