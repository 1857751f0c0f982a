"""Hard negatives against all pairs in Python's integers."""

import math
import random

import numpy as np
import pytest

from tidemark.llm import hard_negatives
from tidemark.llm.hard_negatives import op12_hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, id long, x string, slot int"
COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute(rows):
    """rows: (vec_id, vector, label)."""
    use = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        use.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out = []
    for i, label, v in use:
        if i % 100:
            continue
        others = [(max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), j, other) for j, other, w in use if len(w) == len(v)]
        positives = sorted([(-s, j) for s, j, other in others if other == label and j != i])[:5]
        for p, j in positives:
            negatives = sorted((-s, k) for s, k, other in others if other != label and 80 * -p <= 100 * s <= 100 * -p)[:5]
            out += [(i, j, r, k, -p, -n) for r, (n, k) in enumerate(negatives, 1)]
    return sorted(out)


def told(spark, rows, tmp_path):
    spark.createDataFrame([(*r, 1, "y", 2) for r in rows], SCHEMA).repartition(5).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    got = op12_hard_negatives(spark, str(tmp_path))
    assert set(got.columns) == set(COLUMNS)
    return sorted(tuple(r[c] for c in COLUMNS) for r in got.collect())


def vectors(n, seed, size=1.0, length=6, ids=lambda i: 10 * i):
    rng = random.Random(seed)
    return [(ids(i), [rng.uniform(0, 1) * size for _ in range(length)], rng.randrange(3)) for i in range(n)]


def test_all_pairs(spark, tmp_path):
    rows = vectors(220, 1)
    got = told(spark, rows, tmp_path)
    assert got == brute(rows) and len(got) > 100


def test_several_blocks_and_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 4)
    monkeypatch.setattr(hard_negatives, "PIECE", 16)
    rows = vectors(200, 2)
    assert told(spark, rows, tmp_path) == brute(rows)


def test_ties_and_repeated_rows(spark, tmp_path):
    rng = random.Random(3)
    rows = [(10 * i, [float(rng.randrange(2)) for _ in range(3)], rng.randrange(2)) for i in range(60)]
    rows += [rows[3], rows[10], (100, [1.0, 1.0, 1.0], 0)]
    assert told(spark, rows, tmp_path) == brute(rows)


def test_nulls_lengths_and_signs(spark, tmp_path):
    rows = vectors(80, 4) + vectors(40, 5, length=2, ids=lambda i: 10 * i + 5000) + [(100 * i, [], i % 2) for i in range(90, 94)]
    rows = [(i, [-x for x in v] if i % 40 == 0 else v, label) for i, v, label in rows]
    rows += [(None, [1.0] * 6, 1), (300, None, 1), (400, [None] + [1.0] * 5, 1), (500, [math.nan] + [1.0] * 5, 1), (600, [math.inf] + [1.0] * 5, 1), (700, [1.0] * 6, None)]
    got = told(spark, rows, tmp_path)
    assert got == brute(rows) and any(r[4] == 0 for r in got)


@pytest.mark.parametrize("size", [2.0**20, 2.0**22, 1e12, 1e30])
def test_large_components_stay_exact(spark, tmp_path, size):
    rows = vectors(60, 6, size) + vectors(30, 7, 1.0, ids=lambda i: 10 * i + 3000)
    assert told(spark, rows, tmp_path) == brute(rows)


def test_empty_and_without_anchors(spark, tmp_path):
    assert told(spark, [], tmp_path) == []
    assert told(spark, [(1, [1.0], 1), (2, [1.0], 1)], f"{tmp_path}/b") == []


def test_lists_merge_in_any_order():
    rng = np.random.default_rng(8)
    slot, score, id = rng.integers(0, 5, 400), rng.integers(-4, 4, 400), rng.permutation(400)
    once, parts = hard_negatives.Best(5, 3), hard_negatives.Best(5, 3)
    once.add(slot, score, id)
    for k in np.array_split(rng.permutation(400), 7):
        b = hard_negatives.Best(5, 3)
        b.add(slot[k], score[k], id[k])
        parts.add(b.slot, b.score, b.id)
    assert all((a == b).all() for a, b in ((once.slot, parts.slot), (once.score, parts.score), (once.id, parts.id)))


def test_whole_table(spark, data):
    rows = [(r.vec_id, list(map(float, r.embedding)), r.label) for r in spark.read.parquet(f"{data}/sf0.01/embeddings.parquet").collect()]
    assert sorted(tuple(r[c] for c in COLUMNS) for r in op12_hard_negatives(spark, f"{data}/sf0.01").collect()) == brute(rows)
