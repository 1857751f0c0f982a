"""The factorisation machine against explicit pairs, statistics of texts, and accuracy on documents held out."""

import math

import numpy as np
import pytest

from tidemark.llm import quality
from tidemark.llm.quality import FACTORS, STATISTICS, WORDS, Machine, Sparse, describe


def some(seed=1, rows=9, places=40):
    rng = np.random.default_rng(seed)
    size = rng.integers(1, 12, rows)
    place = np.concatenate([rng.choice(places, n, replace=False) for n in size])
    x = Sparse(np.cumsum(np.r_[0, size[:-1]]), place, rng.normal(size=len(place)))
    return x, Machine(0.3, rng.normal(size=places), rng.normal(size=(places, FACTORS))), size


def test_sum_of_squares_is_the_sum_over_pairs():
    x, m, size = some()
    for r, (s, n) in enumerate(zip(x.starts, size)):
        at, v = x.place[s : s + n], x.value[s : s + n]
        want = m.bias + m.weight[at] @ v + sum(m.factor[at[i]] @ m.factor[at[j]] * v[i] * v[j] for i in range(n) for j in range(i))
        assert m.parts(x)[0][r] == pytest.approx(want)
        assert m.score(x)[r] == pytest.approx(1 / (1 + math.exp(-want)))


def test_rows_are_taken_in_the_order_asked():
    x, m, _ = some()
    which = np.array([3, 0, 8, 3])
    assert m.score(x.rows(which)) == pytest.approx(m.score(x)[which])


def test_training_learns_a_pair_that_no_single_word_tells():
    """The label is whether two words stand together or neither does."""
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 2, 600), rng.integers(0, 2, 600)
    x = Sparse(np.arange(0, 1200, 2), np.stack([a, 2 + b], axis=1).ravel(), np.ones(1200))
    y = (a == b).astype(float)
    m = quality.train(x, y, np.ones(600), 4, epochs=60)
    assert ((m.score(x) > 0.5) == (y == 1)).all()


def test_statistics():
    s, h = describe("One TWO two.\nOne TWO two.\n### 12", 31, {})
    got = dict(zip(STATISTICS, s))
    assert got["words"] == math.log2(9) and got["distinct"] == 5 / 8 and got["most_frequent"] == 2 / 8
    assert got["upper"] == 8 / 18 and got["digits"] == 2 / 25 and got["symbols"] == 3 / 25 and got["marks"] == 2 / 25
    assert got["lines_repeated"] == 1 / 3 and got["lines_ended"] == 2 / 3 and got["declared"] == 5
    assert sum(h.values()) == 8 and all(0 <= k < WORDS for k in h)


@pytest.mark.parametrize("text", [None, "", " \n\t "])
def test_texts_without_words(text):
    s, h = describe(text, None, {})
    assert s == [0.0] * 11 + [-1.0] and h == {}


def test_pieces_make_no_difference(monkeypatch):
    text = "\n".join(f"line {i % 7} of ÄÖ words, with marks." for i in range(300))
    whole = describe(text, 3, {})
    monkeypatch.setattr(quality, "PIECE", 100)
    assert describe(text, 3, {}) == whole
    assert "".join(quality._pieces("x" * 250 + " y")) == "x" * 250 + " y"


def test_held_out_accuracy(spark, data):
    got = quality.op11_quality(spark, f"{data}/sf0.1")
    labels = spark.read.parquet(f"{data}/sf0.1/labels.parquet").select("doc_id", "quality")
    rows = got.where("held_out").join(labels, "doc_id").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert len(bad) > 50 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert sum(r.predicted == 1 for r in good) / len(good) > 0.99
    assert sum(r.predicted == 0 for r in bad) / len(bad) > 0.95


def test_awkward_rows_in_any_partitioning(spark, awkward):
    labels = spark.createDataFrame([(1, 1), (5, 0), (8, 1), (9, 0), (10, 0), (12, 0), (None, 1), (3, None), (77, 1)], "doc_id long, quality int")
    told = []
    for n in (1, 6):
        docs = awkward.repartition(n)
        out = quality.score(docs, quality.fit(*quality.sample_of(docs, labels)))
        assert out.columns == ["doc_id", "score", "predicted"]
        told.append(sorted((str(r.doc_id), round(r.score, 9)) for r in out.collect()))
    assert told[0] == told[1] and len(told[0]) == awkward.count() and all(0 <= s <= 1 for _, s in told[0])


@pytest.mark.parametrize("labels,want", [([], 0.0), ([(1, 1), (5, 1)], 1.0), ([(1, 0)], 0.0), ([(77, 1), (78, 0)], 0.5)])
def test_without_both_classes(spark, awkward, labels, want):
    model = quality.fit(*quality.sample_of(awkward, spark.createDataFrame(labels, "doc_id long, quality int")))
    assert {r.score for r in quality.score(awkward, model).collect()} == {want}


def test_empty_table(spark, empty):
    model = quality.fit(*quality.sample_of(empty, spark.createDataFrame([(1, 1)], "doc_id long, quality int")))
    assert quality.score(empty, model).collect() == []
