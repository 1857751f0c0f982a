import random

import numpy as np
import pytest
from cases import plain_words, words_of

from tidemark.llm import jaccard_join
from tidemark.operators.maps import connected


def shingles(text, size):
    w = plain_words(text)
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, size, percent):
    """Set size and least linked id of each row, from all pairs."""
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                o = len(a & b)
                if 100 * o >= percent * (len(a) + len(b) - o) and (x := find(i)) != (y := find(j)):
                    root[x] = y
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)]


def check(spark, rows, size, percent):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, size=size, percent=percent).collect())
    assert got == sorted(brute(rows, size, percent))


def test_query_against_all_pairs(spark, data, texts):
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.op3_jaccard_join(spark, f"{data}/sf0.001").collect())
    want = sorted(brute(texts, 3, 90))
    assert got == want and any(d != c for d, _, c in want)


def test_five_words_and_similarity_of_eight_tenths(spark, texts):
    check(spark, texts, 5, 80)


def near_copies(seed, sizes, copies):
    rng, rows = random.Random(seed), []
    for n in sizes:
        base = words_of(n, rng.random())
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, max(1, n // 25))):
                k = rng.randrange(len(w))
                if rng.random() < 0.5:
                    w[k] = "changed" + str(rng.randrange(9))
                else:
                    w.insert(k, "new" + str(rng.randrange(9)))
            rows.append((len(rows), " ".join(w)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("percent,size", [(90, 3), (80, 5)])
def test_near_copies_of_all_sizes(spark, percent, size):
    check(spark, near_copies(percent, [1, 2, 3, 4, 5, 6, 8, 11, 17, 30, 55, 120, 400, 1500], 12), size, percent)


@pytest.mark.parametrize("tokens", [600, 150])
def test_blocks_of_a_large_component(spark, monkeypatch, tokens):
    monkeypatch.setattr(jaccard_join, "BLOCK_TOKENS", tokens)
    check(spark, near_copies(3, [60, 61], 60), 3, 90)


def test_chains_over_many_blocks(spark, monkeypatch):
    """Neighbours of a chain link, others don't: pairs with the first block don't join all."""
    monkeypatch.setattr(jaccard_join, "BLOCK_TOKENS", 250)
    words = words_of(260, 4)
    check(spark, [(k, " ".join(words[2 * k : 2 * k + 60])) for k in range(14)], 3, 90)


@pytest.mark.parametrize("percent", [80, 90])
def test_linking_sets_have_the_parts_that_each_needs(percent):
    rng, cut, seen = np.random.default_rng(2), jaccard_join.Parts(percent), 0
    for n in [*range(4, 60), 89, 90, 161, 162, 290, 291, 522, 523]:
        for m in {n, n * 100 // percent, int(rng.integers(n, n * 100 // percent + 1))}:
            o = -(-percent * (n + m) // (100 + percent))  # the least overlap of a link
            pool = np.unique(rng.integers(0, 1 << 64, 3 * m + 9, np.uint64, endpoint=False))
            rng.shuffle(pool)
            if o > n or o == n == m:
                continue
            of = [{k: (need, set(s.tolist())) for k, need, s in cut.signatures(np.sort(x))} for x in (pool[:n], np.concatenate([pool[:o], pool[n : n + m - o]]))]
            k = int(np.searchsorted(cut.bounds, n, side="right")) - 1
            common = len(of[0][k][1] & of[1][k][1])
            assert common >= max(1, of[0][k][0], of[1][k][0])
            seen += 1
    assert seen > 90


def test_sets_that_share_nothing_are_no_candidates(spark):
    rows = [(" ".join(words_of(54 + k % 7, 1000 + k)),) for k in range(1200)]
    assert jaccard_join.candidates(jaccard_join.parts(spark.createDataFrame(rows, "text string"), "text", 5, 80)).isEmpty()


def test_a_passage_does_not_join_groups(spark):
    passage, group = words_of(40, 0.5), {}
    for g in range(8):
        for copy in near_copies(g, [160], 6):
            text = f"{copy[1]} {' '.join(passage)}"
            group[jaccard_join.node_of(jaccard_join.shingle_hashes(text, 5))] = (g, text)
    rows = spark.createDataFrame([(t,) for _, t in group.values()], "text string")
    got = jaccard_join.candidates(jaccard_join.parts(rows, "text", 5, 80)).collect()
    labels = {}
    for r in got:
        labels.setdefault(r.label, set()).add(group[r.node][0])
    assert {g for x in labels.values() for g in x} == set(range(8)) and all(len(x) == 1 for x in labels.values())


@pytest.mark.parametrize("middle", [None, 7])
def test_links_through_a_null_id(spark, middle):
    words = words_of(100, 8)
    rows = [(2, " ".join(words[:90])), (middle, " ".join(words[3:93])), (middle, " ".join(words[3:93])), (5, " ".join(words[6:96]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [shingles(t, 3) for _, t in rows]
    near = lambda a, b: 100 * len(a & b) / len(a | b)
    assert near(sets[0], sets[1]) >= 90 and near(sets[1], sets[3]) >= 90 and near(sets[0], sets[3]) < 90
    assert [r.component_id for r in jaccard_join.jaccard_components(df, size=3, percent=90).collect()] == [2] * 4


def test_pairs_at_the_threshold(spark):
    base = [f"w{k}" for k in range(40)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:38])), (3, " ".join(base[:36])), (4, " ".join(base[2:])), (5, "A b"), (6, "a  B\n"), (7, "a b c"), (8, "")]
    for percent in (80, 85, 90, 95, 100):
        check(spark, rows, 3, percent)


def test_walk_finds_what_all_pairs_find():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 60, 400).astype(np.uint64)
    sets = [np.unique(rng.choice(pool[s : s + 30], rng.integers(8, 28))) for s in rng.integers(0, 370, 120)]
    for percent in (50, 70, 90):
        a, b = jaccard_join.links(sets, np.arange(len(sets)), np.zeros(len(sets), int), percent)
        want = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * (o := len(np.intersect1d(sets[i], sets[j]))) >= percent * (len(sets[i]) + len(sets[j]) - o)}

        def group(pairs):
            root = list(range(len(sets)))
            for i, j in pairs:
                old, new = root[i], root[j]
                root = [new if x == old else x for x in root]
            names = {}
            return [names.setdefault(x, k) for k, x in enumerate(root)]

        assert group(zip(a, b)) == group(want)


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100)], "a long, b long")
    got = dict(tuple(r) for r in connected(edges).collect())
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}
    assert connected(edges.limit(0)).count() == 0


def test_awkward_and_empty(awkward, empty):
    got = jaccard_join.jaccard_components(awkward).collect()
    assert len(got) == awkward.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.component_id for r in by[6]] == [1] and [r.component_id for r in by[7]] == [1, 1]
    assert all(r.n_shingles == 0 and r.component_id == r.doc_id for i in (2, 3, 4) for r in by[i])
    assert {r.component_id for r in by[None]} == {1, None}
    assert jaccard_join.jaccard_components(empty).count() == 0
