"""The manifest against a tree built in memory, and the traversal against all paths of a block."""

import hashlib
import zlib

import pytest
from cases import SCHEMA

from tidemark.llm import merkle


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """All levels, the first being the nodes."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def path(levels, at):
    """(others before, others after) for each level."""
    out = []
    for nodes in levels[:-1]:
        run = at - at % 3
        out.append((nodes[run:at], nodes[at + 1 : run + 3]))
        at //= 3
    return out


def leaf_of(r, text):
    fields = [r.doc_id, r.source, r.lang, r.n_chars, text]
    return h("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields)


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append((r.doc_id if r.doc_id is not None else -1, leaf_of(r, r.text), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf for _, leaf, _ in sorted(by[s], key=lambda x: x[:2])]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for at, (_, leaf, r) in enumerate(sorted(by[s], key=lambda x: x[:2])):
            steps = path(trees[s], at) + path(top, k)
            tampered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and r.text is not None
            node = leaf_of(r, r.text.replace("\n", "")) if tampered else leaf
            for before, after in steps:
                node = h([*before, node, *after])
            out.append((r.doc_id, leaf, trees[s][-1][0], top[-1][0], h(x for b, a in steps for x in [*b, *a]), node, node == top[-1][0]))
    return sorted(out, key=repr)


def told(spark, rows, tmp_path, schema="doc_id long, text string, lang string, source string, n_chars long"):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op13_merkle(spark, str(tmp_path))
    read = spark.read.parquet(f"{tmp_path}/documents.parquet").collect()
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in got.collect()), key=repr), read


@pytest.mark.parametrize("n", [*range(1, 31), 80, 81, 82, 242, 243, 244, 700, 728, 729])
def test_traversal_gives_every_path(n):
    leaves = [hashlib.sha256(str(i).encode()).hexdigest().encode() for i in range(n)]
    levels = tree([x.decode() for x in leaves])
    assert merkle.height(n) == len(levels) - 1
    assert merkle.fold(leaves, len(levels) - 1).decode() == levels[-1][0]
    for i, got in enumerate(merkle.traverse(leaves, len(levels) - 1)):
        assert [(x[:at], x[at:]) for at, x in got] == [([y.encode() for y in b], [y.encode() for y in a]) for b, a in path(levels, i)]
        again = list(merkle.unpacked(merkle.packed(got)))
        assert again == got and merkle.climb(leaves[i], iter(again)).decode() == levels[-1][0]


def test_last_block_of_a_larger_tree_has_all_its_levels():
    leaves = [hashlib.sha256(str(i).encode()).hexdigest().encode() for i in range(730)]
    levels = tree([x.decode() for x in leaves])
    last = merkle.fold(leaves[729:], merkle.LEVELS)
    assert [merkle.fold(leaves[:729], merkle.LEVELS).decode(), last.decode()] == levels[6]
    assert [x for _, x in next(merkle.traverse(leaves[729:], merkle.LEVELS))] == [[]] * 6


def test_traversal_holds_few_nodes():
    leaves = [b"%064x" % i for i in range(729)]
    held = 0
    made = merkle.Subtree

    class Watched(made):
        alive = []

        def __init__(self, *a):
            super().__init__(*a)
            Watched.alive.append(self)

    merkle.Subtree = Watched
    try:
        for _ in merkle.traverse(leaves, 6):
            held = max(held, sum(len(x.nodes) for x in Watched.alive[-12:]))
    finally:
        merkle.Subtree = made
    assert held <= 12 * (3 + 9)


def test_small_table(spark, data):
    got = merkle.op13_merkle(spark, f"{data}/sf0.001").select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, got), key=repr) == brute(spark.read.parquet(f"{data}/sf0.001/documents.parquet").collect())
    assert {r.verified for r in got} == {True, False}


def test_awkward_rows(spark, awkward, tmp_path):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in awkward.collect()]
    got, read = told(spark, rows, tmp_path)
    assert got == brute(read)


def test_large_source_and_many_sources(spark, tmp_path):
    """A source of several blocks, and more sources than a block of the tree over them holds."""
    rows = [(i, f"text\n{i}", "en", "large", None) for i in range(2300)] + [(i, "one", None, f"s{i}", 3) for i in range(800)] + [(5, "x\ny", None, None, 3)]
    got, read = told(spark, rows[::-1], tmp_path)
    assert got == brute(read)


def test_one_leaf_is_the_root(spark, tmp_path):
    got, read = told(spark, [(7, "a", "en", "s", 1)], tmp_path)
    assert got == brute(read) and got[0][1] == got[0][3] and got[0][4] == h([])


def test_empty_table_and_extra_columns(spark, awkward, tmp_path):
    assert told(spark, [], tmp_path)[0] == []
    rows = [tuple(r) for r in awkward.collect()]
    got, read = told(spark, rows, f"{tmp_path}/more", SCHEMA)
    assert got == brute(read)
