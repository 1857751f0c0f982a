import random
import re
from hashlib import sha256

import pytest
from cases import LOWER

from tidemark.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, size=10):
    """(words hit, items) for each document by looking at every place of every window."""
    of = {}
    for i, text in items:
        w = words(text)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            of.setdefault(tuple(w[k : k + size]), set()).add(i)
    lengths = {len(w) for w in of}
    out = []
    for _, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in of:
                    hit |= set(range(k, k + n))
                    found |= of[tuple(w[k : k + n])]
        out.append((len(w), hit, {str(x) for x in found if x is not None}))
    return out


def test_words_match_the_pattern(texts):
    for _, text in texts:
        assert [w.decode() for w in decontaminate.words(text)] == words(text)


def test_query_against_brute_force(spark, data, texts):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/sf0.001/benchmark.parquet").collect()]
    got = {r.doc_id: r for r in decontaminate.op2_decontamination(spark, f"{data}/sf0.001").collect()}
    assert len(got) == len(texts)
    for (i, _), (n, hit, found) in zip(texts, brute(texts, items)):
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, len(hit), len(found), bool(hit))
        assert r.items_sha256 == sha256(",".join(sorted(found)).encode()).hexdigest()


ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Short Item"), (2, "Short Item"), (3, None), (4, "..."), (None, "null id item"), (5, "short item")]
DOCS = [(1, "x one two three four five six seven eight nine ten y"), (2, "a SHORT, item here and short item"), (3, None), (4, ""), (5, "the null id item"), (None, "short item"), (5, "the null id item"), (6, "two three four five six seven eight nine ten eleven zwölf")]


@pytest.mark.parametrize("block_bytes", [8 << 20, 40])
def test_small_cases(spark, block_bytes):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.contamination(docs, items, block_bytes=block_bytes).collect()
    found = sorted(((r.doc_id or 0, r.n_words, tuple(k for s in r.spans for k in range(s.start, s.end)), tuple(r["items"])) for r in got))
    want = sorted(((i or 0, n, tuple(sorted(hit)), tuple(sorted(own))) for (i, _), (n, hit, own) in zip(DOCS, brute(DOCS, ITEMS))))
    assert found == want


def test_exact_and_proximity_search(spark):
    docs = spark.createDataFrame([(1, "the red fox and the red old fox"), (2, "red"), (3, "fox red")], "doc_id long, text string")
    for segment in (2_000_000, 1):
        index = decontaminate.build_index(docs, segment=segment)
        exact = {(r.doc_id, r["first"], r.end) for r in decontaminate.find(index, [(b"red", b"fox")]).collect()}
        assert exact == {(1, 1, 3)}
        near = {(r.doc_id, r["first"], r.end) for r in decontaminate.find(index, [(b"red", b"fox")], slop=1).collect()}
        assert near == {(1, 1, 3), (1, 5, 8)}


def test_proximity_with_repeated_terms_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(0, "a b x b x x c")] + [(k, " ".join(rng.choice("abcx") for _ in range(rng.randrange(25)))) for k in range(1, 40)]
    phrases = ["a b c", "a b", "b b a", "a c b c", "c"]

    def ends(w, terms, at, slop):
        if not terms:
            return {at + 1}
        return {e for k in range(at + 1, min(len(w), at + slop + 2)) if w[k] == terms[0] for e in ends(w, terms[1:], k, slop)}

    index = decontaminate.build_index(spark.createDataFrame(rows, "doc_id long, text string"), segment=100)
    for slop in (1, 2, 4):
        got = [tuple(r) for r in decontaminate.find(index, [tuple(p.encode().split()) for p in phrases], slop=slop).collect()]
        want = [(i, n, k, e) for i, text in rows for n, p in enumerate(phrases) for w in [text.split()] for k in range(len(w)) if w[k] == p[0] for e in ends(w, p.split()[1:], k, slop)]
        assert sorted(got) == sorted(want)
        assert slop < 2 or (0, 0, 0, 7) in got


def test_awkward_and_empty(spark, awkward, empty):
    items = spark.createDataFrame([(1, "hëllo wörld"), (2, None)], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(awkward, items).count() == awkward.count()
    assert [r.doc_id for r in decontaminate.contamination(awkward, items).where("size(spans) > 0").collect()] == [8]
    assert decontaminate.contamination(awkward, none).where("size(spans) > 0").count() == 0
    assert decontaminate.contamination(empty, items).count() == 0


def test_windows_by_their_rarest_term():
    rng = random.Random(2)
    block = {tuple(rng.choice([b"a", b"b", b"c", b"d%d" % rng.randrange(40)]) for _ in range(rng.randint(1, 5))): [str(k)] for k in range(200)}
    told = decontaminate.by_rarest(block)
    assert sorted((terms, names) for group in told.values() for terms, names in group) == sorted(block.items())
    having = {t: sum(t in terms for terms in block) for terms in block for t in terms}
    assert all(t == min(terms, key=lambda x: (having[x], x)) for t, group in told.items() for terms, _ in group)



def test_windows_of_foreign_words_need_no_look_up():
    block = {(b"the", b"foreign%d" % k): ["x"] for k in range(100)} | {(b"the", b"word"): ["y"]}
    assert decontaminate.by_rarest(block).keys() & {b"the", b"word"} == {b"word"}


def test_a_written_segment_is_a_group_of_its_own(spark, monkeypatch):
    from functools import partial
    from pathlib import Path

    import pyarrow.parquet as pq

    tables, plain = [], decontaminate.written
    monkeypatch.setattr(decontaminate, "written", lambda df, **options: tables.append(plain(df, **options)) or tables[-1])
    monkeypatch.setattr(decontaminate, "build_index", partial(decontaminate.build_index, segment=4))
    docs = spark.createDataFrame([(k, f"a b c d{k}") for k in range(40)], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, "b c d7")], "item_id long, text string")
    got = decontaminate.contamination(docs, items).where("size(spans) > 0").collect()
    assert [(r.doc_id, [tuple(s) for s in r.spans], r["items"]) for r in got] == [(7, [(1, 4)], ["1"])]
    files = [pq.ParquetFile(p).metadata for p in Path(tables[0].written_at.removeprefix("file:")).glob("*.parquet")]
    assert [f.row_group(k).num_rows for f in files for k in range(f.num_row_groups)] == [1] * 40
