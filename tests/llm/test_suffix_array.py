import random
from hashlib import sha256

import numpy as np
import pytest
from cases import LONG, words_of
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import suffix_array
from tidemark.llm.suffix_array import LENGTH


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60))
def test_order_of_suffixes(symbols):
    text = [*symbols, 0]
    assert suffix_array.suffix_array(text) == sorted(range(len(text)), key=lambda k: text[k:])


def test_order_of_long_and_regular_texts():
    rng = random.Random(3)
    for body in ([1] * 500, [1, 2] * 300, [2, 1] * 300, [rng.randint(1, 250) for _ in range(2000)], [1, 2, 3, 1, 2] * 150, list(range(1, 300)), list(range(300, 0, -1))):
        text = [*body, 0]
        assert suffix_array.suffix_array(text) == sorted(range(len(text)), key=lambda k: text[k:])


def test_repeated_windows_against_counts():
    rng, span = random.Random(7), 24
    for n in range(200):
        shared = (b"abba"[: rng.randint(0, 4)], b"abab"[: rng.randint(0, 4)])
        half = lambda w: bytes(rng.choices(b"ab", weights=w, k=rng.randint(0, span - 4)))
        contents = list({(half((1, 1)) + shared[0], shared[1] + half((9, 1))): rng.randint(1, 2) for _ in range(rng.randint(1, 6))}.items())
        contents = [(*c, k) for c, k in contents]
        count = {}
        for left, right, copies in contents:
            for k in range(span + 1):
                if k <= len(left) and span - k <= len(right):
                    w = (k, left[len(left) - k :], right[: span - k])
                    count[w] = count.get(w, 0) + copies
        got = suffix_array.repeated_windows(contents, span)
        for (left, right, _), mask in zip(contents, got):
            want = sum(1 << k for k in range(span + 1) if k <= len(left) and span - k <= len(right) and count[(k, left[len(left) - k :], right[: span - k])] > 1)
            assert mask == want


def found_in(texts):
    data = np.frombuffer(b"".join(texts), np.uint8)
    parts = list(suffix_array.anchors_of(data, np.cumsum([len(x) for x in texts])))
    return [np.concatenate(x).tolist() for x in zip(*parts)]


def test_anchors_by_blocks_and_in_many_texts(monkeypatch):
    rng = random.Random(2)
    texts = [bytes(rng.choices(b"abcd", k=n)) for n in (0, 249, 250, 399, 0, 400, 401, 5000, 20_000, 3)]
    together = found_in(texts)
    apart = [[k, *row] for k, x in enumerate(texts) for row in zip(*found_in([x])[1:])]
    assert [list(x) for x in zip(*together)] == apart
    for data in texts:
        whole = found_in([data])
        with monkeypatch.context() as m:
            m.setattr(suffix_array, "BLOCK", 700)
            assert found_in([data]) == whole
        _, at, _, _, long = whole
        for size, some in ((LENGTH, [a for a, ok in zip(at, long) if ok]), (suffix_array.SHORT, at)):
            for k in range(0, len(data) - size + 1, 13):  # each string has an anchor inside
                assert any(k <= a <= k + size - suffix_array.GRAM for a in some)


def test_slices_of_a_long_text(spark, monkeypatch):
    rng = random.Random(4)
    body = bytes(rng.choices(b"abcd", k=9000)).decode()
    wanted = [(g, g + 1, at, g % 2 == 0) for g, at in enumerate((8_700, 10, 0, 700, 699, 5000, 8850, 3))]
    pieces = [(70, 0, -20, 900), (71, 1, 8000, 9500)]
    df = spark.createDataFrame([(1, body, wanted, pieces), (2, body[:4000], wanted[1:3], [])], "key long, text string, wanted array<struct<gram:bigint,context:bigint,at:int,twice:boolean>>, pieces array<struct<stretch:bigint,side:int,lo:int,hi:int>>")
    key = lambda r: tuple(map(str, r))
    whole = sorted(map(key, suffix_array.slices(df.coalesce(1)).collect()))
    parts = df.rdd.map(lambda r: r).toDF(df.schema).repartition(2)
    assert sorted(map(key, suffix_array.slices(parts).collect())) == whole
    got = suffix_array.slices(df)
    assert sorted((r.common, r.hi, r.lo, bytes(r.left).decode()) for r in got.where("piece").collect()) == [(70, 0, 0, body[:900]), (71, 1, 8000, body[8000:])]
    for _, gram, context, lo, hi, copies, told, left, right, _ in got.where("not piece").collect():
        at = wanted[gram][2]
        assert context == gram + 1 and copies == 1 + (gram % 2 == 0) and told == (gram % 2 == 1)
        assert at - lo >= 0 and bytes(left) == body.encode()[max(0, at - hi) : at - lo]
        assert bytes(right) in (body.encode()[at + LENGTH - hi : at + LENGTH - lo], body[:4000].encode()[at + LENGTH - hi : at + LENGTH - lo])


def brute(rows):
    """Bytes covered by a string of LENGTH bytes that starts in two places or more."""
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for d, data in enumerate(texts):
        for k in range(len(data) - LENGTH + 1):
            h = hash(data[k : k + LENGTH])
            seen[h] = 2 if h in seen else 1
    out = []
    for (i, _), data in zip(rows, texts):
        spans, last = [], -1
        for k in range(len(data) - LENGTH + 1):
            if seen[hash(data[k : k + LENGTH])] > 1:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + LENGTH
                else:
                    spans.append([k, k + LENGTH])
        kept, at = b"", 0
        for a, b in spans:
            kept += data[at:a]
            at = b
        kept += data[at:]
        out.append((i, len(data), len(data) - len(kept), len(spans), sha256(kept).hexdigest()))
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [(r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), sha256(bytes(r.kept)).hexdigest()) for r in suffix_array.remove_repeats(df).collect()]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_query_against_brute_force(spark, data, texts):
    got = sorted(tuple(r)[:5] for r in suffix_array.op10_suffix_array(spark, f"{data}/sf0.001").collect())
    want = sorted(brute(texts))
    assert got == want and any(x[2] for x in want)


def hard_rows():
    rng = random.Random(11)
    passage = " ".join(words_of(150, 5))
    other = " ".join(words_of(150, 6))
    rows = [(0, passage), (1, passage), (2, passage[:399]), (3, passage[:400]), (4, passage[10:430]), (5, None), (6, ""), (7, "x" * 399), (8, "x" * 401), (9, "ab" * 500), (10, passage + other + passage)]
    for k in range(11, 60):  # passages with changed bytes and different neighbours
        p = list(rng.choice((passage, other)))
        for _ in range(rng.randint(0, 3)):
            p[rng.randrange(len(p))] = rng.choice("xyz")
        a = rng.randint(0, 200)
        rows.append((k, " ".join(words_of(rng.randint(0, 40), k)) + "".join(p[a : a + rng.randint(350, 700)]) + " ".join(words_of(rng.randint(0, 40), k + 500))))
    rows += [(60, rows[20][1]), (60, rows[20][1]), (None, rows[21][1]), (61, "é漢😀" * 200), (62, "z" + "é漢😀" * 100)]
    return rows


@pytest.mark.parametrize("most,block", [(128, 1 << 20), (2, 1 << 20), (5, 300)])
def test_changed_passages(spark, monkeypatch, most, block):
    """Groups with more rows than ``most`` are dealt anew by their next symbols, down to single windows."""
    monkeypatch.setattr(suffix_array, "MOST_ROWS", most)
    monkeypatch.setattr(suffix_array, "BLOCK", block)
    check(spark, hard_rows())


def test_windows_of_stretches_against_counts(monkeypatch):
    rng, n = random.Random(8), 5
    monkeypatch.setattr(suffix_array, "LENGTH", n)
    for _ in range(400):
        a = bytes(rng.choices(b"ab", k=rng.randint(n, 24)))
        b = bytearray(a)
        for _ in range(rng.randint(0, 2)):
            b[rng.randrange(len(b))] = rng.choice(b"abx")
        starts = sorted(rng.sample(range(len(a) - n + 1), rng.randint(1, min(4, len(a) - n + 1))))
        got = suffix_array.windows_elsewhere(a, bytes(b), starts)
        assert all(a[s : s + n] in a[:s + n - 1] + b"|" + a[s + 1 :] + b"|" + bytes(b) for s in got)
        assert got >= {s for s in starts if a[s : s + n] == b[s : s + n]}
        shift, text = rng.randint(1, 6), bytes(rng.choices(b"ab", k=24 + len(a)))
        one = suffix_array.windows_elsewhere(text[: len(a)], text[shift : shift + len(a)], starts, shift)
        assert all(any(text[k : k + n] == text[s : s + n] for k in range(len(text)) if k != s) for s in one)
        assert one >= {s for s in starts if text[s : s + n] == text[s + shift : s + shift + n]}


def test_nothing_of_whole_copies_goes_under_a_wrong_order(spark, monkeypatch):
    """Equal hashes only pick candidates: with the order of suffixes undone, windows of exact copies aren't found."""
    a = " ".join(words_of(150, 5)).encode()
    starts = [0, len(a) - LENGTH]
    assert 650 < len(a) < 700
    assert suffix_array.windows_elsewhere(a, a, starts) == set(starts)
    assert suffix_array.windows_elsewhere(a, b"z" + a[1:], starts) == {starts[1]}
    pieces = spark.createDataFrame([(1, lo, side, a, True) for side, lo in ((0, 0), (1, 40))], "common long, lo int, hi int, left binary, piece boolean")
    wanted = spark.createDataFrame([(1, 7, 8, 40, [(250, 3, 4), (300, 5, 6)])], "stretch long, key long, other long, shift int, wordings array<struct<at:int,gram:bigint,context:bigint>>")
    assert sorted(map(tuple, suffix_array.repeated_wordings(pieces, wanted).collect())) == [(3, 4, 0, 250), (5, 6, 300 - starts[1], 250)]  # the second one's context ends with the text
    monkeypatch.setattr(suffix_array, "suffix_array", lambda text: list(range(len(text))))
    assert suffix_array.windows_elsewhere(a, a, starts) == set()


def test_order_of_suffixes_decides_what_differs(monkeypatch):
    """Contents that differ are judged by the suffix array: under a wrong order their repeats are missed."""
    rng = np.random.default_rng(5)
    shared = rng.bytes(200)
    row = lambda left, right, copies: (1, 1, len(left), 0, 200, copies, True, left, right)
    differing = [row(b"x" + shared, b"y" * 150, 1), row(rng.bytes(201), b"v" * 150, 1), row(b"z" + shared, b"w" * 150, 1)]
    found = list(suffix_array._judge(differing))
    assert len(found) == 2
    monkeypatch.setattr(suffix_array, "suffix_array", lambda text: list(range(len(text))))
    assert len(list(suffix_array._judge(differing))) < 2


def test_shared_strings_of_a_shorter_length(spark):
    passage = " ".join(words_of(150, 5)).encode().decode()
    rows = [(1, "x1 " + passage[:260] + " y"), (2, "other " + passage[:260]), (3, " ".join(words_of(150, 9))), (4, passage[:140] + "z" * 20), (5, None)]
    got = {r.doc_id: r for r in suffix_array.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_shared > 0 and got[2].n_shared > 0 and not any(got[k].n_shared for k in (3, 4, 5)) and not any(r.spans for r in got.values())


def test_picked_by_a_join(spark, monkeypatch):
    monkeypatch.setattr(suffix_array, "BROADCAST_KEYS", 0)
    check(spark, hard_rows()[:30])


def test_awkward_and_empty(spark, awkward, empty):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    assert suffix_array.remove_repeats(empty).count() == 0
    assert any(len(t or "") == len(LONG) for _, t in rows)
    check(spark, rows)
