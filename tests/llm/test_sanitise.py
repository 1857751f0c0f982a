import math
import re
from collections import Counter
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import sanitise

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute_spans(text):
    """The contract's patterns as they stand."""
    text = text or ""
    out = [(m.start(), 0, m.end(), "email") for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end(), "ip") for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end(), "card"))
    out += [(m.start(), 3, m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [(a, b, kind) for a, _, b, kind in sorted(out)]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aZ9.@+-% ()01234é", max_size=60))
def test_base_spans_are_those_of_the_patterns(text):
    assert sanitise.base_spans(text) == brute_spans(text)


@pytest.mark.parametrize("text", ["a@b.c@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.0.0.1", "4111 1111 1111 1111", "+1 (800) 555-0199", "a@@b.co", "@b.co", "x@b", "１２@b.co", "4111-1111 1111-1111.5.6.7"])
def test_base_spans_by_hand(text):
    assert sanitise.base_spans(text) == brute_spans(text)


def test_long_runs_take_no_squared_time():
    for text in ("9" * 300_000, "a" * 300_000 + "@", "a@" * 150_000, "1." * 150_000, "+1" * 150_000):
        sanitise.base_spans(text)


def told(spans):
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def test_query_has_the_base_of_every_text(spark, data, texts):
    got = {r.doc_id: r for r in sanitise.op1_sanitise(spark, f"{data}/sf0.001").collect()}
    assert len(got) == len(texts)
    for i, text in texts:
        want, r = brute_spans(text), got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, _, x in want) for k in sanitise.KINDS]
        assert r.base_sha256 == sha256(told(want).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("term:")] == [s for s in told(want).split(",") if s]


def corpus():
    rows = []
    for k in range(30):
        rows.append((k, f"note {k} about the weather by tramway{k} today and so on"))
    for k in range(5):
        rows.append((100 + k, f"note w{k} about zephyrine writes from jo.smith@mail.example about item w{k + 50} today"))
    rows.append((200, "zephyrine alone stays because no entity stands here"))
    return rows


def classes(kind, value):
    return [(kind, value.lower())] + ([("domain", value.lower().split("@")[1])] if kind == "email" else []) + [("kind", kind)]


def brute_disclosure(rows, reach=8, threshold=0.5, support=2):
    """{(entity, term)} by the formula, over distinct texts."""
    texts = sorted({t for _, t in rows if t is not None})
    n, n_t, seen = len({t for _, t in rows}), Counter(), {}
    for x, text in enumerate(texts):
        n_t.update(set(re.findall(r"\w+", text.lower())))
        spans = brute_spans(text)
        plain = list(text)
        for a, b, _ in spans:
            plain[a:b] = " " * (b - a)
        plain = "".join(plain)
        for a, b, kind in spans:
            left, right = re.findall(r"\w+", plain[:a].lower())[-reach:], re.findall(r"\w+", plain[b:].lower())[:reach]
            for e in classes(kind, text[a:b]):
                seen.setdefault(e, []).append((x, (tuple(left), tuple(right))))
    out = set()
    for e, contexts in seen.items():
        by = {}
        for x, c in contexts:
            for t in {*c[0], *c[1]}:
                by.setdefault(t, []).append((x, c))
        n_e = len({x for x, _ in contexts})
        if len({c for _, c in contexts}) < support:
            continue
        for t, own in by.items():
            n_te = len({x for x, _ in own})
            if len({c for _, c in own}) >= support and re.search(r"[^\W\d_]", t):
                info = math.log(n / n_e)
                if info > 0 and math.log(n_te * n / (max(n_t[t], n_te) * n_e)) / info >= threshold:
                    out.add((e, t))
    return out


@pytest.mark.parametrize("most", [100_000, 0])
def test_disclosing_terms(spark, monkeypatch, most):
    monkeypatch.setattr(sanitise, "BROADCAST_PAIRS", most)
    rows = corpus()
    want = brute_disclosure(rows)
    assert "zephyrine" in {t for _, t in want} and "about" not in {t for _, t in want}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.entity, r.term) for r in sanitise.disclosing(df).collect()}
    assert got == {(sanitise.hashed(*e), t) for e, t in want}
    # other columns may have any name
    odd = df.selectExpr("*", "1 as _key", "2 as own", "3 as _own_pairs", "4 as key", "5 as row", "6 as entity", "7 as term")
    for out in (sanitise.sanitise(df), sanitise.sanitised(odd)):
        clean = {r.doc_id: r.text for r in out.collect()}
        assert clean[200] == rows[-1][1]  # without the entity the term says nothing
        assert "zephyrine" not in clean[100] and "jo.smith" not in clean[100] and "[EMAIL]" in clean[100] and "weather" in clean[1]
    assert sanitise.sanitised(odd).columns == odd.columns and {r.own for r in sanitise.sanitised(odd).collect()} == {2}


def test_terms_of_a_whole_table(spark, data):
    """Terms that give away a class of entities, and the spans of the query, against the formula."""
    docs = spark.read.parquet(f"{data}/sf0.1/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute_disclosure(rows)
    assert want
    of = {}
    for e, t in want:
        of.setdefault(e, set()).add(t)
    got = {r.doc_id: r for r in sanitise.op1_sanitise(spark, f"{data}/sf0.1").collect()}
    terms = 0
    for i, text in rows:
        spans = brute_spans(text)
        words = {t for a, b, k in spans for e in classes(k, text[a:b]) for t in of.get(e, ())}
        extra = [(m.start(), m.end(), "term") for m in re.finditer(r"\w+", text or "") if m[0].lower() in words and not any(a < m.end() and m.start() < b for a, b, _ in spans)]
        terms += len(extra)
        order = (*sanitise.KINDS, "term")
        assert got[i].spans == told(sorted(spans + extra, key=lambda x: (x[0], order.index(x[2])))) and got[i].n_terms == len(extra) and got[i].n_spans == len(spans) + len(extra)
    assert terms


def test_context_reaches_over_long_words():
    long = "w" * 5000
    text = f"alpha {long} beta x@y.zz gamma {long} delta epsilon"
    a = text.index("x@y")
    assert sanitise.terms_beside(text, a, a + 6, 3) == (["alpha", long, "beta"], ["gamma", long, "delta"])
    assert sanitise.terms_beside(text, a, a + 6, 9) == (["alpha", long, "beta"], ["gamma", long, "delta", "epsilon"])


@pytest.mark.parametrize("most", [500_000, 0])
@pytest.mark.parametrize("tail", ["", " and so on with a few more words of no use here, copy {}"])
def test_disclosing_terms_inside_groups_of_copies(spark, monkeypatch, tail, most):
    monkeypatch.setattr(sanitise, "BROADCAST_COPIES", most)
    rows = [(k, f"note {k} about the weather by tramway{k} today and so on") for k in range(100)]
    for k in range(3):  # three wordings; copies and, with a tail, texts that differ beyond the context
        rows += [(1000 + 100 * k + c, f"note w{k} about zephyrine writes from jo.smith@mail.example about item w{k + 50} today" + tail.format(c)) for c in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.term: r.disclosure for r in sanitise.disclosing(df).collect()}
    assert abs(got["zephyrine"] - 1) < 1e-9 and "about" not in got and "today" not in got
    clean = {r.doc_id: r.text for r in sanitise.sanitise(df).collect()}
    assert all("zephyrine" not in clean[i] for i, _ in rows if i >= 1000)


def test_redact():
    assert sanitise.redact("a b@c.de x", [(2, 8, "email")]) == "a [EMAIL] x"
    assert sanitise.redact("a b@c.de x", [(2, 8, "email")], remove=True) == "a  x"
    assert sanitise.redact(None, []) is None


@pytest.mark.parametrize("most", [100_000, 0])
def test_awkward_and_empty(spark, awkward, empty, monkeypatch, most):
    monkeypatch.setattr(sanitise, "BROADCAST_PAIRS", most)
    out = sanitise.sanitise(awkward).collect()
    assert len(out) == awkward.count()
    assert ["email"] == [s.kind for r in out if r.doc_id == 8 for s in r.spans]
    assert all(not r.spans for r in out if r.doc_id in (2, 3))
    whole = sanitise.sanitised(awkward)
    assert whole.columns == awkward.columns and whole.count() == awkward.count()
    assert sanitise.sanitise(empty).count() == 0 and sanitise.sanitised(empty).count() == 0


def test_terms_are_counted_for_a_whole_task(spark, monkeypatch):
    """Numbers are the same whether a task gives them once or after each batch."""
    from tidemark.llm import sanitise

    docs = spark.createDataFrame([(f"common w{i % 3} w{i}",) for i in range(40)], "text string").coalesce(2)
    terms = spark.createDataFrame([("common",), ("w1",), ("w30",)], "term string")
    none = spark.createDataFrame([], "copy long, rows long")
    got = {r.term: r.n for r in sanitise.document_frequency(docs, terms, none).collect()}
    monkeypatch.setattr(sanitise, "HELD_TERMS", 0)
    assert got == {r.term: r.n for r in sanitise.document_frequency(docs, terms, none).collect()} == {"common": 40, "w1": 13, "w30": 1}
