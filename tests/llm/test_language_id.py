import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from tidemark.llm import language_id
from tidemark.llm.language_id import ORDER


class Brute:
    """Prediction by partial matching from dictionaries, a byte at a time."""

    def __init__(self, rows, min_count):
        seen = {b for _, t in rows for b in t.lower().encode()}
        self.seen, self.trees, self.nodes = seen, {}, Counter()
        for lang, text in rows:
            tree = self.trees.setdefault(lang, defaultdict(Counter))
            data = [0] * ORDER + list(text.lower().encode())
            for k in range(ORDER, len(data)):
                for depth in range(ORDER + 1):
                    tree[tuple(data[k - depth : k])][data[k]] += 1
                    self.nodes[tuple(data[k - depth : k])] += 1
        self.min_count = min_count

    def bits(self, lang, text):
        data = [0] * ORDER + [b if b in self.seen else 0 for b in text.lower().encode()]
        total = 0.0
        for k in range(ORDER, len(data)):
            depth = ORDER
            while depth and self.nodes[tuple(data[k - depth : k])] < (self.min_count if depth == ORDER else 1):
                depth -= 1
            total -= math.log2(max(self.probability(lang, tuple(data[k - depth : k]), data[k]), 1e-9))
        return total

    def probability(self, lang, context, byte):
        left, used = 1.0, set()
        for depth in range(len(context), -1, -1):
            c = {b: n for b, n in self.trees[lang].get(context[len(context) - depth :], {}).items() if b not in used}
            if c:
                n, kinds = sum(c.values()), len(c)
                if byte in c:
                    return left * c[byte] / (n + kinds)
                left *= kinds / (n + kinds)
                used |= set(c)
        return left / max(1, 256 - len(used))


ROWS = [(k, text, lang) for k, (text, lang) in enumerate([("the cat sat on the mat with the hat", "en"), ("that is the thing then", "en"), ("der hund und die katze sind hier", "de"), ("das ist nicht der hund über uns", "de"), ("el gato y el perro están aquí", "es"), ("aa", "es")])]


def test_code_lengths_against_dictionaries(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    for min_count in (1, 2):
        model = language_id.fit(df, min_count=min_count)
        brute = Brute([(lang, t) for _, t, lang in ROWS], min_count)
        assert model.languages == ["de", "en", "es"]
        for text in ("the hat", "der Hund", "gato", "Zß 漢", "t", "über\x00x", "aaaaaaaaaa"):
            got = language_id.code_lengths(model, text)
            assert np.allclose(got, [brute.bits(lang, text) for lang in model.languages], rtol=1e-4), text


def test_code_lengths_do_not_depend_on_blocks(spark, monkeypatch):
    model = language_id.fit(spark.createDataFrame(ROWS, "doc_id long, text string, lang string"))
    text = "the dog and der hund " * 200
    whole = language_id.code_lengths(model, text)
    monkeypatch.setattr(language_id, "BLOCK", 97)
    assert np.allclose(whole, language_id.code_lengths(model, text))


def test_held_out_documents(spark, data):
    got = language_id.op7_language_id(spark, f"{data}/sf0.01").collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{data}/sf0.01/documents.parquet").collect()}
    assert len(got) == len(docs)
    known = {r.lang for r in docs.values() if r.lang is not None}
    right = total = 0
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.lang_pred in known | {"und"} and 0 <= r.score <= 1
        if r.held_out and r.lang_pred != "und" and docs[r.doc_id].lang is not None:
            total += 1
            right += r.lang_pred == docs[r.doc_id].lang
    assert total > 50 and right > 0.93 * total


def test_awkward_and_empty(awkward, empty):
    model = language_id.fit(awkward)
    out = {}
    for r in language_id.predict(awkward, model).collect():
        out.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, out.values())) == awkward.count()
    assert all(r.lang_pred == "und" and r.score == 0 for i in (2, 3, 4, 10) for r in out[i])
    assert out[5][0].lang_pred in ("en", "de")
    kept = language_id.keep_languages(awkward, model)
    assert kept.columns == awkward.columns and {r.doc_id for r in kept.collect()}.isdisjoint({2, 3, 4, 10})
    none = language_id.fit(empty)
    assert none.languages == [] and language_id.predict(empty, none).count() == 0 == language_id.keep_languages(empty, none).count()
    assert {r.lang_pred for r in language_id.predict(awkward, none).collect()} == {"und"}
    assert language_id.keep_languages(awkward, none).count() > 0
