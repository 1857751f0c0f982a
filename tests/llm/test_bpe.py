from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from cases import LONG
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def own():
    return bpe.Bpe(PATH)


ODD = ["", " ", "\n\n  x", "a" * 3000, "<|endoftext|>", "x<|endoftext|> y<|endoftext|>", "don't we'll", "漢字 カナ 😀👍🏽", "  x ", "\x00\x01é", "1234 567", LONG[:20_000], "<|endof", "ﬁ½Ⅷ²", "́combining"]


def test_odd_texts(library, own):
    for text in ODD:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == ids, text[:40]
        assert own.decode(np.array(ids, np.int32)) == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(library, own, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text).tolist() == ids
    assert own.decode(np.array(ids, np.int32)) == library.decode(ids, skip_special_tokens=False)


def test_stretches_are_cut_between_words(library, monkeypatch):
    monkeypatch.setattr(bpe, "STRETCH", 40)
    own = bpe.Bpe(PATH)
    for text in (*ODD, LONG[:5000], "a  b " * 60 + "c d" + "漢字" * 50 + " e f  g\n h i" * 20):
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_invalid_bytes_decode_as_in_the_library(library, own):
    for ids in ([220, 255, 254], [own.byte_id[0xE6]], [own.byte_id[b] for b in b"\xf0\x9f\x98"], [own.byte_id[b] for b in b"a\xffb\xc3(\xe2\x82"]):
        assert own.decode(np.array(ids, np.int32)) == library.decode(ids, skip_special_tokens=False)


def test_query_against_the_library(spark, data, texts, library):
    got = {r.doc_id: r for r in bpe.op9_bpe(spark, f"{data}/sf0.001").collect()}
    assert len(got) == len(texts)
    for i, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        r = got[i]
        assert r.n_tokens == len(ids) and r.ids_sha256 == sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_awkward_and_empty(awkward, empty):
    out = bpe.decode(bpe.encode(awkward, PATH), PATH).collect()
    want = [(r.doc_id, r.text or "") for r in awkward.select("doc_id", "text").collect()]
    key = lambda x: (x[0] or -1, x[1])
    assert sorted(((r.doc_id, r.decoded) for r in out), key=key) == sorted(want, key=key)
    assert bpe.digests(empty, PATH).count() == 0


def test_words_are_forgotten(own):
    small = bpe.Bpe(PATH, keep=3)
    for w in "one two three four five six seven one two".split() * 3:
        assert small.encode(w).tolist() == own.encode(w).tolist()
    assert len(small.seen) <= 3 and len(small.seen.old) <= 3
    with bpe.loaded(PATH) as b:
        b.encode("some words")
        assert b.seen
    assert not b.seen


def test_both_ways_give_the_same(spark, awkward):
    once = bpe.encode(awkward, PATH, with_decoded=True).collect()
    twice = bpe.decode(bpe.encode(awkward, PATH), PATH).collect()
    assert once == twice
