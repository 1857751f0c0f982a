"""Awkward documents that every operator must take: nulls, empty and very long texts, ties, repeated rows, odd columns."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key long, node long, label int, n int, spans string, _key long, _id long, own string"


def words_of(n, seed=0):
    rng = random.Random(seed)
    return [rng.choice("abcdefghij") + rng.choice("klmnop") + rng.choice("qrstuv") * rng.randint(1, 2) for _ in range(n)]


LONG = " ".join(words_of(60_000, 1))


def awkward_rows():
    text = " ".join(words_of(120, 2))
    rows = [
        (1, text, "en", "a"), (2, None, "en", "a"), (3, "", None, "a"), (4, " \n\t  ", "de", None), (5, LONG, "en", "a"),
        (6, text, "en", "a"), (7, text + " end", "en", "b"), (7, text + " end", "en", "b"), (8, "Hëllo wörld 漢字 😀 mail a@b.co", None, "b"),
        (9, "x", "de", "b"), (None, text, "en", "a"), (None, None, None, None), (10, "123 456\n123 456\n", "de", "b"),
        (11, "same id other text " + text, "de", "b"), (11, "one id", "de", "b"), (12, "a" * 5000, "en", "a"),
    ]
    return [(i, t, lang, source, len(t) if t is not None else None, "x", 1, 2, 3, 4, "y", 5, 6, "z") for i, t, lang, source in rows]


LOWER = {c: c + 32 for c in range(65, 91)}


def plain_words(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
