from hashlib import sha256

import numpy as np
from cases import words_of

from tidemark.llm import chunk_dedup


def brute_gear(data):
    """The rolling hash as it rolls: shifted by one and the next byte's number added."""
    h, out = 0, []
    for b in data:
        h = ((h << 1) + int(chunk_dedup._GEAR[b])) & 0xFFFFFFFF
        out.append(h)
    return out


def brute_chunks(text):
    data = (text or "").encode()
    out, at = [], 0
    if not data:
        return data, out
    h = brute_gear(data)
    for k in range(len(data)):
        n = k + 1 - at
        if (chr(data[k]) in " \t\n\x0b\x0c\r" and h[k] >> (32 - chunk_dedup.MASK_BITS) == 0 and n >= chunk_dedup.LEAST) or k + 1 == len(data):
            out.append((at, k + 1))
            at = k + 1
        elif n >= chunk_dedup.MOST and data[k + 1] & 0xC0 != 0x80:
            out.append((at, k + 1))
            at = k + 1
    return data, out


def brute(rows):
    """First place of each chunk by id and place, over whole texts."""
    cut = [brute_chunks(t) for _, t in rows]
    places = {}
    for (i, _), (data, spans) in zip(rows, cut):
        for a, b in spans:
            places.setdefault(data[a:b], []).append((i, a))
    out = []
    for (i, _), (data, spans) in zip(rows, cut):
        again = [(a, b) for a, b in spans if len(places[data[a:b]]) > 1]
        gone = [(a, b) for a, b in again if min(places[data[a:b]]) != (i, a)]
        kept = b"".join(data[a:b] for a, b in spans if (a, b) not in set(gone))
        out.append((i, len(data), len(again), sum(b - a for a, b in again), sum(b - a for a, b in gone), sha256(kept).hexdigest()))
    return out


def test_gear_is_the_rolling_hash():
    data = np.random.default_rng(1).integers(0, 256, 5000).astype(np.uint8)
    assert chunk_dedup.gear(data).tolist() == brute_gear(data.tobytes())


def test_borders_against_one_pass():
    for text in ("", "a", "a b " * 400, "x" * 5000, "é漢😀" * 900, " ".join(words_of(3000, 3)), " " * 3000):
        data, want = brute_chunks(text)
        ends = chunk_dedup.borders(data)
        assert ends == [b for _, b in want]
        assert all(data[a:b].decode() is not None for a, b in want)


def test_query_against_brute_force(spark, data, texts):
    got = sorted(tuple(r) for r in chunk_dedup.op5_chunk_dedup(spark, f"{data}/sf0.001").collect())
    assert got == sorted(brute(texts))


def test_an_insertion_shifts_few_borders(spark):
    base = " ".join(words_of(2000, 4))
    rows = [(1, base), (2, "some words put in before " + base), (3, base[:4000] + "inserted " + base[4000:])]
    out = {r[0]: r for r in chunk_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in (2, 3):
        assert sum(s.end - s.start for s in out[i].removed) > 0.9 * len(base)
    assert not out[1].removed and bytes(out[1].kept) == base.encode()


def test_an_insertion_without_white_space(spark):
    rng = np.random.default_rng(5)
    chinese = "".join(map(chr, rng.integers(0x4E00, 0x9FA5, 6000)))
    code = "".join(map(chr, rng.integers(0x21, 0x7F, 12000)))
    for base, put in ((chinese, "新"), (code, "x")):
        rows = [(1, base), (2, put + base), (3, base[:2000] + put + base[2000:])]
        out = {r[0]: r for r in chunk_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        for i in (2, 3):
            assert sum(s.end - s.start for s in out[i].removed) > 0.8 * len(base.encode())
        assert not out[1].removed and bytes(out[1].kept) == base.encode()
        data = base.encode()
        ends = chunk_dedup.borders(data)
        assert ends[-1] == len(data) and all(data[a:b].decode() for a, b in zip([0, *ends], ends))
    passage = chinese[1000:3000]  # a passage at another offset in another text
    rows = [(1, chinese), (2, "".join(map(chr, rng.integers(0x4E00, 0x9FA5, 777))) + passage)]
    out = {r[0]: r for r in chunk_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(s.end - s.start for s in out[2].removed) > 0.7 * len(passage.encode())


def test_awkward_and_empty(awkward, empty):
    out = chunk_dedup.dedup(awkward).collect()
    assert len(out) == awkward.count()
    for r in out:
        assert r.n_bytes == len(r.kept) + sum(s.end - s.start for s in r.removed)
    assert [(r.n_bytes, len(r.kept)) for r in out if r.doc_id in (2, 3)] == [(0, 0), (0, 0)]
    assert chunk_dedup.dedup(empty).count() == 0
