import zlib
from itertools import combinations

import numpy as np
from cases import words_of

from tidemark.llm import toxicity


def brute_kernel(a, b, order=3, decay=0.75):
    """All common subsequences of three characters, each to the length it spans."""
    total = 0.0
    for i in combinations(range(len(a)), order):
        for j in combinations(range(len(b)), order):
            if all(a[x] == b[y] for x, y in zip(i, j)):
                total += decay ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def test_kernel_against_enumeration():
    marks = ["idiot", "loser", "aaaa", "abcabc"]
    words = ["idiot", "idiiot", "i-d-i-o-t", "lossser", "aaa", "abc", "xyz", "ab", "", "trash idiot"]
    got = toxicity.Landmarks(marks).kernels(words)
    for i, w in enumerate(words):
        for k, m in enumerate(marks):
            own = brute_kernel(w, w) * brute_kernel(m, m)
            want = brute_kernel(w, m) / own**0.5 if own else 0.0
            assert abs(got[i, k] - want) < 1e-4, (w, m)


def test_words_share_their_beginnings():
    rng = np.random.default_rng(4)
    words = list({"".join(rng.choice(list("abcxyé"), rng.integers(0, 9))) for _ in range(1500)})
    marks = toxicity.Landmarks(["abca", "bcab", "cccab"])
    together, apart = marks.kernels(words), np.vstack([marks.kernels([w]) for w in words])
    assert np.allclose(together, apart, atol=1e-6)


def test_map_is_that_of_the_kernel():
    """Texts made of landmarks have the kernel of texts, summed over pairs of pieces and scaled, as products of their maps."""
    marks = ["idiot", "loser", "weather", "pathetic"]
    landmarks = toxicity.Landmarks(marks)
    k = landmarks.kernels(marks).astype(float) ** toxicity.POWER
    vals, vecs = np.linalg.eigh(k)
    whiten = vecs @ np.diag(vals**-0.5) @ vecs.T
    texts = ["idiot", "loser idiot idiot", "weather pathetic", "loser", ""]
    mapped = toxicity.nystrom(toxicity.Pool(landmarks)(texts), whiten)
    count = np.array([[t.split().count(m) for m in marks] for t in texts], float)
    raw = count @ k @ count.T
    want = raw / np.sqrt((1 + np.diag(raw))[:, None] * (1 + np.diag(raw))[None, :])
    assert np.allclose(mapped @ mapped.T, want, atol=1e-3)


def test_gapped_insults_stay_near():
    near = toxicity.Landmarks(["idiot"]).kernels(["idi0ot", "id-iot", "weather"])[:, 0]
    assert near[0] > 0.4 and near[1] > 0.4 and near[2] < 0.1


def test_pieces_join_letters_written_apart():
    assert "idiot" in toxicity.pieces("you i d i o t there")
    assert toxicity.pieces(None) == [] and toxicity.pieces("  ") == []
    assert max(map(len, toxicity.pieces("x" * 100))) <= toxicity.PIECE


def test_held_out_documents_are_told(spark, data):
    got = {r.doc_id: r for r in toxicity.op4_toxicity(spark, f"{data}/sf0.1").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data}/sf0.1/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{data}/sf0.1/documents.parquet").count()
    for i, r in list(got.items())[:500]:
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(labels[i], r.score, r.predicted) for i, r in got.items() if r.held_out and i in labels]
    y, s, p = (np.array(x) for x in zip(*held))
    precision, recall = (y * p).sum() / max(1, p.sum()), (y * p).sum() / max(1, y.sum())
    assert y.sum() > 20 and precision > 0.85 and recall > 0.83
    ranks = s.argsort().argsort()
    area = (ranks[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (1 - y).sum())
    assert area > 0.95


def labelled(spark, n=60):
    rows = [(k, " ".join(words_of(20, k)) + (" you stupid moron" if k % 3 == 0 else " have a nice day"), k % 3 == 0) for k in range(n)]
    return spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), spark.createDataFrame([(i, int(x)) for i, _, x in rows], "doc_id long, toxic int")


def test_awkward_and_empty(spark, awkward, empty):
    docs, labels = labelled(spark)
    drawn, sizes = toxicity.sample_of(docs, labels)
    model = toxicity.fit(drawn, sizes=sizes)
    out = toxicity.score(awkward, model).collect()
    assert len(out) == awkward.count() and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id in (2, 3, 4)}) == 1
    assert toxicity.score(empty, model).count() == 0
    new = spark.createDataFrame([(1, "some text s-t-u-p-i-d m0ron you"), (2, "a nice nice day")], "doc_id long, text string")
    bad, good = (r.score for r in toxicity.score(new, model).orderBy("doc_id").collect())
    assert bad > good


def test_without_both_classes(spark):
    docs, labels = labelled(spark)
    for rows, want in ((labels.limit(0), 0.0), (labels.where("toxic = 0"), 0.0), (labels.where("toxic = 1"), 1.0), (labels.selectExpr("doc_id", "cast(null as int) toxic"), 0.0)):
        drawn, sizes = toxicity.sample_of(docs, rows)
        assert {r.score for r in toxicity.score(docs, toxicity.fit(drawn, sizes=sizes)).collect()} == {want}
