"""The pipeline's stages against plain versions, each on the stage's own input."""

import re
from hashlib import sha256

import corpus_pipeline
import public_tokenizers
import pytest
from test_decontaminate import brute as hit_words
from test_jaccard_join import brute as groups
from test_sanitise import brute_disclosure, brute_spans, classes
from tokenizers import Tokenizer

from tidemark.llm import language_id


@pytest.fixture(scope="module")
def sf(data):
    return f"{data}/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, docs, sf, tmp_path_factory):
    """What goes into each stage and what comes out, written and read again in between."""
    out, now = [docs], docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, now, sf).write.parquet(path)
        now = spark.read.parquet(path)
        out.append(now)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_names_and_columns(steps, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "personal_data", "encoding"]
    for df in steps[:-1]:
        assert df.columns == docs.columns and [t for _, t in df.dtypes] == [t for _, t in docs.dtypes]


def test_language_keeps_what_has_letters_and_a_language(steps):
    before, after = rows(steps[0]), rows(steps[1])
    model = language_id.fit_documents(steps[0])
    for i, r in before.items():
        if not re.search(r"[^\W\d_]", r.text or ""):
            assert i not in after
        else:
            bits = language_id.code_lengths(model, r.text)
            assert (i in after) == (1 / sum(2.0 ** max(bits.min() - b, -1000) for b in bits) >= 0.5)


def test_one_of_each_group_stays(steps):
    before, after = rows(steps[1]), rows(steps[2])
    want = {c for _, _, c in groups([(i, r.text) for i, r in before.items()], 5, 80)}
    assert set(after) == want and len(want) < len(before)


def test_benchmark_passages_go(spark, steps, sf):
    before, after = rows(steps[2]), rows(steps[3])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    pairs = [(i, r.text) for i, r in before.items()]
    assert set(after) == {i for (i, _), (_, hit, _) in zip(pairs, hit_words(pairs, items)) if not hit}


def test_personal_data_goes_and_documents_stay(steps):
    before, after = rows(steps[3]), rows(steps[4])
    assert before.keys() == after.keys()
    giving = brute_disclosure([(i, r.text) for i, r in before.items()])
    for i, r in before.items():
        spans = brute_spans(r.text)
        own = {c for a, b, k in spans for c in classes(k, r.text[a:b])}
        terms = {t for e, t in giving if e in own}
        extra = [(m.start(), m.end(), "term") for m in re.finditer(r"\w+", r.text) if m[0].lower() in terms and not any(a < m.end() and m.start() < b for a, b, _ in spans)]
        out, at = "", 0
        for a, b, k in sorted(spans + extra, key=lambda x: x[0]):
            out, at = (out + r.text[at:a] + f"[{k.upper()}]" if a >= at else out), max(at, b)
        assert after[i].text == out + r.text[at:]
        assert after[i].n_chars == len(after[i].text)


def test_encoding_and_run(spark, steps, sf):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    before, after = rows(steps[4]), rows(steps[5])
    assert before.keys() == after.keys()
    for i, r in before.items():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert after[i].ids_sha256 == sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert after[i].decoded_sha256 == sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, steps[5].collect()))


def test_awkward_and_empty(spark, awkward, empty, sf):
    for df in (awkward, awkward.withColumn("_gone", awkward.doc_id), empty):
        now = df
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, sf)
        kept = [r.doc_id for r in now.collect()]
        assert len(kept) == len(set(kept)) and not set(kept) & {2, 3, 4, 6, 7, 10}
        assert bool(kept) == (df is not empty) and (df is empty or {1, 5} <= set(kept) and None not in kept)  # the null id has the text of 1


LETTERS = [" ".join(f"{a}{b}o" for b in "bcdfghjklm") for a in "aeiu"]


def told(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_near_duplicates_by_row(spark, docs):
    """Ids that stand with other texts, null ids and repeated rows."""
    x, y, z, w = LETTERS
    rows = [(1, x), (5, x), (5, y), (9, z), (None, x), (None, w), (None, w), (9, z), (3, w), (None, None), (None, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 3) for i, t in rows], docs.schema)
    want = [(1, x), (5, y), (9, z), (3, w), (None, None), (None, "")]
    assert told(corpus_pipeline.drop_near_duplicates(spark, df, None)) == sorted(want, key=repr)
    nulls = spark.createDataFrame([(None, x, "en", "s", 3)] * 3, docs.schema)
    assert told(corpus_pipeline.drop_near_duplicates(spark, nulls, None)) == [(None, x)]


def test_benchmark_passages_by_row(spark, docs, tmp_path):
    x, y, _, _ = LETTERS
    spark.createDataFrame([("q", x)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, y), (1, x), (None, x), (None, y), (2, "before " + x + " after"), (3, None), (4, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 3) for i, t in rows], docs.schema)
    want = [(1, y), (None, y), (3, None), (4, "")]
    assert told(corpus_pipeline.decontaminate_benchmark(spark, df, str(tmp_path))) == sorted(want, key=repr)


def test_whole_run(spark, sf, steps):
    """run() gives what the stages give one after the other, each held against a plain version above."""
    assert sorted(map(repr, corpus_pipeline.run(spark, sf).collect())) == sorted(map(repr, steps[-1].collect()))
