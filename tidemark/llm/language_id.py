"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of order 0 to ``ORDER`` with the bytes that followed each. A byte's
probability comes from the longest context of the tree that ends before it; a byte not seen there costs an escape
(its probability: distinct followers over followers and distinct followers) and is looked for in the next shorter
context, without the bytes excluded so far, down to a uniform order -1. Statistics are frozen after fitting, so the code
length of a byte depends only on the ORDER bytes before it and is tabled once for every node of the joint tree.

Fitting counts byte strings in a sample of labelled documents: in each language whole documents are drawn by a hash of
the id until about ``sample_bytes`` are expected. Scoring reads every byte of every text.

Cases: a null or empty text, and one without letters, gets ``und`` and score 0; rows without lang or text aren't
learned from; without any labelled row all predictions are ``und``; repeated rows give a row each; ties go to the
first language by name; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import remainder, sliced, table

ORDER = 3
UNKNOWN = "und"
BLOCK = 1 << 20
_letter = regex.compile(r"\p{L}").search


@dataclass
class Model:
    """``symbol``: a byte's column (0: not seen in fitting, and the start of a text). ``node``: by three symbols, the
    deepest node that any language's tree has for them. ``bits``: code lengths by node, symbol and language."""

    languages: list[str]
    symbol: np.ndarray
    node: np.ndarray
    bits: np.ndarray


def grams(df: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(lang, gram, n): counts of the strings of ORDER + 1 bytes, in the first of which the start of a text is byte 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(langs, texts):
                by.setdefault(lang, []).append(text.lower().encode())
            for lang, parts in by.items():
                b = np.frombuffer(b"".join(b"\0" * ORDER + x for x in parts), np.uint8).astype(np.uint32)
                packed = b[: len(b) - ORDER].copy()
                for k in range(1, ORDER + 1):
                    packed = packed << np.uint32(8) | b[k : len(b) - ORDER + k]
                packed, n = np.unique(packed[packed & 255 > 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(packed.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    return df.select(lang_col, text_col).mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def sample(df: DataFrame, lang_col: str, text_col: str, id_col: str, sample_bytes: int) -> DataFrame:
    """Whole labelled documents; the share of each language makes about ``sample_bytes`` of it."""
    df = df.select(F.col(id_col).alias("i"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null and text != ''")
    sizes = {r.lang: r.size for r in df.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("size")).collect()}
    if not sizes:
        return df.limit(0)
    share = F.coalesce(*(F.when(F.col("lang") == k, F.lit(min(1.0, sample_bytes / max(1, n)))) for k, n in sorted(sizes.items())))
    return df.where(F.pmod(F.xxhash64("i", F.lit("sample")), F.lit(1 << 30)) < share * (1 << 30))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_bytes: int = 600_000, min_count: int = 2) -> Model:
    """A model of every non-null language. The driver gets at most a count for each byte string of the bounded sample.
    Contexts of full order seen fewer than ``min_count`` times give way to the next shorter one."""
    rows = grams(sample(df, lang_col, text_col, id_col, sample_bytes), "lang", "text").toPandas()
    languages = sorted(rows["lang"].unique().tolist())
    packed = rows["gram"].to_numpy(np.int64)
    parts = [(packed >> 8 * k & 255).astype(np.int64) for k in range(ORDER, -1, -1)]
    seen = np.unique(parts[-1])
    symbol = np.zeros(256, np.int64)
    symbol[seen[seen > 0]] = np.arange(1, (seen > 0).sum() + 1)
    n = int((seen > 0).sum()) + 1
    parts = [symbol[p] for p in parts]
    which = np.searchsorted(languages, rows["lang"].to_numpy(str)) if languages else np.zeros(0, int)
    count = rows["n"].to_numpy(np.float64)

    node = np.zeros((n, n, n), np.int32)  # the root is node 0
    context: list[tuple[int, ...]] = [()]
    for depth in range(1, ORDER + 1):
        key = np.zeros(len(packed), np.int64)
        for p in parts[ORDER - depth : ORDER]:
            key = key * n + p
        keys, at = np.unique(key, return_inverse=True)
        keys = keys[np.bincount(at, count, len(keys)) >= (min_count if depth == ORDER else 1)] if len(keys) else keys
        for k in keys.tolist():
            ctx = tuple(k // n ** (depth - 1 - j) % n for j in range(depth))
            node[(..., *ctx)] = len(context)
            context.append(ctx)

    bits = np.empty((len(context), n, max(1, len(languages))), np.float32)
    for l in range(len(languages)):
        mine = which == l
        tables = []  # by depth: counts by context and symbol
        for depth in range(ORDER + 1):
            key = np.zeros(int(mine.sum()), np.int64)
            for p in parts[ORDER - depth : ORDER]:
                key = key * n + p[mine]
            keys, at = np.unique(key, return_inverse=True)
            t = np.zeros((len(keys) + 1, n))
            np.add.at(t, (at, parts[-1][mine]), count[mine])
            tables.append((keys, t))
        for start in range(0, len(context), 4096):
            some = context[start : start + 4096]
            left, used, p = np.ones(len(some)), np.zeros((len(some), n), bool), np.zeros((len(some), n))
            for depth in range(ORDER, -1, -1):
                keys, t = tables[depth]
                want = np.array([sum(s * n ** (depth - 1 - j) for j, s in enumerate(c[len(c) - depth :])) if len(c) >= depth else -1 for c in some])
                at = np.searchsorted(keys, want)
                at[(want < 0) | (at >= len(keys))] = len(keys)
                at[keys[np.minimum(at, len(keys) - 1)] != want] = len(keys)
                c = np.where(used, 0, t[at])
                total, kinds = c.sum(1), (c > 0).sum(1)
                has = total > 0
                p[has] += left[has, None] * c[has] / (total + kinds)[has, None]
                left[has] *= (kinds / np.maximum(1, total + kinds))[has]
                used |= c > 0
            p += (~used) * (left / np.maximum(1, 256 - used.sum(1)))[:, None]
            bits[start : start + len(some), :, l] = -np.log2(np.maximum(p, 1e-9))
    return Model(languages, symbol.astype(np.int32), node.reshape(-1), bits.reshape(-1, bits.shape[2]))


def code_lengths(model: Model, text: str) -> np.ndarray:
    """Bits of the whole text under each language."""
    n = int(round(len(model.node) ** (1 / 3)))
    b = np.frombuffer(text.lower().encode(), np.uint8)
    total = np.zeros(len(model.languages))
    tail = np.zeros(ORDER, np.int32)
    for start in range(0, len(b), BLOCK):
        s = np.concatenate([tail, model.symbol[b[start : start + BLOCK]]])
        at = model.node[(s[:-3] * n + s[1:-2]) * n + s[2:-1]] * n + s[3:]
        total += model.bits.take(at, axis=0).sum(axis=0, dtype=np.float64)
        tail = s[-ORDER:]
    return total


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, bits_per_byte): the language with the shortest code, its share of probability among the
    languages, and its code length for a byte. The model is bounded by the sample it was fitted on."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])

    def one(text: str | None) -> tuple[str, float, float]:
        model = sent.value
        if not text or not model.languages or not _letter(text):
            return UNKNOWN, 0.0, 0.0
        bits = code_lengths(model, text)
        best = int(bits.argmin())
        return model.languages[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum()), float(bits[best] / len(text.encode()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            got = [one(x) for x in batch.column(1).to_pylist()]
            cols = list(zip(*got)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.float64())], schema.names)

    return df.select(id_col, text_col).mapInArrow(run, schema)


def keep_languages(df: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose text has letters and a language of at least this share of probability.
    Where no language was learned, the letters decide alone."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def good(text: str | None) -> bool:
        if not text or not _letter(text):
            return False
        if not sent.value.languages:
            return True
        bits = code_lengths(sent.value, text)
        return bool(1 / np.exp2(np.maximum(bits.min() - bits, -1000)).sum() >= least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield batch.filter(pa.array([good(x) for x in batch.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)


HOLD_OUT = 5


def fit_documents(docs: DataFrame) -> Model:
    """Fitted on the text and lang of the documents that aren't held out."""
    return fit(docs.where(remainder("doc_id", HOLD_OUT) != 0))


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit_documents(docs)).select("doc_id", (remainder("doc_id", HOLD_OUT) == 0).alias("held_out"), "lang_pred", "score")
