"""Toxicity by a support vector machine over a gap-weighted subsequence kernel with Nyström landmarks.

The kernel of two strings sums, over common subsequences of ``ORDER`` characters, DECAY to the length each spans in both,
so that "i-d-i-o-t" or "idiiot" is still near "idiot"; it is normalised to 1 for equal strings. Sentences are taken as
their pieces: the words split by white space in lower case without marks at their ends, runs of three or more single
characters written apart taken together, and pieces over PIECE characters in halves that overlap. The kernel of two texts
is the sum over their pairs of pieces of the pieces' kernel to the power POWER, k(x, y), scaled to
k(x, y) / sqrt((1 + k(x, x)) (1 + k(y, y))), so that long texts don't outweigh. Landmarks are texts of one piece: with
f(x) = K_mm^(-1/2) k_m(x), the Nyström map is f(x) / sqrt(1 + |f(x)|^2). It feeds a linear machine with squared hinge loss,
whose margin a logistic curve turns into a probability.

Landmarks are the pieces whose document frequency tells the classes of the labelled sample apart best, no two alike,
and some common ones of the other class. The sample is bounded: about ``sample`` labelled documents of each class, drawn by a hash of the id; documents are scored whole.

Cases: a null or empty text has no pieces and the score of an all-zero kernel; null labels aren't learned from; labels
that repeat or have no document count as the join gives them; without both classes every score is the share of label 1
(0 if there is none); repeated rows give a row each; other columns are not carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import checkpoint, remainder, sliced, table

ORDER, DECAY, PIECE, POWER = 3, np.float32(0.75), 24, 6
#: Lengths of the stems of pieces that can be landmarks, beside whole pieces.
STEMS = (5, 6, 7, 8)
_apart = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")
_edges = re.compile(r"^\W+|\W+$")


def pieces(text: str | None) -> list[str]:
    """All pieces of a text, repeated ones included."""
    if not text:
        return []
    text = text.lower()
    out = [x if x.isalnum() else _edges.sub("", x) for x in text.split()]
    if len(out) > 2:
        out += ["".join(m[0].split()) for m in _apart.finditer(text)]
    if len(text) > PIECE and any(len(x) > PIECE for x in out):
        out = [x[i : i + PIECE] for x in out for i in (range(0, max(1, len(x) - PIECE // 2), PIECE // 2) if len(x) > PIECE else (0,))]
    return out


def _codes(words: list[str]) -> np.ndarray:
    """(n, length) code points of words of one length."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def _decays(width: int) -> np.ndarray:
    gap = np.arange(width)[None, :] - np.arange(width)[:, None]
    return np.where(gap >= 0, DECAY ** np.maximum(gap, 0), 0).astype(np.float32) * DECAY * DECAY


def _subsequences(same, steps: int, decays: np.ndarray) -> np.ndarray:
    """The kernel for three characters by dynamic programming over the first string. ``same(j)`` gives, as (rows, inner,
    width), which characters of the second string are the j-th of the first, as 0 and 1, and that times ``decays``."""
    one = two = total = None
    for j in range(steps):
        m, faded = same(j)
        if one is None:
            one, two, total = faded.copy(), np.zeros_like(m), np.zeros(m.shape[:2], np.float32)
            continue
        later = m[:, :, 1:]
        total += (later * two[:, :, :-1]).sum(2)
        two *= DECAY
        two += (later * one[:, :, :-1]) @ decays[1:]
        one *= DECAY
        one += faded
    return total * DECAY * DECAY


@dataclass
class Landmarks:
    """Landmarks as a table of matches by character, and their own kernels."""

    words: list[str]
    code: dict[int, int] = field(default_factory=dict)
    match: np.ndarray | None = None
    faded: np.ndarray | None = None
    own: np.ndarray | None = None

    def __post_init__(self):
        width = max(map(len, self.words), default=1)
        self.code = {ord(c): i + 2 for i, c in enumerate(sorted(set("".join(self.words))))}
        self.match = np.zeros((len(self.code) + 2, len(self.words), width), np.float32)
        for k, w in enumerate(self.words):
            for t, c in enumerate(w):
                self.match[self.code[ord(c)], k, t] = 1
        self.faded = self.match @ _decays(width)
        self.own = np.array([float(own_kernel(_codes([w]))[0]) for w in self.words], np.float32)

    def kernels(self, words: list[str]) -> np.ndarray:
        """(words, landmarks) normalised kernels. The words are taken in order, so that those that begin alike, with the
        same letters or with letters that no landmark has, share the sums of their beginnings."""
        out = np.zeros((len(words), len(self.words)), np.float32)
        size = np.fromiter(map(len, words), np.int64, len(words))
        some = np.flatnonzero(size >= ORDER)
        if not len(some) or not self.words:
            return out
        size = size[some]
        width = int(size.max())
        raw = np.frombuffer("".join([words[i].ljust(width, "\0") for i in some.tolist()]).encode("utf-32-le"), np.uint32).reshape(len(some), width)
        known = np.array(sorted(self.code), np.uint32)
        at = np.minimum(np.searchsorted(known, raw), len(known) - 1)
        codes = np.where(known[at] == raw, at + 2, 1).astype(np.uint16)  # 1: in no landmark
        codes[np.arange(width) >= size[:, None]] = 0
        order = np.lexsort(codes.T[::-1])
        for start in range(0, len(order), 1024):
            part = order[start : start + 1024]
            out[some[part]] = self._of_sorted(codes[part], size[part])
        own = np.ones(len(some), np.float32)
        for n in np.unique(size).tolist():
            own[size == n] = own_kernel(raw[size == n, :n])
        out[some] /= np.sqrt(np.maximum(own[:, None] * self.own[None, :], 1e-20))
        return out

    def _of_sorted(self, codes: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Kernels of words in order, by dynamic programming over their beginnings: each of these is looked at once."""
        same = np.vstack([np.zeros((1, codes.shape[1]), bool), codes[1:] == codes[:-1]])
        alike = np.where(same.all(1), codes.shape[1], same.argmin(1))  # letters that a word shares with the one before
        decays = _decays(self.match.shape[2])
        one = two = np.zeros((1, *self.match.shape[1:]), np.float32)
        total = np.zeros((1, self.match.shape[1]), np.float32)
        state, out = np.zeros(len(codes), np.int64), np.zeros((len(codes), self.match.shape[1]), np.float32)
        for j in range(codes.shape[1]):
            alive = np.flatnonzero(size > j)
            new = alike[alive] <= j
            first = alive[new]
            before, letter = state[first], codes[first, j]
            later = self.match[letter][:, :, 1:]
            total = total[before] + (later * two[before][:, :, :-1]).sum(2)
            two = two[before] * DECAY
            two += (later * one[before][:, :, :-1]) @ decays[1:]
            one = one[before] * DECAY + self.faded[letter]
            state[alive] = np.cumsum(new) - 1
            done = alive[size[alive] == j + 1]
            out[done] = total[state[done]]
        return out * DECAY * DECAY


def own_kernel(x: np.ndarray) -> np.ndarray:
    """Kernel of each row with itself."""
    if x.shape[1] < ORDER:
        return np.full(len(x), 1e-10, np.float32)
    decays = _decays(x.shape[1])

    def same(j: int) -> tuple[np.ndarray, np.ndarray]:
        m = (x == x[:, j : j + 1]).astype(np.float32)[:, None, :]
        return m, m @ decays

    return _subsequences(same, x.shape[1], decays)[:, 0]


class Pool:
    """The kernel of a text with each landmark. Kernels of pieces seen lately are kept, to a number."""

    def __init__(self, landmarks: Landmarks, keep: int = 300_000):
        self.landmarks, self.keep = landmarks, keep
        self.row: dict[str, int] = {}
        self.rows = np.zeros((1024, len(landmarks.words)), np.float32)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        split = [pieces(x) for x in texts]
        if len(self.row) > self.keep:
            self.row = {}
        new = list({w for s in split for w in s if w not in self.row})
        first = len(self.row)
        self.row.update(zip(new, range(first, first + len(new))))
        if first + len(new) > len(self.rows):
            self.rows = np.resize(self.rows, (2 * (first + len(new)), self.rows.shape[1]))
        self.rows[first : first + len(new)] = self.landmarks.kernels(new) ** POWER
        get = self.row.__getitem__
        out = np.zeros((len(texts), self.rows.shape[1]), np.float32)
        for i, s in enumerate(split):
            if s:
                out[i] = self.rows[np.fromiter(map(get, s), np.int64, len(s))].sum(axis=0)
        return out


def nystrom(kernels: np.ndarray, whiten: np.ndarray) -> np.ndarray:
    """The scaled map of texts from their kernels with the landmarks."""
    f = kernels.astype(np.float64) @ whiten
    return f / np.sqrt(1 + (f**2).sum(axis=1, keepdims=True))


@dataclass
class Model:
    landmarks: Landmarks
    whiten: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    offset: float
    constant: float | None = None

    def score(self, kernels: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(kernels), self.constant)
        margin = nystrom(kernels, self.whiten) @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -500, 500)))


def _machine(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss by Newton's method on the rows inside the margin; y is -1 or 1."""
    a = np.c_[x, np.ones(len(x))]
    beta, keep = np.zeros(a.shape[1]), np.r_[np.full(x.shape[1], ridge), 1e-6]
    for _ in range(50):
        inside = y * (a @ beta) < 1
        s, t, v = a[inside], y[inside], w[inside]
        new = np.linalg.solve(s.T @ (s * v[:, None]) + np.diag(keep), s.T @ (t * v))
        if np.allclose(new, beta, atol=1e-9):
            break
        beta = new
    return beta[:-1], float(beta[-1])


def _logistic(margin: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the curve, with targets drawn in by the class sizes so that it stays finite."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, beta = np.c_[margin, np.ones(len(margin))], np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -500, 500)))
        step = np.linalg.solve(a.T @ (a * (w * p * (1 - p))[:, None]) + 1e-6 * np.eye(2), a.T @ (w * (t - p)) - 1e-6 * beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def candidates(text: str | None) -> set[str]:
    """Pieces of a text and their stems."""
    own = set(pieces(text))
    return own | {x[:k] for x in own for k in STEMS if len(x) > k}


def choose(frame: DataFrame, rows: DataFrame, positives: int, negatives: int, n_pos: int, n_neg: int) -> list[str]:
    """Landmarks from (piece, pos, neg), the document frequencies in the sample. Of the pieces that tell the classes apart
    best, each step takes the one that adds most, where a document of label 1 counts half as much after each landmark that
    it has. The top of each order alone is collected, and which of those a document of the bounded sample has."""
    p, q = (F.col("pos") + 0.5) / (n_pos + 1), (F.col("neg") + 0.5) / (n_neg + 1)
    scored = frame.where(F.length("piece") > ORDER).withColumn("gain", p * F.log(p / q))
    top = [(r.piece, r.gain * (n_pos + 1) / (r.pos + 0.5)) for r in scored.orderBy(F.desc(F.round("gain", 9)), F.desc(F.length("piece")), "piece").limit(40 * positives).collect() if r.gain > 0]
    number = {w: i for i, (w, _) in enumerate(top)}

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([pa.array([sorted(number[w] for w in candidates(x) if w in number) for x in batch.column(0).to_pylist()], pa.list_(pa.int32()))], ["has"])

    docs = [r.has for r in rows.where("is").select("text").mapInArrow(held, "has array<int>").collect()]
    has = np.zeros((len(docs), len(top)), bool)
    for d, x in enumerate(docs):
        has[d, x] = True
    worth, left, out = np.array([round(g, 6) for _, g in top]), np.ones(len(docs)), []
    while len(out) < positives and len(top):
        best = int(((left @ has) * worth).argmax())
        if worth[best] <= 0:
            break
        if not out or Landmarks(out).kernels([top[best][0]]).max() < 0.8:
            out.append(top[best][0])
            left[has[:, best]] /= 2
        worth[best] = 0
    usual = [r.piece for r in scored.where("neg >= pos").orderBy(F.desc("neg"), "piece").limit(20 * negatives).collect()]
    n = len(out)
    for w in usual:
        if len(out) < n + negatives and (not out or Landmarks(out).kernels([w]).max() < 0.6):
            out.append(w)
    return out


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 1500, positives: int = 40, negatives: int = 4, ridge: float = 0.01, sizes: dict[int, int] | None = None) -> Model:
    """A model of label 1. ``labelled`` should be the bounded sample of sample_of(); ``sizes``: label counts of all."""
    rows = labelled.select(F.col(text_col).alias("text"), (F.col(label_col) == 1).alias("is"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            n: dict[str, list[int]] = {}
            for text, is_one in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w in candidates(text):
                    n.setdefault(w, [0, 0])[not is_one] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array([x[0] for x in n.values()], pa.int64()), pa.array([x[1] for x in n.values()], pa.int64())], ["piece", "pos", "neg"])

    counts = {bool(r["is"]): r["count"] for r in rows.groupBy("is").count().collect()}
    total = sizes or {1: counts.get(True, 0), 0: counts.get(False, 0)}
    n1, n0 = counts.get(True, 0), counts.get(False, 0)
    if not n1 or not n0:
        share = total.get(1, 0) / max(1, total.get(1, 0) + total.get(0, 0))
        return Model(Landmarks([]), np.zeros((0, 0)), np.zeros(0), 0.0, 0.0, 0.0, float(share))
    frame = rows.mapInArrow(split, "piece string, pos long, neg long").groupBy("piece").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    landmarks = Landmarks(choose(frame, rows, positives, negatives, n1, n0))
    m = len(landmarks.words)

    def kernels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = Pool(landmarks)
        for batch in sliced(batches):
            k = pool(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(k.ravel().astype(np.float64)), m).cast(pa.list_(pa.float64())) if m else pa.array([[]] * len(k), pa.list_(pa.float64())), batch.column(1)], ["k", "is"])

    got = rows.mapInArrow(kernels, "k array<double>, is boolean").collect()
    x, y = np.array([r.k for r in got]).reshape(len(got), m), np.array([1.0 if r["is"] else -1.0 for r in got])
    vals, vecs = np.linalg.eigh(np.atleast_2d(landmarks.kernels(landmarks.words).astype(np.float64) ** POWER))
    whiten = vecs @ np.diag(1 / np.sqrt(np.maximum(vals, 1e-3))) @ vecs.T
    mapped = nystrom(x, whiten)
    weight, bias = _machine(mapped, y, np.where(y > 0, n0, n1) / max(n0, n1), ridge)
    margin = mapped @ weight + bias
    slope, offset = _logistic(margin, y, np.where(y > 0, total.get(1, n1) / n1, total.get(0, n0) / n0) / max(1e-9, (total.get(1, n1) + total.get(0, n0)) / len(y)))
    return Model(landmarks, whiten, weight, bias, slope, offset)


def sample_of(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 1500) -> tuple[DataFrame, dict[int, int]]:
    """About ``sample`` labelled documents of each class, and how many rows have each label."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label")).where("_id is not null and _label in (0, 1)")
    sizes = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    share = F.when(F.col("_label") == 1, F.lit(sample / max(1, sizes.get(1, 0)))).otherwise(F.lit(sample / max(1, sizes.get(0, 0))))
    drawn = known.where(F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(1 << 30)) < share * (1 << 30))
    # about two samples of ids and labels: bounded, so sent to all tasks rather than shuffling documents
    return docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias(text_col)).join(F.broadcast(drawn), F.col("_doc") == F.col("_id")).select(F.col("_doc").alias(id_col), text_col, F.col("_label").alias(label_col)), sizes


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id, score, predicted) of every whole text."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        pool = Pool(model.landmarks)
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(pool(batch.column(1).to_pylist())), pa.float64())], schema.names)

    return df.select(id_col, text_col).mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


HOLD_OUT, HELD = 4, 2


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    drawn, sizes = sample_of(docs, labels.where(remainder("doc_id", HOLD_OUT) != HELD))
    out = score(docs, fit(checkpoint(drawn), sizes=sizes))
    return out.select("doc_id", (remainder("doc_id", HOLD_OUT) == HELD).alias("held_out"), "score", "predicted")
