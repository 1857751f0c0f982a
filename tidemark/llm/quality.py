"""Quality of documents by a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector: its words, hashed into WORDS places, with the logarithm of their counts scaled to length 1;
each structure statistic (lengths, shares of upper case, symbols, digits and marks, distinct words, the most frequent word,
lines that repeat or end in a mark) as one of a few intervals; and the declared length, as an interval or as missing. The
machine scores sigmoid(w0 + <w, x> + sum over pairs i < j of <v_i, v_j> x_i x_j). The pairs are never listed: by the
sum-of-squares identity their sum is half of |sum_i v_i x_i|^2 - sum_i |v_i x_i|^2, linear in the entries of x.

It is fitted on a bounded sample: about ``sample`` labelled documents of each class, drawn by a hash of the id, weighted so
that the classes keep the shares of all labels; intervals are cut at quantiles of the two classes. The fit is by AdaGrad in
a fixed order from a fixed seed. Every whole text is scored, in pieces of PIECE characters cut at white space.

Cases: a null or an empty text has statistics of 0 and no words, so it has a score; a null or negative declared length is
an interval of its own; null labels aren't learned from; labels that repeat or have no document count as the join gives
them; without both classes every score is the share of label 1 (0 if there is none); repeated rows give a row each; a
word of over PIECE characters counts as several; other columns are not carried.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import remainder, sliced, table

WORDS, FACTORS, PIECE = 4096, 8, 1 << 20
#: Classes of ASCII bytes; bytes above belong to letters.
UPPER, LOWER, DIGIT, MARK, SYMBOL, BLANK = range(6)
_class = np.full(256, SYMBOL)
_class[128:], _class[:33], _class[127] = LOWER, BLANK, BLANK
for _group, _chars in ((UPPER, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (LOWER, "abcdefghijklmnopqrstuvwxyz"), (DIGIT, "0123456789"), (MARK, ".,;:'\"()-?")):
    _class[[ord(c) for c in _chars]] = _group
STATISTICS = ("words", "word_length", "upper", "symbols", "digits", "marks", "distinct", "most_frequent", "lines_repeated", "lines_ended", "line_length", "declared")


def _pieces(text: str) -> Iterator[str]:
    start = 0
    while len(text) - start > PIECE:
        end = max(text.rfind("\n", start, start + PIECE), text.rfind(" ", start, start + PIECE)) + 1
        end = end if end > start else start + PIECE
        yield text[start:end]
        start = end
    yield text[start:] if start else text


def describe(text: str | None, declared: int | None, places: dict[str, int]) -> tuple[list[float], dict[int, int]]:
    """The statistics of a text, and its counts by place. ``places`` keeps the places of words seen."""
    counts, lines, seen, repeated, ended = Counter(), 0, set(), 0, 0
    bytes_of = np.zeros(256, np.int64)
    for piece in _pieces(text or ""):
        counts.update(piece.split())
        bytes_of += np.bincount(np.frombuffer(piece.encode("utf-8", "replace"), np.uint8), minlength=256)
        for line in piece.split("\n"):
            if line := line.strip():
                lines += 1
                ended += line[-1] in ".!?"
                known = len(seen)
                seen.add(hash(line))
                repeated += len(seen) == known
    kinds = np.bincount(_class, weights=bytes_of, minlength=6)
    words, dark = sum(counts.values()), max(1.0, float(kinds.sum() - kinds[BLANK]))
    hashed: dict[int, int] = {}
    for w, n in counts.items():
        at = places.get(w)
        if at is None:
            if len(places) > 500_000:
                places.clear()
            at = places[w] = zlib.crc32(w.encode("utf-8", "replace")) % WORDS
        hashed[at] = hashed.get(at, 0) + n
    some = max(1, words)
    return [
        math.log2(1 + words), dark / some if words else 0.0, float(kinds[UPPER]) / max(1.0, float(kinds[UPPER] + kinds[LOWER])), float(kinds[SYMBOL]) / dark, float(kinds[DIGIT]) / dark, float(kinds[MARK]) / dark,
        len(counts) / some, max(counts.values(), default=0) / some, repeated / max(1, lines), ended / max(1, lines), math.log2(1 + words / max(1, lines)), -1.0 if declared is None or declared < 0 else math.log2(1 + declared),
    ], hashed


@dataclass
class Intervals:
    """Where each statistic is cut; the places of intervals come after those of words."""

    cuts: list[np.ndarray]

    def __post_init__(self):
        self.first = WORDS + np.cumsum([0, *(len(c) + 1 for c in self.cuts)])
        self.places = int(self.first[-1])

    def of(self, statistics: np.ndarray) -> np.ndarray:
        """(documents, statistics) places."""
        return np.stack([self.first[k] + np.searchsorted(c, statistics[:, k], side="right") for k, c in enumerate(self.cuts)], axis=1)


@dataclass
class Sparse:
    """Rows of (place, value), all at least one long."""

    starts: np.ndarray
    place: np.ndarray
    value: np.ndarray

    def rows(self, which: np.ndarray) -> Sparse:
        ends = np.r_[self.starts[1:], len(self.place)]
        size = (ends - self.starts)[which]
        starts = np.cumsum(np.r_[0, size[:-1]])
        at = np.arange(size.sum()) - np.repeat(starts - self.starts[which], size)
        return Sparse(starts, self.place[at], self.value[at])


def sparse(statistics: np.ndarray, hashed: list[tuple[np.ndarray, np.ndarray]], intervals: Intervals) -> Sparse:
    """Vectors of documents; ``hashed``: places and counts of each one's words."""
    bins = intervals.of(statistics)
    place, value = [], []
    for b, (at, n) in zip(bins, hashed):
        x = np.log1p(n)
        place += [at, b]
        value += [x / max(1e-9, math.sqrt(float(x @ x))), np.ones(len(b))]
    size = np.array([len(at) for at, _ in hashed]) + bins.shape[1]
    return Sparse(np.cumsum(np.r_[0, size[:-1]]), np.concatenate(place), np.concatenate(value))


@dataclass
class Machine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def parts(self, x: Sparse) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Margins, sums of factors by row, and the entries' factors."""
        own = self.factor[x.place] * x.value[:, None]
        total = np.add.reduceat(own, x.starts, axis=0)
        squares = np.add.reduceat((own**2).sum(axis=1), x.starts)
        linear = np.add.reduceat(self.weight[x.place] * x.value, x.starts)
        return self.bias + linear + ((total**2).sum(axis=1) - squares) / 2, total, own

    def score(self, x: Sparse) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.parts(x)[0], -500, 500)))


@dataclass
class Model:
    intervals: Intervals
    machine: Machine
    constant: float | None = None


def train(x: Sparse, y: np.ndarray, weight: np.ndarray, places: int, epochs: int = 30, rate: float = 0.1, ridge: float = 1e-4, batch: int = 128, seed: int = 11) -> Machine:
    """AdaGrad on the weighted logistic loss; y is 0 or 1."""
    rng = np.random.default_rng(seed)
    share = float((weight * y).sum() / weight.sum())
    m = Machine(math.log(share / (1 - share)), np.zeros(places), rng.normal(0, 0.05, (places, FACTORS)))
    seen_w, seen_v, seen_b = np.full(places, 1e-6), np.full((places, FACTORS), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for s in range(0, len(order), batch):
            which = order[s : s + batch]
            part = x.rows(which)
            margin, total, own = m.parts(part)
            error = weight[which] * (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - y[which]) / len(which)
            size = np.diff(np.r_[part.starts, len(part.place)])
            e = np.repeat(error, size) * part.value
            touched, at = np.unique(part.place, return_inverse=True)
            sums = lambda v: np.bincount(at, v, len(touched))
            g_w = sums(e) + ridge * m.weight[touched]
            pull = np.repeat(total, size, axis=0) - own
            g_v = np.stack([sums(e * pull[:, k]) for k in range(FACTORS)], axis=1) + ridge * m.factor[touched]
            seen_w[touched] += g_w**2
            seen_v[touched] += g_v**2
            seen_b += error.sum() ** 2
            m.weight[touched] -= rate * g_w / np.sqrt(seen_w[touched])
            m.factor[touched] -= rate * g_v / np.sqrt(seen_v[touched])
            m.bias -= rate * error.sum() / math.sqrt(seen_b)
    return m


def _described(batch: pa.RecordBatch, places: dict[str, int]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    statistics, hashed = [], []
    for text, declared in zip(batch.column("text").to_pylist(), batch.column("declared").to_pylist()):
        s, h = describe(text, declared, places)
        statistics.append(s)
        hashed.append((np.fromiter(h, np.int64, len(h)), np.fromiter(h.values(), np.float64, len(h))))
    return np.array(statistics).reshape(len(hashed), len(STATISTICS)), hashed


def sample_of(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", label_col: str = "quality", sample: int = 3000) -> tuple[DataFrame, dict[int, int]]:
    """(id, text, declared, label) of about ``sample`` labelled documents of each class, and how many rows have each label."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("label")).where("_id is not null and label in (0, 1)")
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = F.when(F.col("label") == 1, sample / max(1, sizes.get(1, 0))).otherwise(sample / max(1, sizes.get(0, 0)))
    drawn = known.where(F.pmod(F.xxhash64("_id", F.lit("quality")), F.lit(1 << 30)) < share * (1 << 30))
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(length_col).cast("long").alias("declared"))
    # about two samples of ids and labels: bounded, so sent to all tasks rather than shuffling documents
    return own.join(F.broadcast(drawn), F.col("id") == F.col("_id")).drop("_id"), sizes


def fit(drawn: DataFrame, sizes: dict[int, int], cuts: int = 10, epochs: int = 30) -> Model:
    """A model of label 1 from the rows of sample_of(). Their vectors, not their texts, come to the driver: at most WORDS
    entries for each of about two samples of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[str, int] = {}
        for batch in sliced(batches):
            statistics, hashed = _described(batch, places)
            yield pa.RecordBatch.from_pydict({"id": batch.column("id").cast(pa.string()), "label": batch.column("label").cast(pa.int32()), "s": pa.array(statistics.tolist(), pa.list_(pa.float64())), "at": pa.array([a.astype(np.int32) for a, _ in hashed], pa.list_(pa.int32())), "n": pa.array([n.astype(np.float32) for _, n in hashed], pa.list_(pa.float32()))})

    t = drawn.mapInArrow(run, "id string, label int, s array<double>, at array<int>, n array<float>").toArrow()
    y = np.array(t.column("label").to_pylist(), float)
    total = sizes.get(0, 0) + sizes.get(1, 0)
    none = Intervals([np.zeros(0)] * len(STATISTICS))
    if not len(y) or y.min() == y.max():
        return Model(none, Machine(0.0, np.zeros(0), np.zeros((0, FACTORS))), sizes.get(1, 0) / max(1, total))
    statistics = np.array(t.column("s").to_pylist())
    hashed = [(np.array(a, np.int64), np.array(n, float)) for a, n in zip(t.column("at").to_pylist(), t.column("n").to_pylist())]
    order = sorted(range(len(y)), key=lambda i: (t.column("id")[i].as_py(), y[i], statistics[i].tolist()))
    y, statistics, hashed = y[order], statistics[order], [hashed[i] for i in order]
    at = np.linspace(0, 1, cuts + 1)[1:-1]
    intervals = Intervals([np.unique(np.round(np.r_[np.quantile(c[y == 0], at), np.quantile(c[y == 1], at)], 6)) for c in statistics.T])
    weight = np.where(y == 1, sizes.get(1, 0) / (y == 1).sum(), sizes.get(0, 0) / (y == 0).sum()) * len(y) / total
    return Model(intervals, train(sparse(statistics, hashed, intervals), y, weight, intervals.places, epochs))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", threshold: float = 0.3) -> DataFrame:
    """(id, score, predicted) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, places = sent.value, {}
        for batch in sliced(batches):
            if model.constant is not None:
                found = np.full(batch.num_rows, model.constant)
            else:
                found = model.machine.score(sparse(*_described(batch, places), model.intervals))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], schema.names)

    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"), F.col(length_col).cast("long").alias("declared"))
    return rows.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


HOLD_OUT, HELD = 5, 0


def op11_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(*sample_of(docs, labels.where(remainder("doc_id", HOLD_OUT) != HELD)))
    return score(docs, model).select("doc_id", (remainder("doc_id", HOLD_OUT) == HELD).alias("held_out"), "score", "predicted")
