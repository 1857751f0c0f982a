"""Hard negatives of anchors by blocked dense products.

Anchors are packed into blocks of bounded bytes. Each block is broadcast against all rows, which a task takes in pieces:
one matrix product in float64 gives the scores of a piece with a block. A first pass keeps, for each anchor, the best
``positives`` rows of its label; such lists merge by their order, so a task sends one list an anchor, and a window by
anchor ends the work. A second pass knows the scores of the positives and keeps, for each anchor and positive, the best
``negatives`` rows of other labels with low * positive score <= 100 * score <= 100 * positive score.

Components are integers: floor(scale * x). Scores times 100 are exact in float64 while they stay below 2^53, which is
checked for each piece by its largest component; beyond that a piece is multiplied in Python's integers, and a score
outside of 64 bits counts as the nearest end of these.

Cases: rows with a null id, label or vector, or with a null or non-finite component, take no part; a positive has another
id than its anchor; a row that repeats an id is a row of its own, as anchor, positive and negative; vectors of another
length than the anchor's have no score with it, and empty ones score 0 with each other; anchors without positives, and
positives without negatives, give no rows; equal scores stand by the smaller id; an empty table, or one without anchors,
gives no rows; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import table, written

#: Anchors in a block and bytes of their vectors at most, which bounds what is broadcast; scores of a piece with a block.
BLOCK_ROWS, BLOCK_BYTES, PIECE = 8192, 8 << 20, 1 << 20
LEAST, MOST = -(2**63), 2**63 - 1


@dataclass
class Block:
    """Anchors of one vector length; for the second pass the positives of each, ``has`` telling which there are."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    positive: np.ndarray | None = None
    positive_score: np.ndarray | None = None
    has: np.ndarray | None = None


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, x) of the rows that take part."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    return rows.where("id is not null and label is not null and x is not null").where(~F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))


def matrices(batch: pa.RecordBatch, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, vectors of integers) of a batch, for each length of vectors."""
    ids, labels, x = (batch.column(c) for c in ("id", "label", "x"))
    starts, flat = x.offsets.to_numpy(), x.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(starts)
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        v = flat[starts[at][:, None] + np.arange(d)] if d else np.zeros((len(at), 0))
        yield ids.to_numpy()[at], labels.to_numpy()[at], np.nan_to_num(np.floor(v * scale))


def pack(anchors: DataFrame, scale: float) -> tuple[DataFrame, list[tuple[int, int]]]:
    """The anchors as a written table of blocks, and the blocks' keys. Ranges of ids make blocks about half full or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        held: dict[int, list] = {}

        def block(d: int) -> pa.RecordBatch:
            nonlocal made
            made += 1
            ids, labels, v = (np.concatenate(x) for x in zip(*held.pop(d)))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "k": pa.array([made], pa.int32()), "d": pa.array([d], pa.int32()), "ids": [ids.astype("<i8").tobytes()], "labels": [labels.astype("<i8").tobytes()], "vectors": [v.astype("<f8").tobytes()]})

        for batch in batches:
            for ids, labels, v in matrices(batch, scale):
                d = v.shape[1]
                step = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, d))) // 2)
                for s in range(0, len(ids), step):
                    held.setdefault(d, []).append((ids[s : s + step], labels[s : s + step], v[s : s + step]))
                    if sum(len(x[0]) for x in held[d]) >= step:  # two steps at most
                        yield block(d)
        for d in list(held):
            yield block(d)

    parts = -(-anchors.count() // (BLOCK_ROWS // 2)) or 1
    blocks = written(anchors.repartitionByRange(parts, "id").coalesce(parts).mapInArrow(run, "part int, k int, d int, ids binary, labels binary, vectors binary"))
    return blocks, [(r.part, r.k) for r in blocks.select("part", "k").orderBy("part", "k").collect()]


def load(blocks: DataFrame, key: tuple[int, int]) -> Block:
    r = blocks.where((F.col("part") == key[0]) & (F.col("k") == key[1])).first()
    ids = np.frombuffer(r.ids, "<i8")
    return Block(ids, np.frombuffer(r.labels, "<i8"), np.frombuffer(r.vectors, "<f8").reshape(len(ids), r.d))


def scores(v: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """(rows, anchors) inner products: float64 where exact with room for a factor of 100, else Python's integers."""
    bound = v.shape[1] * float(np.abs(v).max(initial=0)) * float(np.abs(anchors).max(initial=0))
    if bound * 100 < 2.0**53:
        return v @ anchors.T
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(v) @ whole(anchors).T, LEAST, MOST)


class Best:
    """The best ``most`` (score, id) of each slot so far: larger scores first, then smaller ids."""

    def __init__(self, slots: int, most: int):
        self.most = most
        self.slot, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.last = np.full(slots, LEAST, np.int64)  # what a score must reach to come in

    def add(self, slot: np.ndarray, score: np.ndarray, id: np.ndarray) -> None:
        slot, score, id = np.r_[self.slot, slot], np.r_[self.score, score.astype(np.int64)], np.r_[self.id, id]
        order = np.lexsort((id, ~score, slot))  # ~x falls as x rises and can't overflow
        slot, score, id = slot[order], score[order], id[order]
        at = np.arange(len(slot))
        rank = at - np.maximum.accumulate(np.where(np.r_[True, slot[1:] != slot[:-1]], at, 0)) if len(slot) else at
        keep = rank < self.most
        self.slot, self.score, self.id = slot[keep], score[keep], id[keep]
        full = rank[keep] == self.most - 1
        self.last[self.slot[full]] = self.score[full]


def _pieces(batches: Iterator[pa.RecordBatch], block: Block, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, whether labels are equal, scores) of pieces of the rows with the block."""
    step = max(1, PIECE // len(block.ids))
    for batch in batches:
        for ids, labels, v in matrices(batch, scale):
            if v.shape[1] == block.vectors.shape[1]:
                for s in range(0, len(ids), step):
                    yield ids[s : s + step], labels[s : s + step, None] == block.labels, scores(v[s : s + step], block.vectors)


def best_positives(rows: DataFrame, block: Block, most: int, scale: float) -> Block:
    """The block with the positives of its anchors, found over all rows."""
    sent = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        best = Best(len(block.ids), most)
        for ids, same, s in _pieces(batches, block, scale):
            i, a = np.nonzero(same & (s >= best.last) & (ids[:, None] != block.ids))
            best.add(a, s[i, a], ids[i])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (best.slot, best.score, best.id)], ["slot", "score", "other"])

    found = rows.mapInArrow(run, "slot long, score long, other long")
    rank = F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("score"), "other"))
    shape = (len(block.ids), most)
    out = replace(block, positive=np.zeros(shape, np.int64), positive_score=np.zeros(shape, np.int64), has=np.zeros(shape, bool))
    for r in found.withColumn("rank", rank).where(F.col("rank") <= most).collect():  # ``most`` an anchor of the block
        out.positive[r.slot, r["rank"] - 1], out.positive_score[r.slot, r["rank"] - 1], out.has[r.slot, r["rank"] - 1] = r.other, r.score, True
    sent.unpersist()
    return out


def best_negatives(rows: DataFrame, block: Block, most: int, low: int, scale: float) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of a block, found over all rows."""
    sent = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        width = block.has.shape[1]
        best = [Best(len(block.ids), most) for _ in range(width)]
        for ids, same, s in _pieces(batches, block, scale):
            p = block.positive_score.astype(s.dtype)
            apart = ~same
            for k in range(width):
                i, a = np.nonzero(apart & block.has[:, k] & (s >= best[k].last) & (s <= p[:, k]) & (low * p[:, k] <= 100 * s))
                best[k].add(a, s[i, a], ids[i])
        for k, b in enumerate(best):
            columns = [b.slot * width + k, block.ids[b.slot], block.positive[b.slot, k], b.id, block.positive_score[b.slot, k], b.score]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["slot", "anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    found = rows.mapInArrow(run, "slot long, anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= most).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, scale: float = 256) -> DataFrame:
    """Hard negatives of ``anchors`` among ``rows``, both as usable() gives them. Blocks are worked through one by one; each
    reads all rows twice."""
    blocks, keys = pack(anchors, scale)
    if not keys:
        return best_negatives(rows.where("false"), Block(np.zeros(1, int), np.zeros(1, int), np.zeros((1, 0)), *(np.zeros((1, 1), t) for t in (int, int, bool))), negatives, low, scale)
    out = None
    for key in keys:
        found = best_negatives(rows, best_positives(rows, load(blocks, key), positives, scale), negatives, low, scale)
        found = written(found) if len(keys) > 1 else found
        out = found if out is None else out.unionByName(found)
    return out


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    rows = usable(vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))
    return mine(rows, rows.where("id % 100 = 0"))


OP12_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT * FROM (
  SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other)::INT AS rank, n.other AS negative_id, p.positive_score, n.score AS negative_score
  FROM positives p JOIN pairs n ON p.anchor_id = n.anchor_id AND NOT n.same AND 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score
) WHERE rank <= 5
"""
