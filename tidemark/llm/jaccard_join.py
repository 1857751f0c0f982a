"""Exact n-gram Jaccard join by signature trees.

1. Each document's set of shingle hashes; documents with equal sets are one node.
2. Blocks. With similarity at least s, sets that link differ in at most d tokens, d = floor((1-s)/(1+s) (|A|+|B|)). Hash
   space is cut into P > d parts, so that a linking pair has at least P - d parts with equal content. Sizes fall into
   intervals, each with a P of its own for pairs whose smaller set lies in it; a set gives the parts of its interval and,
   where a smaller partner can lie in the one below, of that too. P follows from the interval, but what a set needs from
   the d of its own size: a set that links has at least P - d parts in common with other sets of the interval. Sets with
   fewer go, and those that then have fewer, before any tokens are moved. A passage that many documents share makes few
   whole parts common, so it doesn't connect them. Parts without tokens are left out (a set needs fewer by their number)
   unless a set has P - d or more of them, as a few of the smallest have. Sets of an interval that still share a part are
   candidates; they are connected by edges to one leader of each part and cut into components, so each node with its
   tokens goes to one place for each of its intervals, two at most. Of its parts, a set drops those with the rarest of its
   leaders, fewer than half of what it needs: that cuts groups of near copies from each other where a passage joins them.
3. Signature trees. In each component the nodes, in order of size and content, are leaves of a tree whose nodes hold the
   OR of the token bitmaps below and their range of sizes. Two trees (or one with itself) are walked together; a pair of
   nodes goes when the common bits of the two can't make the overlap that their smallest sizes ask for. Components
   over ``BLOCK_TOKENS`` are cut into blocks: pairs with the first block come first, others only where sets are apart.
4. Links are joined to components of documents.

No link is lost: all steps before the bitmaps keep every pair that can link, and bitmaps are exact, as a bit is one
token of the task. Cases: null or empty texts and texts without words have no set and link with nothing; a text of
fewer words than a shingle is one shingle; repeated rows are one node and give a row each; a null id links as any
other but is never the smallest of a component; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import checkpoint, sliced, table, written
from tidemark.llm.shingles import mix, shingle_hashes
from tidemark.operators.maps import connected

#: Tokens of a block of a component: two blocks are what a task holds.
BLOCK_TOKENS = 150_000
#: Parts for each token in which linking sets may differ: more parts leave fewer candidates and cost more rows.
PARTS = 1.25
#: Candidate documents that are picked by a broadcast of their hashes; more are picked by a join, as the driver holds
#: them while it makes the broadcast.
BROADCAST_IDS = 500_000
LEAF, FANOUT = 8, 8


class Parts:
    """The parts by which sets of similarity ``percent`` in 100 or more meet."""

    def __init__(self, percent: int):
        self.percent = percent
        self.bounds = [1]
        self._grow(16)

    def _grow(self, n: int) -> None:
        while self.bounds[-1] <= n:
            self.bounds.append(max(self.bounds[-1] + 1, int(self.bounds[-1] * 1.8)))

    def apart(self, k: int) -> int:
        """Most tokens in which a linking pair can differ whose smaller set lies in interval k."""
        small = self.bounds[k + 1] - 1
        large = small * 100 // self.percent
        return (100 - self.percent) * (small + large) // (100 + self.percent)

    def differ(self, k: int, n: int) -> int:
        """Most tokens in which a set of ``n`` can differ from one that it links with, whose smaller lies in interval k."""
        small = self.bounds[k + 1] - 1  # of the other, where n is past the interval
        other = n * 100 // self.percent if n <= small else small
        return (100 - self.percent) * (n + other) // (100 + self.percent)

    def signatures(self, tokens: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(interval, parts that must be common, signatures) of a sorted set of hashes, for each interval that it is in."""
        n = len(tokens)
        if not n:
            return
        self._grow(2 * n)
        k = int(np.searchsorted(self.bounds, n, side="right")) - 1
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens), dtype=np.uint64)])
        yield from self._of(tokens, total, k)
        while k and n * self.percent <= 100 * (self.bounds[k] - 1):
            k -= 1
            yield from self._of(tokens, total, k)

    def _of(self, tokens: np.ndarray, total: np.ndarray, k: int) -> Iterator[tuple[int, int, np.ndarray]]:
        d = self.differ(k, len(tokens))
        if not d:  # only equal sets, which are one node
            return
        p = int(PARTS * self.apart(k)) + 3
        step = (1 << 64) // p
        edges = np.searchsorted(tokens, np.arange(1, p, dtype=np.uint64) * np.uint64(step))
        edges = np.concatenate([[0], edges, [len(tokens)]])
        full = np.flatnonzero(np.diff(edges))
        sums = total[edges[full + 1]] - total[edges[full]]
        out = mix(mix(sums + full.astype(np.uint64)) + np.uint64(k * 1_000_003 + 1))
        need = len(full) - d  # of p - d, those that can't be parts without tokens
        if need <= 0:
            out = np.append(out, mix(np.array([k], np.uint64)))
        yield k, need, out


def node_of(tokens: np.ndarray) -> int | None:
    return int.from_bytes(blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True) if len(tokens) else None


def _row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(id_col, text_col)


def nodes(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, n, node, row): node is a hash of the whole set, null for an empty one; row is a hash of id and text."""
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("node", T.LongType()), T.StructField("row", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [shingle_hashes(text, size) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([node_of(x) for x in sets], pa.int64()), batch.column(2)], schema.names)

    return df.select(id_col, text_col, _row_key(id_col, text_col)).mapInArrow(run, schema)


def parts(df: DataFrame, text_col: str, size: int, percent: int) -> DataFrame:
    """(node, k, need, s): a row for each part of each node in interval k. A task gives a node once, so a large group of
    copies is a few rows for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, seen = Parts(percent), {None}
        for batch in sliced(batches):
            names, ks, needs, signs = [], [], [], []
            for text in batch.column(0).to_pylist():
                tokens = shingle_hashes(text, size)
                node = node_of(tokens)
                if node in seen:
                    continue
                seen.add(node)
                for k, need, s in cut.signatures(tokens):
                    names.append(node), ks.append(k), needs.append(need), signs.append(s.view(np.int64))
            if signs:
                n = [len(x) for x in signs]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(names, np.int64), n)), pa.array(np.repeat(np.array(ks, np.int32), n)), pa.array(np.repeat(np.array(needs, np.int32), n)), pa.array(np.concatenate(signs))], ["node", "k", "need", "s"])

    return df.select(text_col).mapInArrow(run, "node long, k int, need int, s long")


def _shared(rows: DataFrame) -> DataFrame:
    """The rows whose part another node has too, with the part's least node as ``leader``."""
    part = Window.partitionBy("s")
    return rows.withColumn("leader", F.min("node").over(part)).withColumn("_last", F.max("node").over(part)).where("leader != _last").drop("_last")


def candidates(rows: DataFrame) -> DataFrame:
    """(node, label) of the nodes that have enough parts in common with others, by candidate component. A node is in a
    component for each of its intervals."""
    rows = written(_shared(rows).select("node", "k", "need", "s").distinct())
    own = Window.partitionBy("node", "k")  # a set's parts
    enough = lambda r: r.withColumn("n", F.count(F.lit(1)).over(own)).where("n >= need")
    rows = written(_shared(enough(rows)).select("node", "k", "need", "s"))
    rows = _shared(enough(rows)).groupBy("node", "k", "need", "leader").agg(F.count(F.lit(1)).alias("n"))
    # two sets that link drop fewer parts together than they have in common: one is left that both keep
    fewest = own.orderBy("n", "leader").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = written(rows.withColumn("n", F.sum("n").over(fewest)).where("2 * n > need - 1").select("node", "k", "leader"))
    edges = rows.select(F.xxhash64("leader", "k").alias("a"), F.xxhash64("node", "k").alias("b")).where("a != b")
    labels = connected(edges).select(F.col("node").alias("_vertex"), "label")
    return rows.select("node", F.xxhash64("node", "k").alias("vertex")).distinct().join(labels, F.col("vertex") == F.col("_vertex")).select("node", "label")


class Tree:
    """Signature tree over sets, as levels from the leaves up: OR of bitmaps, least and largest size, first and last set."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray):
        self.bits, self.sizes = bits, sizes
        first = np.arange(0, len(sizes), LEAF)
        level = (np.bitwise_or.reduceat(bits, first, axis=0), np.minimum.reduceat(sizes, first), np.maximum.reduceat(sizes, first))
        self.levels = [level]
        while len(level[1]) > 1:
            first = np.arange(0, len(level[1]), FANOUT)
            level = (np.bitwise_or.reduceat(level[0], first, axis=0), np.minimum.reduceat(level[1], first), np.maximum.reduceat(level[2], first))
            self.levels.append(level)


def overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a & b).sum(axis=-1, dtype=np.int64)


def walk(x: Tree, y: Tree, percent: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linking sets (of x, of y) by dual traversal. All pairs of a level that can still hold a link go on to the next."""
    depth = max(len(x.levels), len(y.levels))
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    most = max(64, (1 << 21) // x.bits.shape[1])  # pairs of bitmaps held at once
    for level in range(depth - 1, -1, -1):
        lx, ly = min(level, len(x.levels) - 1), min(level, len(y.levels) - 1)
        (bx, low_x, high_x), (by, low_y, high_y) = x.levels[lx], y.levels[ly]
        keep = []
        for start in range(0, len(a), most):
            i, j = a[start : start + most], b[start : start + most]
            ok = (100 * high_x[i] >= percent * low_y[j]) & (100 * high_y[j] >= percent * low_x[i])
            i, j = i[ok], j[ok]
            # 100 o >= percent (|A| + |B| - o), with sizes as small and the overlap as large as they can be
            ok = (100 + percent) * overlap(bx[i], by[j]) >= percent * (low_x[i] + low_y[j])
            keep.append((i[ok], j[ok]))
        if not keep:
            return
        a, b = np.concatenate([k[0] for k in keep]), np.concatenate([k[1] for k in keep])
        if level:
            a, b = _below(a, b, level, x, y)
            if same:
                a, b = a[a <= b], b[a <= b]
    one = np.arange(LEAF)
    most = max(1, most // LEAF // LEAF)
    for start in range(0, len(a), most):
        i = (a[start : start + most, None, None] * LEAF + one[None, :, None] + 0 * one[None, None, :]).ravel()
        j = (b[start : start + most, None, None] * LEAF + one[None, None, :] + 0 * one[None, :, None]).ravel()
        ok = (i < len(x.sizes)) & (j < len(y.sizes)) & ((i < j) if same else True)
        i, j = i[ok], j[ok]
        o = overlap(x.bits[i], y.bits[j])
        ok = 100 * o >= percent * (x.sizes[i] + y.sizes[j] - o)
        yield i[ok], j[ok]


def _below(a: np.ndarray, b: np.ndarray, level: int, x: Tree, y: Tree) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of children; a tree that has no such level stays at its root."""
    go_x, go_y = level < len(x.levels), level < len(y.levels)
    dx, dy = np.arange(FANOUT if go_x else 1), np.arange(FANOUT if go_y else 1)
    i = (a[:, None, None] * (FANOUT if go_x else 1) + dx[None, :, None] + 0 * dy[None, None, :]).ravel()
    j = (b[:, None, None] * (FANOUT if go_y else 1) + dy[None, None, :] + 0 * dx[None, :, None]).ravel()
    ok = (i < len(x.levels[min(level - 1, len(x.levels) - 1)][1])) & (j < len(y.levels[min(level - 1, len(y.levels) - 1)][1]))
    return i[ok], j[ok]


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """One bit for each token that more than one set has; others can't be common."""
    flat = np.concatenate(sets)
    tokens, at, n = np.unique(flat, return_inverse=True, return_counts=True)
    place = np.cumsum(n > 1) - 1
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    ok = n[at] > 1
    width = max(1, -(-int((n > 1).sum()) // 64))
    bits = np.zeros((len(sets), width), np.uint64)
    col = place[at[ok]]
    np.bitwise_or.at(bits, (row[ok], col >> 6), np.uint64(1) << (col & 63).astype(np.uint64))
    return bits


def links(sets: list[np.ndarray], names: np.ndarray, blocks: np.ndarray, percent: int, known: np.ndarray | None = None) -> tuple[list[int], list[int]]:
    """Links between the sets of one task that join its components: all pairs are judged, those already joined aren't
    told. ``known``: a component for each set that is had before."""
    bits, sizes = bitmaps(sets), np.array([len(s) for s in sets], np.int64)
    root = list(range(len(sets))) if known is None else np.unique(known, return_index=True)[1][np.unique(known, return_inverse=True)[1]].tolist()

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    groups = [g for g in (np.flatnonzero(blocks == b) for b in np.unique(blocks)) if len(g)]
    # near sets come to lie together: by size, and then by their first tokens
    groups = [g[np.lexsort((np.array([int(sets[i][0] >> np.uint64(1)) for i in g]), sizes[g]))] for g in groups]
    trees = [Tree(bits[g], sizes[g]) for g in groups]
    out_a, out_b = [], []
    pairs = [(0, 0)] if len(trees) == 1 else [(0, 1)]
    for p, q in pairs:
        for i, j in walk(trees[p], trees[q], percent, p == q):
            for s, t in zip(groups[p][i].tolist(), groups[q][j].tolist()):
                if (u := find(s)) != (v := find(t)):
                    root[u] = v
                    out_a.append(int(names[s]))
                    out_b.append(int(names[t]))
    return out_a, out_b


def _tasks(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): links in each pair (i, j) of blocks of a candidate component, for (node, label, block, known, tokens, i, j)."""

    def task(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        names, blocks = group.column("node").to_numpy(), group.column("block").to_numpy()
        _, once = np.unique(names, return_index=True)
        lists = group.column("tokens")
        names, blocks, known = names[once], blocks[once], group.column("known").to_numpy()[once]
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        a, b = [], []
        if len(once) > 1 and (i == j or len(np.unique(blocks)) > 1) and len(np.unique(known)) > 1:
            sets = [np.asarray(lists[int(k)].values.to_numpy(), np.int64).view(np.uint64) for k in once]
            a, b = links(sets, names, blocks, percent, known)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("label", "i", "j").applyInArrow(task, "a long, b long")


def linked(df: DataFrame, found: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """(a, b): links between nodes that span the components of all links.

    A component of more than BLOCK_TOKENS is cut into blocks. First each block is compared with itself and with the first
    block. In a group of near copies this joins all there is to join; only candidate components that are still apart go
    on to all other pairs of blocks, in which pairs that are joined already need no link."""
    near = checkpoint(candidates(parts(df, text_col, size, percent)))
    first = found.where("node is not null").groupBy("node").agg(F.min("row").alias("row"), F.first("n").alias("n"))
    picked = checkpoint(near.join(first, "node"))
    sums = picked.groupBy("label").agg((F.floor(F.sum("n") / BLOCK_TOKENS) + 1).cast("int").alias("blocks"))
    picked = checkpoint(picked.join(sums, "label"))
    docs = df.select(_row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text"))

    def of(some: DataFrame) -> DataFrame:
        """(node, label, blocks, block, tokens) of picked nodes."""
        rows = some.select(F.col("row").alias("_row"), "node", "label", "blocks")
        rows = docs.join(rows.hint("broadcast") if some.count() <= BROADCAST_IDS else rows, F.col("row") == F.col("_row")).select("node", "label", "blocks", "text")
        block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        return rows.mapInArrow(tokens, "node long, label long, blocks int, tokens array<long>").withColumn("block", block)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # rows that repeat are one
        for batch in sliced(batches):
            pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            new = [k for k, x in enumerate(pairs) if x not in seen and not seen.add(x)]
            if not new:
                continue
            kept = batch.take(pa.array(new, pa.int64()))
            sets = [shingle_hashes(x, size).view(np.int64) for x in kept.column(3).to_pylist()]
            ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), kept.column(2), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], ["node", "label", "blocks", "tokens"])

    whole = of(picked.where("blocks = 1"))
    whole = _tasks(whole.select("node", "label", "block", F.col("node").alias("known"), "tokens", F.lit(0).alias("i"), F.lit(0).alias("j")), percent)
    large = picked.where("blocks > 1")
    if large.isEmpty():
        return whole
    whole, rows = checkpoint(whole), written(of(large))
    to_first = F.when(F.col("block") > 0, F.array(F.lit(0), F.col("block"))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    star = rows.withColumn("other", F.explode(to_first))
    star = checkpoint(_tasks(star.select("node", "label", "block", F.col("node").alias("known"), "tokens", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")), percent))
    joined = connected(star).select(F.col("node").alias("_node"), F.col("label").alias("known"))
    apart = picked.where("blocks > 2").join(joined, F.col("node") == F.col("_node"), "left").select("node", F.col("label").alias("_label"), F.coalesce("known", "node").alias("known"))
    some = apart.groupBy("_label").agg(F.min("known").alias("x"), F.max("known").alias("y")).where("x != y").select("_label")
    apart = checkpoint(apart.join(some, "_label").select(F.col("node").alias("_node"), "_label", "known"))
    if apart.isEmpty():
        return whole.unionByName(star)
    rest = rows.join(apart, (F.col("node") == F.col("_node")) & (F.col("label") == F.col("_label"))).where("block > 0")
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(1), F.col("blocks") - 1))).where("other != block")
    return whole.unionByName(star).unionByName(_tasks(rest.select("node", "label", "block", "known", "tokens", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")), percent))


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id) of each row: documents are connected by links of ``percent`` in 100 or more."""
    found = checkpoint(nodes(df, id_col, text_col, size))
    labels = connected(checkpoint(linked(df, found, id_col, text_col, size, percent)))
    first = found.where("node is not null").groupBy("node").agg(F.min("id").alias("least"))
    first = first.join(labels, "node", "left").select(F.col("node").alias("_node"), F.coalesce("label", "node").alias("label"), "least")
    least = first.groupBy(F.col("label").alias("_label")).agg(F.min("least").alias("component_id"))
    of = checkpoint(first.join(least, F.col("label") == F.col("_label")).select("_node", "component_id"))
    out = found.select("id", "n", "node").join(of, F.col("node") == F.col("_node"), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), size=3, percent=90)


#: The same rows, by all pairs that share a shingle and the closure of their links.
OP3_SQL = r"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT row, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0), s AS (SELECT DISTINCT row, array_to_string(w[i:i + 2], ' ') AS s FROM i), n AS (SELECT row, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.row AS a, b.row AS b, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.row <> b.row GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.row = a JOIN n y ON y.row = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
r AS (SELECT row, row AS x FROM d UNION SELECT r.row, e.b FROM r JOIN e ON r.x = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(o.doc_id) AS component_id FROM d JOIN r ON r.row = d.row JOIN d o ON o.row = r.x LEFT JOIN n ON n.row = d.row GROUP BY d.row, d.doc_id, n.n"""
