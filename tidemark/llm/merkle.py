"""Merkle manifest of a dataset: a tree of threes over the rows of each source, one over the sources, and for each row the
authentication path that leads from its leaf to the root.

Rows are dealt by ranges of (source, id) and numbered within them; offsets of ranges make the numbers those of the source,
so that no source, however large, is sorted by one task. Each BLOCK = 3^6 consecutive nodes are an aligned block; a task
folds a block into its root, and the roots of a source's blocks are nodes again, until each source has one; sources are
then nodes in the same way. Proofs are made downwards: a block meets the proof of its own root and traverses its nodes in
order by fractal traversal. It keeps, for each band of BAND levels, the existing subtree that holds the path of the node
at hand, and the desired one to its right, which grows by one node a step and takes over when the path moves on; what it
holds is a few subtrees and a stack. Each path goes out with the block's upper proof appended, or, at the leaves, is
hashed and folded at once, so that paths of leaves are neither shuffled nor written.

Digests are lower-case hex; H is sha256 over the concatenation of its inputs, digests as hex text. A run is three
consecutive nodes, the last of a level fewer; a run of one is hashed as well, a tree of one leaf isn't.

Cases: a null field is ``-``, also a null id, and the null source, as any other, has a tree, the first; rows that share a
source and an id stand by their leaves; equal rows have leaves and proofs each; a null id isn't tampered with; an empty
table gives no rows; other columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import table, written

#: Nodes in a run, levels in a block, levels of the subtrees that a traversal keeps.
ARITY, LEVELS, BAND = 3, 6, 2
BLOCK = ARITY**LEVELS
#: Rows of a table that is broadcast at most, some 40 bytes each.
BROADCAST_ROWS = 500_000


def digest(parts: list[bytes]) -> bytes:
    """H of digests in hex."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def height(nodes: int) -> int:
    """Levels of a tree over so many nodes."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // ARITY), levels + 1
    return levels


class Subtree:
    """The nodes of levels ``low`` to below ``high`` under a part of a level-0 sequence that starts at ``start``. It is
    fed with nodes of level 0 in order; a run that is full, or the last at the end, becomes the node above it."""

    def __init__(self, start: int, low: int, high: int):
        self.low, self.high = low, high
        self.nodes: dict[tuple[int, int], bytes] = {}
        self.at = [start // ARITY**level for level in range(high + 1)]
        self.run: list[list[bytes]] = [[] for _ in range(high + 1)]

    def feed(self, node: bytes, level: int = 0) -> None:
        while True:
            if self.low <= level < self.high:
                self.nodes[level, self.at[level]] = node
            self.at[level] += 1
            self.run[level].append(node)
            if level == self.high or len(self.run[level]) < ARITY:
                return
            node, self.run[level] = digest(self.run[level]), []
            level += 1

    def end(self) -> bytes | None:
        """Closes the runs that are open; the root, if there is one."""
        for level in range(self.high):
            if self.run[level]:
                node, self.run[level] = digest(self.run[level]), []
                self.feed(node, level + 1)
        return self.run[self.high][0] if self.run[self.high] else None


def fold(nodes: list[bytes], levels: int) -> bytes:
    """The root of a block, or of a whole tree of that height."""
    tree = Subtree(0, levels, levels)
    for x in nodes:
        tree.feed(x)
    return tree.end()


def traverse(nodes: list[bytes], levels: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """The authentication path of each node in order: for each level the place in the run and the run's others."""
    bands = [(low, min(levels, low + BAND)) for low in range(0, levels, BAND)]
    existing, desired = [], []
    for low, high in bands:
        first, width = Subtree(0, low, high), ARITY**high
        for x in nodes[:width]:
            first.feed(x)
        first.end()
        existing.append(first.nodes)
        desired.append(Subtree(width, low, high))
    for j in range(len(nodes)):
        path = []
        for (low, high), known in zip(bands, existing):
            for level in range(low, high):
                at = j // ARITY**level
                run = at - at % ARITY
                path.append((at % ARITY, [known[level, i] for i in range(run, run + ARITY) if i != at and (level, i) in known]))
        yield path
        for k, (low, high) in enumerate(bands):
            width = ARITY**high
            ahead = j + width
            if ahead < len(nodes):
                desired[k].feed(nodes[ahead])
            if (j + 1) % width == 0:
                desired[k].end()
                existing[k], desired[k] = desired[k].nodes, Subtree(j + 1 + width, low, high)


def packed(path: list[tuple[int, list[bytes]]]) -> bytes:
    """A path as bytes: for each level a byte for place and number of others, then their digests."""
    return b"".join(bytes([at * ARITY + len(others)]) + bytes.fromhex(b"".join(others).decode()) for at, others in path)


def unpacked(path: bytes) -> Iterator[tuple[int, list[bytes]]]:
    i = 0
    while i < len(path):
        at, n = divmod(path[i], ARITY)
        yield at, [path[i + 1 + 32 * k : i + 33 + 32 * k].hex().encode() for k in range(n)]
        i += 1 + 32 * n


def climb(node: bytes, path: Iterator[tuple[int, list[bytes]]]) -> bytes:
    """The root to which a node and its path lead."""
    for at, others in path:
        node = digest([*others[:at], node, *others[at:]])
    return node


def leaf_digest(*fields: Column) -> Column:
    """H of fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows, written, with ``pos`` from 0 by ``order`` within each group (gn, gs) and the group's ``total``."""
    schema = rows.schema.simpleString()[7:-1].replace(":", " ") + ", part int, place long"

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            gs, gn = batch.column("gs"), batch.column("gn")
            new = pc.or_(pc.not_equal(gs[1:], gs[:-1]), pc.not_equal(gn[1:], gn[:-1])).to_numpy(zero_copy_only=False)
            first = (gn[0].as_py(), gs[0].as_py())
            n, out = n if first == last else 0, []
            starts = [0, *(new.nonzero()[0] + 1).tolist(), batch.num_rows]
            for a, b in zip(starts, starts[1:]):
                n = 0 if a else n
                out.extend(range(n, n + b - a))
                n += b - a
            last = (gn[-1].as_py(), gs[-1].as_py())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(out, pa.int64())], [*batch.schema.names, "part", "place"])

    by = ["gn", "gs", *order]
    placed = written(rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(places, schema))
    group = Window.partitionBy("gn", "gs")
    counts = placed.groupBy("gn", "gs", "part").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("gn", "gs", "part", (F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("offset"), F.sum("n").over(group).alias("total"))
    offsets = written(offsets)
    offsets = offsets.hint("broadcast") if offsets.count() <= BROADCAST_ROWS else offsets
    return placed.join(offsets, ["gn", "gs", "part"]).withColumn("pos", F.col("place") + F.col("offset")).drop("part", "place", "offset")


def _levels(total: int) -> int:
    """Levels to fold in a block: all of a whole tree, else those of a block."""
    return height(total) if total <= BLOCK else LEVELS


def _sorted(t: pa.Table) -> tuple[pa.Table, list[bytes]]:
    t = t.sort_by("pos")
    return t, [x.hex().encode() for x in t.column("node").to_pylist()]




def _block() -> Column:
    return F.expr(f"pos div {BLOCK}")


def parents(nodes: DataFrame) -> DataFrame:
    """The roots of blocks, as nodes of their groups: (gn, gs, pos, total, node)."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        total = t.column("total")[0].as_py()
        root = fold(_sorted(t)[1], _levels(total))
        return pa.table({"gn": [key[0].as_py()], "gs": [key[1].as_py()], "pos": [key[2].as_py()], "total": [-(-total // BLOCK)], "node": [bytes.fromhex(root.decode())]}, pa.schema([("gn", pa.bool_()), ("gs", pa.string()), ("pos", pa.int64()), ("total", pa.int64()), ("node", pa.binary())]))

    return written(nodes.select("gn", "gs", "pos", "total", "node", _block().alias("block")).groupBy("gn", "gs", "block").applyInArrow(run, "gn boolean, gs string, pos long, total long, node binary"))


def rounds(nodes: DataFrame) -> list[DataFrame]:
    """The nodes, the roots of their blocks and so on, until each group has one node: its root."""
    out = [nodes]
    most = nodes.agg(F.max("total")).first()[0] or 0
    while most > 1 or len(out) == 1:
        out.append(parents(out[-1]))
        most = -(-most // BLOCK)
    return out


def proofs(nodes: DataFrame, upper: DataFrame, emit: Callable[[pa.Table, list[bytes], Iterator[bytes], dict], dict], schema: str, keep: list[str]) -> DataFrame:
    """Blocks of nodes meet the proofs of their roots (``upper``: gn, gs, pos, path, subroot, root). ``emit`` makes columns
    from a block in order, its nodes, their packed paths up to the root of all, and the proof's row."""

    def run(key: tuple, t: pa.Table, above: pa.Table) -> pa.Table:
        t, digests = _sorted(t)
        up = above.to_pylist()[0]
        paths = (packed(p) + up["path"] for p in traverse(digests, _levels(t.column("total")[0].as_py())))
        return pa.table(emit(t, digests, paths, up))

    left = nodes.select("gn", "gs", "pos", "total", "node", *keep, _block().alias("block")).groupBy("gn", "gs", "block")
    right = upper.withColumnRenamed("pos", "block").groupBy("gn", "gs", "block")
    return left.cogroup(right).applyInArrow(run, schema)


UPPER = "gn boolean, gs string, pos long, path binary, subroot binary, root binary"


def _as_upper(t: pa.Table, digests: list[bytes], paths: Iterator[bytes], up: dict) -> dict:
    n = len(digests)
    return {"gn": t.column("gn"), "gs": t.column("gs"), "pos": t.column("pos"), "path": pa.array(list(paths), pa.binary()), "subroot": pa.array([up["subroot"]] * n, pa.binary()), "root": pa.array([up["root"]] * n, pa.binary())}


def _as_sources(t: pa.Table, digests: list[bytes], paths: Iterator[bytes], up: dict) -> dict:
    n = len(digests)
    return {"gn": t.column("tn"), "gs": t.column("ts"), "pos": pa.array([0] * n, pa.int64()), "path": pa.array(list(paths), pa.binary()), "subroot": t.column("node"), "root": pa.array([up["root"]] * n, pa.binary())}


def _as_leaves(t: pa.Table, digests: list[bytes], paths: Iterator[bytes], up: dict) -> dict:
    proof, folded = [], []
    for mine, other, path in zip(digests, t.column("other").to_pylist(), paths):
        steps = list(unpacked(path))
        proof.append(digest([x for _, others in steps for x in others]).decode())
        folded.append(climb(other.hex().encode() if other else mine, iter(steps)).decode())
    n = len(digests)
    text = lambda x: pa.array([x] * n, pa.string())
    return {"id": t.column("id"), "leaf": pa.array([x.decode() for x in digests], pa.string()), "subroot": text(up["subroot"].hex()), "root": text(up["root"].hex()), "proof_sha256": pa.array(proof, pa.string()), "folded_root": pa.array(folded, pa.string())}


def manifest(leaves: DataFrame) -> DataFrame:
    """``leaves`` has group (string), id (long), leaf and other (hex; what the leaf is to be verified as, null: itself). A
    row each: (id, leaf, subroot, root, proof_sha256, folded_root)."""
    rows = written(leaves.select(F.col("group").isNull().alias("gn"), F.coalesce("group", F.lit("")).alias("gs"), "id", F.unhex("leaf").alias("node"), F.unhex("other").alias("other")))
    trees = rounds(numbered(rows, ["id", "node"]))
    # sources: null before all others, then by bytes
    tops = trees[-1].select(F.lit(False).alias("gn"), F.lit("").alias("gs"), F.col("gn").alias("tn"), F.col("gs").alias("ts"), "node", (~F.col("gn")).alias("known"))
    above = rounds(numbered(tops, ["known", "ts"]))
    empty = F.lit(b"").cast("binary")
    upper = above[-1].select("gn", "gs", "pos", empty.alias("path"), F.col("node").alias("subroot"), F.col("node").alias("root"))
    for nodes in above[-2:0:-1]:
        upper = proofs(nodes, upper, _as_upper, UPPER, [])
    upper = proofs(above[0], upper, _as_sources, UPPER, ["tn", "ts"])
    for nodes in trees[-2:0:-1]:
        upper = proofs(nodes, upper, _as_upper, UPPER, [])
    return proofs(trees[0], upper, _as_leaves, "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string", ["id", "other"])


def document_leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Leaves of documents. Where ``tampered``, ``other`` is the leaf of a text without its line ends."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    other = F.lit(None).cast("string")
    if tampered is not None:
        other = F.when(tampered & (F.instr("text", "\n") > 0), leaf_digest(*fields, F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    return docs.select(F.col("source").alias("group"), F.col("doc_id").cast("long").alias("id"), leaf_digest(*fields, F.col("text")).alias("leaf"), other.alias("other"))


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = manifest(document_leaves(docs, F.crc32(F.col("doc_id").cast("string")) % 2 == 0))
    return out.withColumnRenamed("id", "doc_id").withColumn("verified", F.col("folded_root") == F.col("root"))


#: A level is made from the one below it, and each leaf climbs by the runs that it meets.
OP13_SQL = r"""
WITH RECURSIVE leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM (
    SELECT doc_id, source, sha256(head || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS leaf,
      CASE WHEN text IS NOT NULL AND bits = 0 THEN sha256(head || strlen(short)::VARCHAR || ':' || short) ELSE sha256(head || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) END AS other
    FROM (SELECT *, replace(text, chr(10), '') AS short, coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source)::VARCHAR || ':' || source, '-')
        || coalesce(strlen(lang)::VARCHAR || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-') AS head,
        1 - (list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
          lambda a, c: list_reduce(list_prepend(xor(a, c), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: xor(v >> 1, 3988292384 * (v & 1) + z))) & 1) AS bits
      FROM documents))
), trees AS (
  SELECT 0 AS level, source, place, leaf AS node, count(*) OVER (PARTITION BY source) AS n FROM leaves
  UNION ALL
  SELECT level + 1, source, place // 3, sha256(string_agg(node, '' ORDER BY place)), (max(n) + 2) // 3 FROM trees WHERE n > 1 GROUP BY level, source, place // 3
), tops AS (
  SELECT 0 AS level, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, node, count(*) OVER () AS n FROM trees WHERE n = 1
  UNION ALL
  SELECT level + 1, place // 3, sha256(string_agg(node, '' ORDER BY place)), (max(n) + 2) // 3 FROM tops WHERE n > 1 GROUP BY level, place // 3
), sources AS (
  SELECT source, node AS subroot, level AS levels, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS top FROM trees WHERE n = 1
), ids AS (
  SELECT l.*, s.subroot, s.levels, s.top, row_number() OVER () AS k FROM leaves l JOIN sources s ON l.source IS NOT DISTINCT FROM s.source
), met AS (
  SELECT k, t.level AS step, t.place, t.node, i.place // (3 ** t.level)::BIGINT AS own FROM ids i JOIN trees t ON i.source IS NOT DISTINCT FROM t.source AND t.n > 1 AND t.place // 3 = i.place // (3 ** (t.level + 1))::BIGINT
  UNION ALL
  SELECT k, i.levels + t.level, t.place, t.node, i.top // (3 ** t.level)::BIGINT FROM ids i JOIN tops t ON t.n > 1 AND t.place // 3 = i.top // (3 ** (t.level + 1))::BIGINT
), steps AS (
  SELECT k, step, coalesce(string_agg(node, '' ORDER BY place) FILTER (place < own), '') AS before, coalesce(string_agg(node, '' ORDER BY place) FILTER (place > own), '') AS after FROM met GROUP BY k, step
), climbs AS (
  SELECT k, 0 AS step, other AS node FROM ids
  UNION ALL
  SELECT c.k, c.step + 1, sha256(s.before || c.node || s.after) FROM climbs c JOIN steps s ON c.k = s.k AND c.step = s.step
), proof AS (
  SELECT k, string_agg(before || after, '' ORDER BY step) AS others FROM steps GROUP BY k
), root AS (SELECT node AS root FROM tops WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(others, '')) AS proof_sha256, c.node AS folded_root, c.node = root AS verified
FROM ids i CROSS JOIN root LEFT JOIN proof p ON i.k = p.k JOIN (SELECT k, arg_max(node, step) AS node FROM climbs GROUP BY k) c ON i.k = c.k
"""
