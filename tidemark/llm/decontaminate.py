"""Benchmark decontamination over a distributed positional inverted index.

Documents are indexed where they lie: each task writes segments of up to ``SEGMENT`` words, and a segment stores, for
each term, the sorted places at which it stands (documents follow one another in a segment with a free place between
them). The index is a table in the shared folder, or wherever the caller writes it. A phrase is looked up in every segment
by taking the places of its rarest term, shifted to the start of the phrase, and intersecting them with the shifted places
of the others, from rare to frequent; with ``slop``, terms may stand apart by that many words. No text is shuffled, and a
hot term or a group of copies only makes lists in its own segment longer.

The phrases come from the benchmark in blocks of bounded size: each block is collected and sent out on its own, and each
is a pass over the index, so neither the driver nor a task holds more than one block, however large the benchmark is.

Cases: a null or empty text has no words, so no hits and no windows; an item of fewer words than the window is one
window; items that repeat, or share windows, are each listed; a null item id can be hit but isn't listed; repeated
rows give a row each; no items: nothing is hit; other columns are not carried.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import hex_sha256, sliced, table, written

WINDOW = 10
#: Places in a segment, about.
SEGMENT = 2_000_000
#: Bytes of benchmark text in a block.
BLOCK_BYTES = 8 << 20

#: Bytes of words stay, in lower case; all others become spaces.
_WORD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))

SPANS = "array<struct<start:int,end:int>>"
#: Numbers are held as bytes, four a number, and terms are joined by spaces: a field of a segment is one value to Spark.
INDEX = "docs {id}, sizes binary, terms binary, starts binary, places binary"


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_WORD).split() if text else []


def windows(text: str | None, size: int = WINDOW) -> list[tuple[bytes, ...]]:
    w = words(text)
    return [tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []


def _segment(ids: list, docs: list[np.ndarray], known: list[bytes]) -> dict:
    sizes = np.array([len(x) for x in docs], np.int32)
    starts = np.cumsum(sizes + 1) - sizes - 1
    terms = np.concatenate(docs) if docs else np.zeros(0, np.int32)
    places = np.arange(len(terms), dtype=np.int32) + np.repeat(np.arange(len(docs), dtype=np.int32), sizes)
    own = terms >= 0
    terms, places = terms[own], places[own]
    order = np.argsort(terms.astype(np.int16) if len(known) < 1 << 15 else terms, kind="stable")
    terms, places = terms[order], places[order]
    first = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else np.zeros(0, np.int64)
    return {"docs": ids, "sizes": sizes, "terms": [known[t] for t in terms[first].tolist()], "starts": np.r_[first, len(terms)].astype(np.int32), "places": places, "at": starts}


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """A row for each segment: the documents' ids and sizes in words, the terms, where each one's places start, and the
    places. Where it is written, each row should be a group of its own (``written_index``)."""
    kind = df.schema[id_col].dataType
    schema = T._parse_datatype_string(INDEX.format(id=f"array<{kind.simpleString()}>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[bytes, int] = {}
        ids, docs, held, id_kind = [], [], 0, None

        def row() -> pa.RecordBatch:
            s = _segment(ids, docs, list(number))
            own = (s["sizes"].tobytes(), b" ".join(s["terms"]), s["starts"].tobytes(), s["places"].tobytes())
            return pa.RecordBatch.from_arrays([pa.array([s["docs"]], pa.list_(id_kind)), *(pa.array([x], pa.binary()) for x in own)], schema.names)

        for batch in sliced(batches):
            id_kind = batch.schema.field(0).type
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = words(text)
                try:
                    got = [number[w] for w in own]
                except KeyError:
                    got = [number.setdefault(w, len(number)) for w in own]
                ids.append(i)
                docs.append(np.array(got, np.int32))
                held += len(got) + 1
                if held >= segment:
                    yield row()
                    ids, docs, held = [], [], 0
                    number.clear()
        if ids:
            yield row()

    return df.select(id_col, text_col).mapInArrow(run, schema)


def written_index(index: DataFrame) -> DataFrame:
    """The index as a table of a row a group, so that neither the task that writes it nor one that reads it holds more than
    a segment. By itself Parquet looks at the size of a group at each hundredth row only, and reads 4096 at once."""
    return written(index, **{"parquet.block.row.count.limit": "1"})


class Segment:
    """One stored segment, ready to be searched."""

    def __init__(self, ids: list, sizes: np.ndarray, terms: list[bytes], starts: np.ndarray, places: np.ndarray):
        self.ids, self.sizes = ids, sizes
        self.begin = np.cumsum(sizes + 1) - sizes - 1
        self.number = dict(zip(terms, range(len(terms))))
        self.starts, self.places = starts, places

    def list_of(self, term: bytes) -> np.ndarray | None:
        k = self.number.get(term)
        return None if k is None else self.places[self.starts[k] : self.starts[k + 1]]

    def phrase(self, terms: tuple[bytes, ...]) -> np.ndarray:
        """Places at which the terms start that stand one after the other."""
        if not all(map(self.number.__contains__, terms)):
            return np.zeros(0, np.int32)
        lists = []
        for k, t in enumerate(terms):
            if (x := self.list_of(t)) is None:
                return np.zeros(0, np.int32)
            lists.append((len(x), k, x))
        lists.sort(key=lambda x: x[:2])
        found = lists[0][2] - lists[0][1]
        for n, k, x in lists[1:]:
            want = found + k
            found = found[x[np.minimum(np.searchsorted(x, want), n - 1)] == want]
            if not len(found):
                break
        return found

    def near(self, terms: tuple[bytes, ...], slop: int) -> tuple[np.ndarray, np.ndarray]:
        """(first, last) places, each pair once, of the terms in this order with at most ``slop`` other words between
        neighbours: all places of a term that follow one of the last term closely enough go on to the next."""
        lists = [self.list_of(t) for t in terms]
        if any(x is None for x in lists):
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        first = last = lists[0]
        for x in lists[1:]:
            low = np.searchsorted(x, last, side="right")
            n = np.searchsorted(x, last.astype(np.int64) + slop + 1, side="right") - low
            at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            first, last, after = np.repeat(first, n), np.repeat(last, n), x[at]
            ok = self.doc_of(after) == self.doc_of(last)
            pairs = np.unique(first[ok].astype(np.int64) << 32 | after[ok])
            first, last = (pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32)
        return first, last

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, places, side="right") - 1


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[Segment]:
    for batch in sliced(batches):
        for r in range(batch.num_rows):
            sizes, terms, starts, places = (batch.column(c)[r].as_buffer() for c in range(1, 5))
            sizes, starts, places = (np.frombuffer(x, np.int32) for x in (sizes, starts, places))
            yield Segment(batch.column(0)[r].values, sizes, terms.to_pybytes().split(b" ") if terms.size else [], starts, places)


def find(index: DataFrame, phrases: list[tuple[bytes, ...]], slop: int = 0, id_col: str = "doc_id") -> DataFrame:
    """(id, phrase number, first word, end word) of every match: exact for slop 0, else in proximity."""
    kind = index.schema["docs"].dataType.elementType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("phrase", T.IntegerType()), T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in segments(batches):
            for n, terms in enumerate(phrases):
                first, last = (x := s.phrase(terms), x + len(terms) - 1) if not slop else s.near(terms, slop)
                if len(first):
                    d = s.doc_of(first)
                    yield pa.RecordBatch.from_arrays([s.ids.take(pa.array(d)), pa.array(np.full(len(d), n, np.int32)), pa.array((first - s.begin[d]).astype(np.int32)), pa.array((last + 1 - s.begin[d]).astype(np.int32))], schema.names)

    return index.mapInArrow(run, schema)


def blocks(items: DataFrame, item_col: str, text_col: str, size: int, block_bytes: int) -> Iterator[dict[tuple[bytes, ...], list[str]]]:
    """Windows and the items that have them, in blocks of about ``block_bytes`` of text."""
    items = items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    for b in range(n):
        out: dict[tuple[bytes, ...], list[str]] = {}
        for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b).toLocalIterator() if n > 1 else items.collect():
            for w in set(windows(r.text, size)):
                out.setdefault(w, []).append(r.item)
        yield out


def by_rarest(block: dict[tuple[bytes, ...], list[str]]) -> dict[bytes, list[tuple[tuple[bytes, ...], list[str]]]]:
    """The windows of a block, with their items, under the term of each that the fewest windows have, of equal ones the
    least. A segment need only look for windows whose term it has, so windows of foreign words cost it nothing."""
    having = Counter(t for terms in block for t in set(terms))
    out: dict[bytes, list] = {}
    for terms, names in block.items():
        out.setdefault(min(terms, key=lambda t: (having[t], t)), []).append((terms, names))
    return out


def _hits(index: DataFrame, block: dict[tuple[bytes, ...], list[str]], slop: int, all_rows: bool) -> DataFrame:
    """(segment, place, id, n_words, spans, items) of the documents of the index, or of those alone that are hit."""
    sent = index.sparkSession.sparkContext.broadcast(by_rarest(block))
    kind = index.schema["docs"].dataType.elementType
    schema = T.StructType([T.StructField("segment", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("id", kind), T.StructField("n_words", T.LongType()), T.StructField("spans", T._parse_datatype_string(SPANS)), T.StructField("items", T.ArrayType(T.StringType()))])
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, number in zip(segments([batch]), batch.column(5).to_pylist()):
                edges = np.zeros(int((s.sizes + 1).sum()) + 1, np.int32)
                of: dict[int, set[str]] = {}
                for terms, names in chain.from_iterable(map(sent.value.__getitem__, sent.value.keys() & s.number.keys())):
                    first, last = (x := s.phrase(terms), x + len(terms) - 1) if not slop else s.near(terms, slop)
                    if len(first):
                        np.add.at(edges, first, 1)
                        np.add.at(edges, last + 1, -1)
                        for d in np.unique(s.doc_of(first)).tolist():
                            of.setdefault(d, set()).update(names)
                edge = np.diff((np.cumsum(edges) > 0).astype(np.int8), prepend=0, append=0)
                first, end = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
                spans: dict[int, list[dict]] = {}
                for d, a, b in zip(s.doc_of(first).tolist(), first.tolist(), end.tolist()):
                    spans.setdefault(d, []).append({"start": a - int(s.begin[d]), "end": b - int(s.begin[d])})
                rows = np.arange(len(s.sizes)) if all_rows else np.array(sorted(spans), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), number, np.int64)), pa.array(rows.astype(np.int32)), s.ids.take(pa.array(rows)), pa.array(s.sizes[rows].astype(np.int64)), pa.array([spans.get(d, []) for d in rows.tolist()], span), pa.array([sorted(x for x in of.get(d, ()) if x is not None) for d in rows.tolist()], pa.list_(pa.string()))], schema.names)

    return index.mapInArrow(run, schema)


def _joined(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for x in sorted(spans, key=lambda x: (x["start"], x["end"])):
        if out and x["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], x["end"])
        else:
            out.append(dict(x))
    return out


def contamination(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = WINDOW, slop: int = 0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_words, spans array<struct<start, end>>, items array<string>) of every document: the runs of words inside
    an occurrence of a window of the items, and the sorted items that have such a window. With ``slop``, the words of a
    window may stand apart by that many other words each."""
    index = written_index(build_index(df, id_col, text_col).withColumn("segment", F.monotonically_increasing_id()))
    passes = [_hits(index, block, slop, not n) for n, block in enumerate(blocks(items, item_col, item_text, size, block_bytes))]
    out = passes[0]
    if len(passes) > 1:
        for other in passes[1:]:
            out = out.unionByName(other)
        out = out.groupBy("segment", "place").agg(F.first("id", ignorenulls=True).alias("id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        span = out.schema["spans"].dataType

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                spans = pa.array(map(_joined, batch.column(2).to_pylist()), batch.schema.field(2).type)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), spans, batch.column(3)], ["id", "n_words", "spans", "items"])

        out = out.select("id", "n_words", "spans", "items").mapInArrow(run, T.StructType([out.schema["id"], out.schema["n_words"], T.StructField("spans", span), out.schema["items"]]))
    return out.select(F.col("id").alias(id_col), "n_words", "spans", "items")


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), hex_sha256(F.array_join("items", ",")).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: The same rows, by joining the words of windows.
OP2_SQL = f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_SQL_WORDS} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS w FROM benchmark),
o AS (SELECT item, w, CAST(least(len(w), {WINDOW}) AS BIGINT) AS n, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0),
k AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM o), z AS (SELECT DISTINCT n FROM k),
p AS (SELECT row, w, z.n, unnest(range(1, len(w) - z.n + 2)) AS i FROM d, z WHERE len(w) >= z.n),
h AS (SELECT row, i, p.n, item FROM p JOIN k ON p.n = k.n AND array_to_string(p.w[i:i + p.n - 1], ' ') = k.k),
c AS (SELECT row, count(DISTINCT j) AS n FROM (SELECT row, unnest(range(i, i + n)) AS j FROM h) GROUP BY 1),
t AS (SELECT row, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM h WHERE item IS NOT NULL) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (row) LEFT JOIN t USING (row)"""
