"""Substring deduplication by content-defined chunking with a gear rolling hash.

The gear hash of a place sums random numbers of the last 32 bytes, each shifted by its distance, so it depends on those
bytes alone. White space at which the hash has MASK_BITS zero bits is a border. In stretches of over MOST bytes without
one, as in text without blanks, any end of a character at which it has BARE_BITS zero bits is one too. A chunk ends at a
border once it has LEAST bytes; one that still has MOST bytes ends at the next start of a character. An insertion thus
shifts borders only until the next common one. A stretch without blanks of MOST bytes or less stays whole. Chunks are told
by a 128-bit digest; of equal ones the first, by id and place, stays and the others are cut out.

Cases: a null or empty text has no chunks; a text without a border is one chunk; rows that repeat with the same id and
text are one document and are treated alike; a null id comes before all others; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import checkpoint, sliced, table
from tidemark.llm.shingles import mix

REACH, LEAST, MOST, MASK_BITS, BARE_BITS = 32, 48, 1024, 3, 6
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte, over REACH bytes: sums over 1, 2, 4 ... bytes, each from two of the last."""
    h, n = _GEAR[data], 1
    while n < REACH:
        longer = h.copy()
        longer[n:] += h[:-n] << np.uint32(n)
        h, n = longer, 2 * n
    return h


def borders(data: bytes) -> list[int]:
    """Ends of the chunks of a text."""
    n = len(data)
    if not n:
        return []
    b = np.frombuffer(data, np.uint8)
    h = gear(b)
    ends = np.flatnonzero(_SPACE[b] & (h >> np.uint32(32 - MASK_BITS) == 0)) + 1
    edges = np.r_[0, ends, n]
    if np.diff(edges).max() > MOST:
        bare = np.flatnonzero(h[:-1] >> np.uint32(32 - BARE_BITS) == 0) + 1
        bare = bare[b[bare] & 0xC0 != 0x80]
        k = np.searchsorted(edges[1:-1], bare, side="right")
        ends = np.union1d(ends, bare[edges[k + 1] - edges[k] > MOST])
    out, at = [], 0
    for e in [*ends.tolist(), n]:
        while e - at > MOST:
            cut = at + MOST
            while cut < n and data[cut] & 0xC0 == 0x80:
                cut += 1
            if cut >= e:
                break
            out.append(cut)
            at = cut
        if e - at >= LEAST or e == n and e > at:
            out.append(e)
            at = e
    return out


def chunks(docs: DataFrame) -> DataFrame:
    """(id, key, d1, d2, start, end) of every chunk of (id, key, text); start and end count bytes."""
    kind = docs.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("key", T.LongType()), *(T.StructField(c, T.LongType()) for c in ("d1", "d2")), *(T.StructField(c, T.IntegerType()) for c in ("start", "end"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            row, digests, starts, ends = [], [], [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                data = (text or "").encode()
                cuts = borders(data)
                row += [k] * len(cuts)
                begin = [0, *cuts[:-1]] if cuts else []
                digests += [blake2b(data[a:b], digest_size=16).digest() for a, b in zip(begin, cuts)]
                starts += begin
                ends += cuts
            d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], schema.names)

    return docs.select("id", "key", "text").mapInArrow(run, schema)


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_chunks, repeated, removed, kept) of each row. ``repeated``: the byte ranges of chunks that stand
    elsewhere too; ``removed``: those of which an earlier one stays; ``kept``: the bytes that stay."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("key", F.xxhash64("id", "text"))
    found = chunks(docs)
    place = F.struct("id", "key", "start")
    shared = found.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    shared = checkpoint(shared.where(~F.col("first").eqNullSafe(F.col("last"))).select("d1", "d2", F.col("first.key").alias("first_key"), F.col("first.start").alias("first_start")))
    again = found.join(shared, ["d1", "d2"])
    stays = (F.col("key") == F.col("first_key")) & (F.col("start") == F.col("first_start"))
    ranges = again.groupBy(F.col("key").alias("_key")).agg(F.collect_set(F.struct("start", "end", stays.alias("stays"))).alias("ranges"))
    kind = df.schema[id_col].dataType
    spans = "array<struct<start:int,end:int>>"
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("n_bytes", T.LongType()), T.StructField("repeated", T._parse_datatype_string(spans)), T.StructField("removed", T._parse_datatype_string(spans)), T.StructField("kept", T.BinaryType())])
    arrow_spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sizes, repeated, removed, kept = [], [], [], []
            for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = (text or "").encode()
                own = sorted((r["start"], r["end"], r["stays"]) for r in ranges or ())
                out, at = [], 0
                for a, b, stays in own:
                    if not stays:
                        out.append(data[at:a])
                        at = b
                sizes.append(len(data))
                repeated.append([{"start": a, "end": b} for a, b, _ in own])
                removed.append([{"start": a, "end": b} for a, b, stays in own if not stays])
                kept.append(b"".join([*out, data[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(repeated, arrow_spans), pa.array(removed, arrow_spans), pa.array(kept, pa.binary())], schema.names)

    return docs.join(ranges, F.col("key") == F.col("_key"), "left").select("id", "text", "ranges").mapInArrow(run, schema)


def op5_chunk_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"))
    size = lambda spans: F.aggregate(spans, F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", F.size("repeated").cast("long").alias("n_repeated_chunks"), size("repeated").alias("n_repeated"), size("removed").alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
