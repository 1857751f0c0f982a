"""Byte-level BPE: a priority queue of merge ranks over a doubly linked list of symbols.

The queue holds (rank, position). An entry is stale when the symbols at its position have changed since it was
pushed; it is skipped when popped. Decoding concatenates the byte strings of the vocabulary.

Cases: a null or empty text has no ids and decodes to the empty text; a text that is one run of many thousand
letters takes n log n steps; a long text is split in stretches; repeated rows and a null id give a row each; other columns are not carried.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import hex_sha256, sliced, table

#: The pattern by which byte-level BPE of this vocabulary splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words up to this length are kept; characters of a text that are split at once, up to the next place between two words.
LONGEST_KEPT, STRETCH = 64, 1 << 20
_cut = regex.compile(r"(?<=\p{L}) (?=\p{L})")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: itself where printable, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Words(dict):
    """Packed ids of the words seen lately, ``keep`` at most in each of two generations; a missing word is merged."""

    def __init__(self, merge, keep: int):
        super().__init__()
        self.merge, self.keep, self.old = merge, keep, {}

    def __missing__(self, word: str) -> bytes:
        packed = self.old.get(word)
        if packed is None:
            packed = array("i", self.merge(word.encode())).tobytes()
        if len(word) <= LONGEST_KEPT:
            if len(self) >= self.keep:
                self.old = dict(self)
                self.clear()
            self[word] = packed
        return packed


class Bpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str, keep: int = 300_000):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        vocab, letters = data["model"]["vocab"], byte_letters()
        self.bytes_of: dict[int, bytes] = {i: bytes(letters[c] for c in word) for word, i in vocab.items()}
        self.byte_id = [0] * 256
        for letter, b in letters.items():
            self.byte_id[b] = vocab[letter]
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        self.left_of: list[int] = []
        self.right_of: list[int] = []
        for r, pair in enumerate(data["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[left] << 20 | vocab[right]] = r
            self.merged.append(vocab[left + right])
            self.left_of.append(vocab[left])
            self.right_of.append(vocab[right])
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.split_special = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.words = regex.compile(PATTERN).findall
        self.keep = keep
        self.forget()

    def forget(self) -> None:
        """Lets the words go that were seen."""
        self.seen = Words(self.merge, self.keep)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word, merging the pair of least rank and, of those, the leftmost first."""
        n, get = len(word), self.rank.get
        ids = [self.byte_id[b] for b in word]
        shift = n.bit_length()
        queue = [r << shift | i for i, (a, b) in enumerate(pairwise(ids)) if (r := get(a << 20 | b)) is not None]
        if not queue:
            return ids
        heapify(queue)
        ids.append(-1)  # on both sides of the word: no pair with it has a rank
        after, before = list(range(1, n + 1)), list(range(-1, n))
        left_of, right_of, merged, place = self.left_of, self.right_of, self.merged, (1 << shift) - 1
        while queue:
            entry = heappop(queue)
            i, r = entry & place, entry >> shift
            if ids[i] != left_of[r] or ids[j := after[i]] != right_of[r]:
                continue  # stale
            ids[i], ids[j] = (made := merged[r]), -2
            after[i] = k = after[j]
            before[k] = i
            if (r := get(made << 20 | ids[k])) is not None:
                heappush(queue, r << shift | i)
            if (r := get(ids[p := before[i]] << 20 | made)) is not None:
                heappush(queue, r << shift | p)
        return [x for x in ids if x >= 0]

    def _plain(self, text: str) -> Iterator[bytes]:
        """Packed ids of a text, in stretches."""
        at = 0
        while at < len(text):
            end = m.start() if len(text) - at > STRETCH and (m := _cut.search(text, at + STRETCH)) else len(text)
            yield b"".join(map(self.seen.__getitem__, self.words(text[at:end] if at or end < len(text) else text)))
            at = end

    def _parts(self, text: str) -> Iterator[bytes]:
        if self.split_special is None:
            yield from self._plain(text)
            return
        at = 0
        for m in self.split_special.finditer(text):
            yield from self._plain(text[at : m.start()])
            yield array("i", [self.special[m[0]]]).tobytes()
            at = m.end()
        yield from self._plain(text[at:] if at else text)

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(self._parts(text)) if text else b"", np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


_LOADED: dict[str, Bpe] = {}


@contextmanager
def loaded(path: str) -> Iterator[Bpe]:
    """The vocabulary stays in a Python worker; the words seen go with the task that saw them."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    try:
        yield _LOADED[path]
    finally:
        _LOADED[path].forget()


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32)))


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_decoded: bool = False) -> DataFrame:
    """(id, ids array<int>) of every whole text, and the ``decoded`` text of these ids where asked for. ``path`` is the
    vocabulary file on each executor."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("decoded", T.StringType())] * with_decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with loaded(path) as bpe:
            for batch in sliced(batches):
                rows = [bpe.encode(x) for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(rows)] + [pa.array(map(bpe.decode, rows), pa.string())] * with_decoded, schema.names)

    return df.select(id_col, text_col).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, decoded string) of every list of ids; of a null list, the empty text."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with loaded(path) as bpe:
            for batch in sliced(batches):
                lists = batch.column(1)
                flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
                known = lists.is_valid().to_pylist()
                texts = [bpe.decode(flat[a:b]) if ok else "" for a, b, ok in zip(ends[:-1], ends[1:], known)]
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(texts, pa.string())], schema.names)

    return df.select(id_col, ids_col).mapInArrow(run, schema)


def digests(df: DataFrame, path: str) -> DataFrame:
    """Contract columns of op9, from the ids of ``documents`` and what these decode to."""
    both = encode(df, path, with_decoded=True)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), hex_sha256(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), hex_sha256(F.col("decoded")).alias("decoded_sha256"))


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
