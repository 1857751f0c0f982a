"""Removal of repeated byte strings by suffix arrays of linear grouping construction.

Every byte that is covered by a ``LENGTH``-byte string that also starts anywhere else goes. All of this is exact:

1. Anchors. Each string of LENGTH bytes holds FLANK + 1 grams of GRAM bytes; the one of least hash is its anchor, so
   equal strings have their anchors at the same place. A document has an anchor every FLANK / 2 bytes or so.
2. Anchors whose gram stands nowhere else can't be in a repeated string. The others are taken by wordings: a wording is
   a gram with its context (FLANK bytes before it and after it), wherever it stands.
3. A wording whose two 64-bit hashes stand more than once is a candidate for a repeat as a whole. The bytes of its first
   and its last occurrence are fetched, those of neighbouring wordings in the same two documents as one stretch. The
   stretch is cut where windows of its wordings begin or end, each string between two cuts is a symbol (the same for the
   same bytes), and the suffix array over the symbols of both occurrences tells which windows stand elsewhere.
   The other wordings that share a gram differ somewhere: what all contents of a group have in common is one symbol.
   They are cut into slices: the windows that begin ``s`` bytes before the gram, s in a range of STEP; the bytes that all
   windows of a slice hold are its key, and a group are the contents of one key. The suffix array of a group brings equal
   windows together; a group whose rows all have one content needs none. In groups with more than MOST_ROWS rows, rows
   of the same content are put together; groups of more contents are dealt anew by the next symbols: their slices are cut
   finer, so that keys hold more bytes, down to a window each.
4. Covered ranges are joined to spans by document, and cut out.

The suffix array (``suffix_array``) sorts suffixes into groups by their Lyndon prefix: groups are taken in descending
order, each suffix's previous suffix of a smaller group is found through the pointers of those done, and the suffixes
pointed at are moved behind their groups, by the number of pointers. The groups' own order then follows in one pass in
which each placed suffix places those before it that it ends the Lyndon prefix of. There is no recursive renaming.

Besides, each document's ``n_shared`` is told: the anchors of its strings of SHORT bytes whose gram stands elsewhere
too. It is above 0 wherever a string of SHORT bytes does, and each anchor that counts is a repeat of GRAM bytes.

Cases: a null or empty text, and one under LENGTH bytes, keeps all its bytes; repeated rows are each other's copies;
overlapping repeats within a document count; a null id is an id; long texts are hashed in blocks; other columns are not
carried. Rows that repeat both id and text are one document that stands twice. Candidates and keys go by 64-bit hashes
of bytes, contents and stretches by the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.checkpoints import discard
from tidemark.llm.common import checkpoint, sliced, table, written
from tidemark.llm.shingles import _BACK, _BASE, _power, mix

LENGTH, SHORT, GRAM = 400, 250, 150
FLANK = LENGTH - GRAM
STEP = 25
#: Windows of a slice where a group has too many rows: first this many, then fewer.
FINER = (5, 1)
#: First and last window offset of each slice.
SLICES = [(lo, min(FLANK, lo + STEP - 1)) for lo in range(0, FLANK + 1, STEP)]
#: Places of a document whose wordings make a stretch.
PLACES = 1 << 14
#: Rows of a group that a task holds.
MOST_ROWS = 128
#: Keys of documents, or of groups with too many rows, that are broadcast at most: 8 bytes each.
BROADCAST_KEYS = 2_000_000
#: Bytes of rows that a Python worker holds at once; bytes of texts that are hashed at once.
BYTES, BLOCK = 3 << 20, 1 << 20
_PLACE = np.uint64((1 << 28) - 1)


def suffix_array(text: list[int]) -> list[int]:
    """Places of the suffixes of ``text`` in order. The last symbol must be less than all others."""
    n = len(text)
    by: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        by.setdefault(c, []).append(i)
    group, members, size, begin_of = [0] * n, {}, {}, [0] * (n + 1)
    at = 0
    for c in sorted(by):  # groups of one symbol, as ranges of the order to be
        own = members[at] = by[c]
        size[at] = len(own)
        for i in own:
            group[i] = at
        begin_of[at + len(own)] = at
        at += len(own)
    before = [-1] * n
    end = n
    while end > 0:
        begin = begin_of[end]
        own = [i for i in members[begin] if group[i] == begin]
        count: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and group[j] >= begin:
                j = before[j]
            before[i] = j
            if j >= 0:
                count[j] = count.get(j, 0) + 1
        if count:
            times = set(count.values())
            for t in (times if len(times) == 1 else sorted(times, reverse=True)):
                moved: dict[int, list[int]] = {}
                for j, k in count.items():
                    if k == t:
                        moved.setdefault(group[j], []).append(j)
                for old, some in moved.items():
                    if len(some) == size[old]:
                        continue
                    some.sort()
                    last = old + size[old]
                    new = last - len(some)
                    size[old] -= len(some)
                    size[new] = len(some)
                    members[new] = some
                    for j in some:
                        group[j] = new
                    begin_of[last], begin_of[new] = new, old
        end = begin
    order, filled, placed = [0] * n, dict.fromkeys(size, 0), bytearray(n)
    order[0] = n - 1
    placed[n - 1] = 1
    for k in range(n):
        j = order[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            order[g + filled[g]] = j
            filled[g] += 1
            placed[j] = 1
            j = before[j]
    return order


def repeated_windows(contents: list[tuple[bytes, bytes, int]], span: int) -> list[int]:
    """For contents (bytes before, bytes after the common symbol, how often each stands: 1, or 2 for more), a mask of the
    windows of ``span`` bytes and the symbol that stand more than once: bit k for the window that begins k bytes before
    the symbol. Bytes next to the symbol that all contents have are taken into it."""
    p, q = _shared_end([c[0][::-1] for c in contents]), _shared_end([c[1] for c in contents])
    text: list[int] = []
    middle, owner = [], []
    for c, (left, right, copies) in enumerate(contents):  # 0 ends all, 1 ends a content, 2 is the symbol, bytes are from 3 on
        own = [x + 3 for x in left[: len(left) - p]] + [2] + [x + 3 for x in right[q:]] + [1]
        for _ in range(copies):
            middle.append(len(text) + max(0, len(left) - p))
            text += own
            owner.append(c)
    text.append(0)
    of = {}
    for n, at in enumerate(middle):
        for k in range(min(at - (0 if not n else middle[n - 1]), max(0, span - p)) + 1):
            if text[at - k] == 1:
                break
            of[at - k] = n
    masks, last = [0] * len(contents), -1
    for i in suffix_array(text):
        n = of.get(i)
        if n is None:
            continue
        if last >= 0:
            m = of[last]
            before = middle[n] - i
            if before == middle[m] - last:
                for k in [before + p] if before else range(min(p, span) + 1):
                    left, right, _ = contents[owner[n]]
                    if k > len(left) or span - k > len(right):
                        continue
                    size = before + 1 + max(0, span - k - q)
                    if text[i : i + size] == text[last : last + size]:
                        masks[owner[n]] |= 1 << k
                        masks[owner[m]] |= 1 << k
        last = i
    return masks


def _shared_end(parts: list[bytes]) -> int:
    """Bytes from the start on that all parts have."""
    low, high = min(parts), max(parts)
    if low == high:
        return len(low)
    return next((k for k, (x, y) in enumerate(zip(low, high)) if x != y), len(low))


class Hashed:
    """Prefix hashes of some bytes, from which the hash of any range is had."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n), out=self.total[1:], dtype=np.uint64)
        self.back = _power(_BACK, n + 1)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.back[start] + (end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))

    def grams(self, first: int, end: int) -> np.ndarray:
        """Hashes of the grams that begin in a range."""
        return (self.total[first + GRAM : end + GRAM] - self.total[first:end]) * self.back[first:end]


def _least(keyed: np.ndarray, w: int) -> np.ndarray:
    """Places of the least of each ``w`` keys in a row; places are in the low bits of the keys."""
    m = len(keyed)
    rows = -(-m // w)
    padded = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:m] = keyed
    block = padded.reshape(rows, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[: m - w + 1], ahead[w - 1 : m]) & _PLACE).astype(np.int64)


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column, one after the other, and where each ends."""
    column = column.cast(pa.string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)), offsets[1:] - offsets[0]


def _anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(texts, places, hashes of grams, hashes of contexts, whether it is an anchor of LENGTH bytes) of the anchors of all
    strings of SHORT bytes in texts that follow one another. Anchors of longer strings are among those of shorter ones."""
    none = np.zeros(0, np.int64)
    m = len(data) - GRAM + 1
    if len(data) < SHORT:
        return none, none, none.view(np.uint64), none.view(np.uint64), none.astype(bool)
    h = Hashed(data)
    grams = h.grams(0, m)
    keyed = ((grams * np.uint64(0xD6E8FEB86659FD93)) & ~_PLACE) | np.arange(m, dtype=np.uint64)  # high bits are the well mixed ones

    def of(size: int) -> np.ndarray:
        own = np.ones(max(0, len(data) - size + 1), bool)  # strings that lie in one text
        for e in ends.tolist():
            own[max(0, e - size + 1) : e] = False
        found = np.zeros(m, bool)
        if len(own):
            found[_least(keyed, size - GRAM + 1)[own]] = True
        return found

    at = np.flatnonzero(of(SHORT))
    text = np.searchsorted(ends, at, side="right")
    first = np.r_[0, ends][text]
    begin, close = np.maximum(at - FLANK, first), np.minimum(at + LENGTH, ends[text])
    # the distance to the text's ends is part of a context that they cut short
    return text, at - first, mix(grams[at]), mix(h.ranges(begin, close) + (at - begin).astype(np.uint64)), of(LENGTH)[at]


def anchors_of(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """What _anchors() gives, for texts of any length: a text over BLOCK bytes comes alone, and in blocks."""
    n = len(data)
    if n <= BLOCK or len(ends) > 1:
        yield _anchors(data, ends)
        return
    for start in range(0, n, BLOCK):
        low, high = max(0, start - FLANK), min(n, start + BLOCK + 2 * LENGTH)
        text, at, *rest = _anchors(data[low:high], np.array([high - low]))
        own = (at + low >= start) & (at + low < start + BLOCK)
        yield text[own], at[own] + low, *(x[own] for x in rest)


def anchors(docs: DataFrame) -> DataFrame:
    """(key, at, gram, context) for (key, text): hashes of the gram and, for anchors of LENGTH bytes, of its context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, BLOCK):
            keys = batch.column(0).to_numpy()
            for text, at, gram, context, long in anchors_of(*_texts(batch.column(1))):
                yield pa.RecordBatch.from_arrays([pa.array(keys[text]), pa.array(at.astype(np.int32)), pa.array(gram.view(np.int64)), pa.array(context.view(np.int64), mask=~long)], ["key", "at", "gram", "context"])

    return docs.select("key", "text").mapInArrow(run, "key long, at int, gram long, context long")


#: Rows for the suffix array: the group; the wording; first and last window; how often the wording stands (1, or 2 for
#: more); whether its windows are to be told; the bytes around what is common.
ROW = "common long, gram long, context long, lo int, hi int, copies int, told boolean, left binary, right binary"
#: Rows of ROW or, if ``piece``, bytes (left) of a stretch (common): where they begin (lo) and of which occurrence (hi).
FETCHED = f"{ROW}, piece boolean"
_lo, _hi = np.array(SLICES, np.int64).T


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The bytes of each range."""
    ends = np.r_[0, np.cumsum(size)]
    at = np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)
    return pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data[at].tobytes())])


def _slices_of(data: np.ndarray, first: np.ndarray, end_of: np.ndarray, at: np.ndarray, gram: np.ndarray, context: np.ndarray, twice: np.ndarray) -> list[pa.Array]:
    """The columns of ROW for wordings at places of ``data``, in texts that begin and end at others."""
    h = Hashed(data)
    start, end = at[:, None] - _lo, at[:, None] + LENGTH - _hi
    row, number = np.nonzero((start >= first[:, None]) & (end <= end_of[:, None]))
    start, end, lo, hi, gram, twice = start[row, number], end[row, number], _lo[number], _hi[number], gram[row], twice[row]
    common = mix(h.ranges(start, end) ^ mix(gram.view(np.uint64) + number.astype(np.uint64) + np.uint64(1))).view(np.int64)
    left, right = np.minimum(hi - lo, start - first[row]), np.minimum(hi - lo, end_of[row] - end)
    columns = [pa.array(x) for x in (common, gram, context[row], lo.astype(np.int32), hi.astype(np.int32), (1 + twice).astype(np.int32), ~twice)]
    return [*columns, _gather(data, start - left, left), _gather(data, end, right), pa.array(np.zeros(len(row), bool))]


def _pieces_of(data: np.ndarray, ends: np.ndarray, lists: pa.ListArray) -> list[pa.Array]:
    """The columns of FETCHED for pieces of texts that follow one another, cut off at the ends of their texts."""
    text = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    stretch, side, lo, hi = (lists.flatten().field(k).to_numpy(zero_copy_only=False) for k in ("stretch", "side", "lo", "hi"))
    first, n = np.r_[0, ends][text], len(text)
    start = np.minimum(first + np.maximum(lo, 0), ends[text])
    end = np.maximum(start, np.minimum(first + hi, ends[text]))
    none, void = pa.nulls(n, pa.int64()), _gather(data, start, np.zeros(n, np.int64))
    return [pa.array(stretch), none, none, pa.array((start - first).astype(np.int32)), pa.array(side.astype(np.int32)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.bool_()), _gather(data, start, end - start), void, pa.array(np.ones(n, bool))]


def slices(docs: DataFrame) -> DataFrame:
    """FETCHED for (key, text, wanted, pieces): each slice of each wanted wording whose common part lies in the text, and
    each piece of a stretch."""
    names = T._parse_datatype_string(FETCHED).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, BLOCK):
            data, ends = _texts(batch.column(1))
            yield pa.RecordBatch.from_arrays(_pieces_of(data, ends, batch.column(3)), names)
            lists = batch.column(2)
            text = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            of = {k: lists.flatten().field(k).to_numpy(zero_copy_only=False) for k in ("at", "gram", "context", "twice")}
            first, end_of = np.r_[0, ends][text], ends[text]
            at = of["at"] + first
            order = np.argsort(at, kind="stable")
            for k in np.split(order, np.flatnonzero(np.diff(at[order] // BLOCK)) + 1):  # stretches of a long text
                if len(k):
                    low, high = max(0, int(at[k[0]]) - FLANK), min(len(data), int(at[k[-1]]) + LENGTH)
                    bounds = np.maximum(first[k] - low, 0), np.minimum(end_of[k], high) - low
                    yield pa.RecordBatch.from_arrays(_slices_of(data[low:high], *bounds, at[k] - low, of["gram"][k], of["context"][k], of["twice"][k]), names)

    return docs.select("key", "text", "wanted", "pieces").mapInArrow(run, FETCHED)


def finer(rows: DataFrame, step: int) -> DataFrame:
    """The rows with their slices cut into slices of ``step`` windows: their keys hold more of the bytes."""
    rows = rows.withColumn("a", F.explode(F.expr(f"sequence(lo, hi, {step})"))).withColumn("b", F.least(F.col("hi"), F.col("a") + (step - 1)))
    # all windows of a new slice hold these many bytes before and after the common part
    rows = rows.withColumn("x", F.col("a") - F.col("lo")).withColumn("y", F.col("hi") - F.col("b")).where("length(left) >= x and length(right) >= y")
    kept = F.expr("substring(left, greatest(1, length(left) - x - (b - a) + 1), least(b - a, length(left) - x))")
    common = F.xxhash64("common", "a", F.expr("substring(left, length(left) - x + 1, x)"), F.expr("substring(right, 1, y)"))
    return rows.select(common.alias("common"), "gram", "context", F.col("a").alias("lo"), F.col("b").alias("hi"), "copies", "told", kept.alias("left"), F.expr("substring(right, y + 1, b - a)").alias("right"))


def _fitting(left: int, right: int, span: int) -> int:
    """The windows that lie in a content of so many bytes before and after the common part."""
    return sum(1 << k for k in range(span + 1) if k <= left and span - k <= right)


def _judge(group: list[tuple]) -> Iterator[tuple[int, int, int, int, int]]:
    """(common, gram, context, first, last) of the repeated windows of a group."""
    lo, hi = group[0][3], group[0][4]
    by: dict[tuple[bytes, bytes], list[tuple]] = {}
    for row in group:
        by.setdefault((row[7], row[8]), []).append(row)
    span = hi - lo
    if len(by) == 1:
        left, right = next(iter(by))
        masks = [_fitting(len(left), len(right), span) if len(group) > 1 or group[0][5] > 1 else 0]
    else:
        masks = repeated_windows([(left, right, min(2, sum(r[5] for r in own))) for (left, right), own in by.items()], span)
    for own, mask in zip(by.values(), masks):
        if mask:
            runs = [(lo + a, lo + b) for a, b in _runs(mask)]
            for row in own:
                if row[6]:
                    for a, b in runs:
                        yield row[0], row[1], row[2], a, b


def covered(rows: DataFrame) -> DataFrame:
    """(common, gram, context, first, last): windows that are repeated, as ranges of bytes before the gram at which they
    begin. The rows of a group go to one task, in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in sliced(batches, BYTES):
            common = batch.column(0).to_numpy()
            edge = np.r_[True, common[1:] != common[:-1], True]
            some = ~(edge[:-1] & edge[1:]) | (batch.column(5).to_numpy() > 1)
            some[0] = some[-1] = True  # these may go on in other batches
            out: list[tuple[int, int, int, int, int]] = []
            for row in zip(*(c.to_pylist() for c in batch.filter(pa.array(some)).columns)):
                if held and held[0][0] != row[0]:
                    out += _judge(held)
                    held = []
                held.append(row)
            yield _ranges(out)
        if held:
            yield _ranges(list(_judge(held)))

    # dealt by a function of the key: where a plain repartition by the key of a join is left out, a skew join may split it
    dealt = rows.repartition(F.xxhash64("common")).sortWithinPartitions("common")
    return dealt.mapInArrow(run, "common long, gram long, context long, first int, last int")


def _runs(mask: int) -> Iterator[tuple[int, int]]:
    k = 0
    while mask >> k:
        if mask >> k & 1:
            a = k
            while mask >> k & 1:
                k += 1
            yield a, k - 1
        k += 1


def _ranges(rows: list[tuple[int, int, int, int, int]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [()] * 5, kinds)], ["common", "gram", "context", "first", "last"])


def _runs_of(ranges: Column) -> Column:
    """Ranges (first, last) of which those that touch are joined."""
    start = F.array().cast("array<struct<first:int,last:int>>")

    def add(out: Column, x: Column) -> Column:
        old = F.try_element_at(out, F.lit(-1))
        longer = F.struct(old["first"].alias("first"), F.greatest(old["last"], x["last"]).alias("last"))
        joined = F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(longer))
        return F.when((F.size(out) > 0) & (x["first"] <= old["last"] + 1), joined).otherwise(F.concat(out, F.array(x)))

    return F.aggregate(F.array_sort(ranges), start, add)


def windows(rows: DataFrame, steps: tuple[int, ...] = FINER, once: bool = False) -> DataFrame:
    """What covered() returns, for groups of any size; ``rows`` should be written. In groups with too many rows, rows of
    the same content are put together; those that then have too many contents are dealt anew by the next symbols.
    ``once``: no group has a content twice."""
    hot = checkpoint(rows.groupBy("common").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_ROWS).select("common"))
    n = hot.count()
    if not n:
        return covered(rows)
    hot = hot.hint("broadcast") if n <= BROADCAST_KEYS else hot
    large = written(rows.join(hot, "common", "left_semi").select(rows.columns))
    if once:
        more = windows(written(finer(large, steps[0])), steps[1:])
    else:
        content = F.xxhash64("common", "left", "right")
        same = large.groupBy("common", content.alias("gram")).agg(F.lit(0).cast("long").alias("context"), *(F.first(c).alias(c) for c in ("lo", "hi")), F.least(F.lit(2), F.sum("copies")).cast("int").alias("copies"), F.max("told").alias("told"), *(F.first(c).alias(c) for c in ("left", "right")))
        found = windows(written(same.select(rows.columns)), steps, True).groupBy(F.col("gram").alias("_content")).agg(_runs_of(F.collect_set(F.struct("first", "last"))).alias("_runs"))
        more = large.where("told").join(found, content == F.col("_content")).select("common", "gram", "context", F.inline("_runs"))
    return covered(rows.join(hot, "common", "left_anti")).unionByName(more)


def stretches(twice: DataFrame) -> DataFrame:
    """(stretch, key, other, lo, hi, shift, wordings) for (gram, context, key, at, other, other_at): wordings whose first
    and last occurrences lie in the same two documents, equally far apart, by PLACES places of the first document."""
    shift, part = (F.col("other_at") - F.col("at")).alias("shift"), F.floor(F.col("at") / PLACES).alias("part")
    found = twice.groupBy("key", "other", shift, part).agg((F.min("at") - FLANK).alias("lo"), (F.max("at") + LENGTH).alias("hi"), F.collect_list(F.struct("at", "gram", "context")).alias("wordings"))
    return found.select(F.xxhash64("key", "other", "shift", "part").alias("stretch"), "key", "other", "lo", "hi", "shift", "wordings")


def windows_elsewhere(a: bytes, b: bytes, starts: list[int], shift: int | None = None) -> set[int]:
    """Those of the ``starts`` in ``a`` whose windows of LENGTH bytes stand elsewhere in ``a`` or in ``b``. Where both are of
    one text, b begins ``shift`` bytes after a, and what lies at the same place is not elsewhere."""
    cuts = sorted({x for s in starts for x in (s, s + LENGTH)})
    number = {c: k for k, c in enumerate(cuts)}
    text: list[int] = []
    place: list[int | tuple[int, int]] = []
    symbols: dict[bytes, int] = {}  # 0 ends all, 1 ends an occurrence
    for n, data in enumerate((a, b)):
        for x, y in zip(cuts, cuts[1:]):
            text.append(symbols.setdefault(data[x:y], len(symbols) + 2))
            place.append((n, x) if shift is None else x + n * shift)
        text.append(1)
        place.append(-1)
    text.append(0)
    place.append(-2)
    asked = {number[s]: s for s in starts}
    order = suffix_array(text)
    out = set()
    for k, i in enumerate(order):
        if i in asked:
            window = text[i : number[asked[i] + LENGTH]]
            for step in (-1, 1):  # a place stands twice at most, so this ends soon
                j = k + step
                while 0 <= j < len(order) and text[order[j] : order[j] + len(window)] == window:
                    if place[order[j]] != place[i]:
                        out.add(asked[i])
                        break
                    j += step
    return out


def repeated_wordings(pieces: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, context, first, last): windows of the wordings of stretches that stand elsewhere, as ranges of bytes before the
    gram at which they begin. The first and the last window of a wording cover it, so these two are judged."""
    schema = "gram long, context long, first int, last int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, BYTES):
            out: list[tuple[int, int, int, int]] = []
            for lo, a, b, shift, wordings in zip(*(c.to_pylist() for c in batch.columns)):
                ends = [(w, max(0, w["at"] - FLANK - lo), min(len(a), w["at"] + LENGTH - lo)) for w in wordings]
                ends = [x for x in ends if x[2] - x[1] >= LENGTH]
                found = windows_elsewhere(a, b, sorted({x for _, s, e in ends for x in (s, e - LENGTH)}), shift)
                for w, s, e in ends:
                    at = w["at"] - lo
                    some = [at - x for x in (e - LENGTH, s) if x in found]
                    if len(some) == 2:
                        out.append((w["gram"], w["context"], *some))
                    else:
                        out += [(w["gram"], w["context"], k, k) for k in some]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else [()] * 4, kinds)], ["gram", "context", "first", "last"])

    side = lambda n: pieces.where(F.col("hi") == n).select(F.col("common").alias(f"_s{n}"), F.col("lo").alias(f"_lo{n}"), F.col("left").alias(f"_b{n}"))
    one_text = F.when((F.col("key") == F.col("other")) & (F.col("shift") != 0), F.col("_lo1") - F.col("_lo0"))
    both = side(0).join(side(1), F.col("_s0") == F.col("_s1")).join(wanted, F.col("_s0") == F.col("stretch"))
    return both.select("_lo0", "_b0", "_b1", one_text.alias("shift"), "wordings").mapInArrow(run, schema)


def repeats(docs: DataFrame) -> DataFrame:
    """(key, start, end) for (key, text): ranges of bytes that are covered by repeated strings, not yet joined; and a row
    without range for each anchor whose gram stands elsewhere too."""
    places = written(anchors(docs))
    shared = written(places.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"))
    here = written(places.join(shared, "gram"))
    discard(places, shared)
    main = here.where("context is not null")
    place = F.struct("key", "at")
    wordings = main.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("one"), F.max(place).alias("last"))
    wordings = written(wordings.select("gram", "context", (F.col("n") > 1).alias("twice"), "one.key", "one.at", F.when(F.col("n") > 1, F.col("last")).alias("last")))
    alike = written(stretches(wordings.where("twice").select("gram", "context", "key", "at", F.col("last.key").alias("other"), F.col("last.at").alias("other_at"))))
    others = wordings.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
    mixed = wordings.join(others, "gram", "left_semi").select(F.col("key").alias("_key"), F.struct("gram", "context", "at", "twice").alias("w"))
    fetch = lambda key, n, by: alike.select(F.col(key).alias("_key"), F.struct("stretch", F.lit(n).alias("side"), (F.col("lo") + by).cast("int").alias("lo"), (F.col("hi") + by).cast("int").alias("hi")).alias("p"))
    asked = mixed.unionByName(fetch("key", 0, F.lit(0)).unionByName(fetch("other", 1, F.col("shift"))), allowMissingColumns=True)
    asked = written(asked.groupBy("_key").agg(F.collect_list("w").alias("wanted"), F.collect_list("p").alias("pieces")))
    few = asked.select(F.col("_key").alias("_own"))
    if few.count() <= BROADCAST_KEYS:
        docs = docs.join(F.broadcast(few), F.col("key") == F.col("_own"), "left_semi")
    texts = docs.dropDuplicates(["key"]).join(asked, F.col("key") == F.col("_key")).select("key", "text", "wanted", "pieces")
    fetched = written(slices(texts))
    whole = repeated_wordings(fetched.where("piece"), alike)
    found = written(windows(fetched.where("not piece").drop("piece")).drop("common").unionByName(whole))
    discard(fetched, asked, alike, wordings)
    apart = main.join(found, ["gram", "context"]).select("key", (F.col("at") - F.col("last")).alias("start"), (F.col("at") - F.col("first") + LENGTH).alias("end"))
    return apart.unionByName(here.select("key", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end")))


def _cut(data: bytes, ranges: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal spans of the ranges, and the bytes outside them."""
    spans: list[list[int]] = []
    for a, b in sorted(ranges):
        a, b = max(0, a), min(b, len(data))
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    kept.append(data[at:])
    return [(a, b) for a, b in spans], b"".join(kept)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_shared, spans array<struct<start, end>>, kept binary): the removed byte spans, what stays of each
    row, and the anchors whose gram stands elsewhere too."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("key", F.xxhash64("id", "text"))
    ranges = repeats(docs.select("key", "text")).groupBy("key").agg(F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "end"))).alias("ranges"), F.count_if(F.col("start").isNull()).alias("shared"))
    ranges = ranges.select(F.col("key").alias("_key"), "ranges", "shared")
    kind = df.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_shared", T.LongType()), T.StructField("spans", T._parse_datatype_string("array<struct<start:int,end:int>>")), T.StructField("kept", T.BinaryType())])
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, BYTES):
            sizes, spans, kept = [], [], []
            for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = (text or "").encode()
                own, rest = _cut(data, [(r["start"], r["end"]) for r in ranges or ()])
                sizes.append(len(data))
                spans.append([{"start": a, "end": b} for a, b in own])
                kept.append(rest)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), batch.column(3), pa.array(spans, span), pa.array(kept, pa.binary())], schema.names)

    return docs.join(ranges, F.col("key") == F.col("_key"), "left").select("id", "text", "ranges", F.coalesce("shared", F.lit(0).cast("long")).alias("shared")).mapInArrow(run, schema)


def op10_suffix_array(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_shared")
