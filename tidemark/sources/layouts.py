"""Binary files by declared layouts: fields, sizes and conditions from fields read before, and loops.

A layout is a list of items: Field (type, name, shape), When (condition, items), Loop (count, items) and Rest. Shapes, counts
and conditions are expressions over the fields that came before, of the same loop turn first. The reader is a Python data
source. A file is one partition for each ``chunk_bytes`` of its length, which listing tells; each walks the layout, reading
small fields only and stepping over large arrays, and gives what begins in its own bytes, large arrays by element ranges.
So the driver opens no file, and a large array is read by many tasks. The walk itself is repeated by each part of a file,
so chunks should be large against what is not in large arrays.

    spark.dataSource.register(LayoutSource)
    df = spark.read.format("layout").option("path", "/data/*.smp").option("layout", "surface_map").load()
    write(df, "/data/copies")

Rows: (file, offset, field, turns, type, shape, first, numbers, whole, text). ``turns`` are the loop turns from 0 on, ``first``
the number of the first element given, ``numbers`` floating values, ``whole`` integers, ``text`` a string that ends with a
zero byte. A file that ends within a field is an error that names the field; bytes after the last item are an error too,
unless the layout has a Rest.
"""

from __future__ import annotations

import ast
import json
import operator
import posixpath
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.sources.recordings import CHUNK_BYTES, _size, _store, expand

SCHEMA = "file string, offset long, field string, turns array<int>, type string, shape array<long>, first long, numbers array<double>, whole array<long>, text string"
#: Arrays of more bytes aren't read on the walk; bytes that the walk reads at once.
LARGE, AHEAD = 4096, 1 << 16

_TWO = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.Pow: operator.pow}
_COMPARE = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge}


@dataclass(frozen=True)
class Field:
    """type: a numpy type such as "<f4", or "cstring"."""

    type: str
    name: str
    shape: tuple = ()


@dataclass(frozen=True)
class When:
    condition: str
    items: list


@dataclass(frozen=True)
class Loop:
    count: str
    items: list


@dataclass(frozen=True)
class Rest:
    """Whatever follows, as bytes."""

    name: str = "rest"


def value_of(expression: str | int, known: dict) -> int | float | bool:
    """Arithmetic, comparisons, and, or and not over names and numbers."""

    def of(x: ast.AST):
        if isinstance(x, ast.Constant) and isinstance(x.value, (int, float)):
            return x.value
        if isinstance(x, ast.Name):
            return known[x.id]
        if isinstance(x, ast.BinOp) and type(x.op) in _TWO:
            return _TWO[type(x.op)](of(x.left), of(x.right))
        if isinstance(x, ast.UnaryOp) and isinstance(x.op, (ast.USub, ast.Not)):
            return -of(x.operand) if isinstance(x.op, ast.USub) else not of(x.operand)
        if isinstance(x, ast.BoolOp):
            return (all if isinstance(x.op, ast.And) else any)(bool(of(v)) for v in x.values)
        if isinstance(x, ast.Compare) and all(type(o) in _COMPARE for o in x.ops):
            sides = [of(x.left), *map(of, x.comparators)]
            return all(_COMPARE[type(o)](a, b) for o, a, b in zip(x.ops, sides, sides[1:]))
        raise ValueError(f"not an expression of a layout: {expression}")

    return expression if isinstance(expression, int) else of(ast.parse(expression, mode="eval").body)


@dataclass
class Extent:
    """Where a field lies; ``data`` has its bytes unless it is large."""

    field: Field
    turns: tuple
    offset: int
    shape: tuple
    data: bytes | None


class _Bytes:
    """Reads forward with a buffer."""

    def __init__(self, file, size: int, path: str):
        self.file, self.size, self.path, self.start, self.held = file, size, path, 0, b""

    def at(self, offset: int, n: int, name: str) -> bytes:
        if offset + n > self.size:
            raise ValueError(f"{self.path} ends within {name}")
        if not (self.start <= offset and offset + n <= self.start + len(self.held)):
            self.start, self.held = offset, self.file.read_at(min(max(n, AHEAD), self.size - offset), offset)
        return self.held[offset - self.start : offset - self.start + n]

    def until_zero(self, offset: int, name: str) -> bytes:
        n = 256
        while True:
            part = self.at(offset, min(n, self.size - offset), name)
            if (end := part.find(b"\0")) >= 0:
                return part[: end + 1]
            if offset + n >= self.size:
                raise ValueError(f"{self.path} ends within {name}")
            n *= 4


def walk(items: list, source: _Bytes) -> Iterator[Extent]:
    """All fields of a file in order."""
    at = 0

    def go(items: list, known: dict, turns: tuple) -> Iterator[Extent]:
        nonlocal at
        for item in items:
            if isinstance(item, When):
                if value_of(item.condition, known):
                    yield from go(item.items, known, turns)
            elif isinstance(item, Loop):
                for k in range(int(value_of(item.count, known))):
                    yield from go(item.items, dict(known), (*turns, k))
            elif isinstance(item, Rest):
                n = source.size - at
                if n:
                    yield Extent(Field("u1", item.name), turns, at, (n,), None if n > LARGE else source.at(at, n, item.name))
                at = source.size
            elif item.type == "cstring":
                data = source.until_zero(at, item.name)
                yield Extent(item, turns, at, (), data)
                at += len(data)
            else:
                kind = np.dtype(item.type)
                shape = tuple(int(value_of(x, known)) for x in item.shape)
                n = kind.itemsize * int(np.prod(shape, dtype=np.int64))
                if n < 0 or at + n > source.size:
                    raise ValueError(f"{source.path} ends within {item.name}")
                data = source.at(at, n, item.name) if n <= LARGE else None
                if not shape:
                    known[item.name] = np.frombuffer(data, kind)[0].item()
                yield Extent(item, turns, at, shape, data)
                at += n

    yield from go(items, {}, ())
    if at < source.size:
        raise ValueError(f"{source.path} has {source.size - at} bytes after its last field")


#: The fields of surface files and of surface map files, in the order in which they are stored.
SURFACE = [
    Field("<f4", "version"), Field("<i4", "extended_neighbors"), Field("<u4", "vertices"), Field("<u4", "triangles"), Field("<f4", "center", (3,)),
    Field("<f4", "coordinates", (3, "vertices")), Field("<f4", "normals", (3, "vertices")), Field("<f4", "convex", (4,)), Field("<f4", "concave", (4,)), Field("<u4", "colors", ("vertices",)),
    Loop("vertices", [Field("<u4", "neighbors"), Field("<u4", "neighbor", ("neighbors",))]),
    Field("<u4", "triangle", ("triangles", 3)), Field("<u4", "strips"), When("strips > 0", [Field("<u4", "strip", ("strips",))]), When("version > 3", [Field("cstring", "linked")]), Rest(),
]
SURFACE_MAP = [
    Field("<u2", "version"), Field("<u4", "vertices"), Field("<u2", "maps"), Field("cstring", "surface"),
    Loop("maps", [
        Field("<u4", "type"), When("type == 3", [Field("<u4", "lags"), Field("<u4", "min_lag"), Field("<u4", "max_lag"), Field("<i4", "overlay")]),
        Field("<u4", "cluster_size"), Field("u1", "cluster_check"), Field("<f4", "lower"), Field("<f4", "upper"), When("version > 3", [Field("<u4", "use_above")]),
        Field("<u4", "df1"), Field("<u4", "df2"), When("version > 4", [Field("<u4", "signs")]), Field("<u4", "bonferroni"), Field("u1", "lower_positive", (3,)), Field("u1", "upper_positive", (3,)),
        When("version > 3", [Field("u1", "lower_negative", (3,)), Field("u1", "upper_negative", (3,))]), Field("u1", "use_colors"), When("version > 4", [Field("cstring", "lookup")]),
        Field("<f4", "transparency"), Field("cstring", "name"), Field("<f4", "values", ("vertices",)),
    ]),
    Rest(),
]
LAYOUTS = {"surface": SURFACE, "surface_map": SURFACE_MAP}


def to_json(items: list) -> str:
    """A layout as an option of the data source."""

    def of(x):
        return {"is": type(x).__name__, **{k: ([of(i) for i in getattr(x, k)] if k == "items" else v) for k, v in asdict(x).items()}}

    return json.dumps([of(x) for x in items])


def from_json(text: str) -> list:
    kinds = {c.__name__: c for c in (Field, When, Loop, Rest)}

    def of(x: dict):
        given = {k: ([of(i) for i in v] if k == "items" else tuple(v) if isinstance(v, list) else v) for k, v in x.items() if k != "is"}
        return kinds[x["is"]](**given)

    return [of(x) for x in json.loads(text)]


@dataclass
class _Part(InputPartition):
    path: str
    start: int
    end: int


class LayoutReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        given = options["layout"]
        self.items = LAYOUTS[given] if given in LAYOUTS else from_json(given)
        self.chunk = int(options.get("chunk_bytes", CHUNK_BYTES))

    def partitions(self) -> list[InputPartition]:
        return [_Part(p, s, s + self.chunk) for p in expand(self.path) for s in range(0, max(1, _size(p)), self.chunk)]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        store, plain = _store(part.path)
        rows: list[tuple] = []
        held = 0
        with store.open_input_file(plain) as file:
            for x in walk(self.items, _Bytes(file, file.size(), part.path)):
                if x.offset >= part.end:
                    break
                for first, offset, data in self._own(x, part, file):
                    rows.append(_row(part.path, x, first, offset, data))
                    held += len(data)
                if len(rows) >= 5000 or held > 4 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)

    @staticmethod
    def _own(x: Extent, part: _Part, file) -> Iterator[tuple[int, int, bytes]]:
        """(first element, offset, bytes) of what of a field begins in the part."""
        if x.data is not None:
            if part.start <= x.offset:
                yield 0, x.offset, x.data
            return
        size = np.dtype(x.field.type).itemsize
        n = int(np.prod(x.shape, dtype=np.int64))
        a, b = (min(n, max(0, -(-(edge - x.offset) // size))) for edge in (part.start, part.end))
        step = (1 << 20) // size
        for k in range(a, b, step):
            m = min(step, b - k)
            yield k, x.offset + k * size, file.read_at(m * size, x.offset + k * size)


def _row(path: str, x: Extent, first: int, offset: int, data: bytes) -> tuple:
    numbers = whole = text = None
    if x.field.type == "cstring":
        text = data[:-1].decode("latin-1")
    else:
        values = np.frombuffer(data, x.field.type)
        numbers, whole = (values.astype(np.float64), None) if values.dtype.kind == "f" else (None, values.astype(np.int64))
    return path, offset, x.field.name, list(x.turns), x.field.type, list(x.shape), first, numbers, whole, text


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.string()]
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


class LayoutSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "layout"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LayoutReader(self.options)


def write(df: DataFrame, folder: str) -> DataFrame:
    """(file, bytes) of the files written from rows as read, which may have been changed but for their sizes: each to
    ``folder`` under its own name, its rows in order of offset and streamed, one task a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, done = None, None, []
        for batch in batches:
            for file, offset, kind, numbers, whole, text in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "type", "numbers", "whole", "text"))):
                if file != name:
                    if out:
                        out.close()
                    store, plain = _store(posixpath.join(folder, posixpath.basename(file)))
                    out, name = store.open_output_stream(plain), file
                    done.append([file, 0])
                data = text.encode("latin-1") + b"\0" if kind == "cstring" else np.array(numbers if numbers is not None else whole).astype(kind).tobytes()
                if offset != done[-1][1]:
                    raise ValueError(f"{file}: rows for byte {done[-1][1]} are missing")
                out.write(data)
                done[-1][1] += len(data)
        if out:
            out.close()
        yield pa.RecordBatch.from_pydict({"file": pa.array([x[0] for x in done], pa.string()), "bytes": pa.array([x[1] for x in done], pa.int64())})

    return df.repartition("file").sortWithinPartitions("file", "offset").mapInArrow(run, "file string, bytes long")


def scalars(df: DataFrame) -> DataFrame:
    """(file, turns, fields): the single values and texts of each turn of the loops, by name, as strings."""
    value = F.coalesce("text", F.element_at("whole", 1).cast("string"), F.element_at("numbers", 1).cast("string"))
    return df.where("size(shape) = 0").groupBy("file", "turns").agg(F.map_from_entries(F.collect_list(F.struct("field", value))).alias("fields"))


def elements(df: DataFrame, name: str) -> DataFrame:
    """(file, turns, index, value): a field's numbers, a row each, in the order in which they are stored."""
    values = F.coalesce("numbers", F.col("whole").cast("array<double>"))
    return df.where(F.col("field") == name).select("file", "turns", "first", F.posexplode(values).alias("k", "value")).select("file", "turns", (F.col("first") + F.col("k")).alias("index"), "value")
