"""Recordings as Spark tables: sampled channels (NSx 2.1 to 3.0), event packets (NEV), volumes (NIfTI-1) and text logs.

The two recording formats are Python data sources: the driver reads headers only, and each partition reads its own byte range
of one file. Paths may be local or any URI that pyarrow's file systems open. Writers make one file for each partition.

    spark.dataSource.register(NsxSource)
    spark.read.format("nsx").option("path", "/data/*.ns6").option("channels", "1,2").option("start", 0).option("end", 30000).load()
"""

from __future__ import annotations

import fnmatch
import posixpath
import struct
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: File ids of sampled recordings without and with described channels, and of events; ticks of the clock a
#: second where a file doesn't tell.
NSX_PLAIN, NSX_ID, NSX_GROUP, NEV_ID = b"NEURALSG", b"NEURALCD", b"BRSMPGRP", b"NEURALEV"
CLOCK = 30_000
#: Bytes that are read at once while packets are looked for.
AHEAD = 1 << 20
CHUNK_BYTES = 32 << 20
#: Samples of all channels that are turned at once, so that they stay in the cache.
TURNED = 2048


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def expand(path: str) -> list[str]:
    """Files of a path: itself, a folder's, or those that match a pattern in its last part."""
    store, plain = _store(path)
    prefix = path[: len(path) - len(plain)] if "://" in path else ""
    folder, name = posixpath.split(plain)
    if any(c in name for c in "*?["):
        return sorted(prefix + i.path for i in store.get_file_info(fs.FileSelector(folder)) if i.is_file and fnmatch.fnmatch(posixpath.basename(i.path), name))
    info = store.get_file_info(plain)
    if info.type == fs.FileType.Directory:
        return sorted(prefix + i.path for i in store.get_file_info(fs.FileSelector(plain)) if i.is_file)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return [path]


def _read(path: str, start: int, size: int) -> bytes:
    store, plain = _store(path)
    with store.open_input_file(plain) as f:
        return f.read_at(size, start)


def _size(path: str) -> int:
    store, plain = _store(path)
    return store.get_file_info(plain).size


@dataclass
class Packet:
    """A run of samples without a pause: the time stamp of its first, where its data begin, and its number of samples. A run
    can be of packets of ``each`` samples that follow one another, with ``gap`` bytes between their data."""

    stamp: int
    offset: int
    samples: int
    each: int = 0
    gap: int = 0


@dataclass
class NsxHeader:
    channels: list[int]
    scale: list[float]
    rate: float
    clock: int
    packets: list[Packet]


def nsx_header(path: str) -> NsxHeader:
    """Channels and packets of a file of any of the three kinds. Packets are found in one pass that skips their data, small
    ones through a buffer; those whose time stamps continue the ones before make one run. A file without packets is one
    run, and a mark that is none within a file with packets is an error."""
    head = _read(path, 0, min(314, _size(path)))
    if head[:8] not in (NSX_PLAIN, NSX_ID, NSX_GROUP):
        raise ValueError(f"not a sampled recording: {path}")
    if head[:8] == NSX_PLAIN:
        period, n = struct.unpack_from("<II", head, 24)
        clock, size, wide = CLOCK, 32 + 4 * n, None
        channels, scale = list(struct.unpack(f"<{n}I", _read(path, 32, 4 * n))), [1.0] * n
    else:
        wide = 8 if head[8] >= 3 else 4  # bytes of time stamps
        size, = struct.unpack_from("<I", head, 10)
        period, clock = struct.unpack_from("<II", head, 286)
        n, = struct.unpack_from("<I", head, 310)
        more = _read(path, 314, 66 * n)
        channels, scale = [], []
        for k in range(n):
            at = 66 * k
            channels.append(struct.unpack_from("<H", more, at + 2)[0])
            low, high, analog_low, analog_high = struct.unpack_from("<hhhh", more, at + 22)
            scale.append((analog_high - analog_low) / (high - low) if high != low else 1.0)
    rate = clock / period if period else float(CLOCK)
    return NsxHeader(channels, scale, rate, clock, _packets(path, size, n, wide, clock / rate))


def _packets(path: str, at: int, n: int, wide: int | None, ticks: float) -> list[Packet]:
    """``wide``: bytes of time stamps; None for files that have no packets."""
    out: list[Packet] = []
    store, plain = _store(path)
    with store.open_input_file(plain) as file:
        end, start, held = file.size(), 0, b""
        first, head = at, 5 + (wide or 0)
        while wide and at + head <= end:
            if not start <= at <= start + len(held) - head:
                # far ahead of what is held: only a header is read, since the packets are large
                start, held = at, file.read_at(min(head if at - start > AHEAD else AHEAD, end - at), at)
            mark, stamp, count = struct.unpack_from("<BQI" if wide == 8 else "<BII", held, at - start)
            if mark != 1:
                if at == first:
                    break
                raise ValueError(f"{path}: no packet at byte {at}")
            at += head
            count = min(count, (end - at) // (2 * n)) if n else 0
            last = out[-1] if out else None
            if last and count and (last.each or last.samples) == count and last.offset + _width(last, n) + head == at and round(last.stamp + last.samples * ticks) == stamp:
                last.each, last.gap, last.samples = count, head, last.samples + count
            else:
                out.append(Packet(stamp, at, count))
            at += 2 * n * count
        if not out and n and end > first:
            out.append(Packet(0, first, (end - first) // (2 * n)))
    return out


def _width(p: Packet, n: int) -> int:
    """Bytes from the first sample of a run to its last."""
    return 2 * n * p.samples + (p.gap * (p.samples // p.each - 1) if p.each else 0)


def _samples(path: str, p: Packet, first: int, samples: int, n: int) -> np.ndarray:
    """(samples, n) of a run from sample ``first`` on."""
    if not p.each:
        return np.frombuffer(_read(path, p.offset + 2 * n * first, 2 * n * samples), "<i2").reshape(-1, n)
    a, b = first // p.each, -(-(first + samples) // p.each)
    row = 2 * n * p.each
    data = _read(path, p.offset + a * (row + p.gap), (b - a) * (row + p.gap) - p.gap) + bytes(p.gap)
    x = np.frombuffer(data, np.uint8).reshape(b - a, row + p.gap)[:, :row]
    return np.ascontiguousarray(x).view("<i2").reshape(-1, n)[first - a * p.each :][:samples]


def nsx_bytes(channels: list[int], rate: float, packets: list[tuple[int, np.ndarray]], clock: int = CLOCK, version: tuple[int, int] = (2, 3)) -> bytes:
    """A file of packets (time stamp, samples x channels of int16). Version 2.1 has no packets: their samples follow one
    another; from 3.0 on time stamps have 8 bytes."""
    if version == (2, 1):
        head = NSX_PLAIN + b"tidemark".ljust(16, b"\0") + struct.pack("<II", round(CLOCK / rate), len(channels)) + struct.pack(f"<{len(channels)}I", *channels)
        return head + b"".join(np.ascontiguousarray(x, "<i2").tobytes() for _, x in packets)
    head = (NSX_GROUP if version[0] >= 3 else NSX_ID) + bytes(version) + struct.pack("<I", 314 + 66 * len(channels)) + b"tidemark".ljust(16, b"\0") + bytes(256) + struct.pack("<II", round(clock / rate), clock) + bytes(16) + struct.pack("<I", len(channels))
    for c in channels:
        head += b"CC" + struct.pack("<H", c) + f"ch{c}".encode().ljust(16, b"\0") + bytes(2) + struct.pack("<hhhh", -8191, 8191, -8191, 8191) + b"uV".ljust(16, b"\0") + bytes(20)
    for stamp, x in packets:
        head += struct.pack("<BQI" if version[0] >= 3 else "<BII", 1, stamp, len(x)) + np.ascontiguousarray(x, "<i2").tobytes()
    return head


@dataclass
class Part(InputPartition):
    path: str
    offset: int
    samples: int
    stamp: int
    first: int


@dataclass
class Run(InputPartition):
    """Samples of a run of packets; ``head`` without the packets."""

    path: str
    head: NsxHeader | None
    run: Packet | None
    at: int
    samples: int
    stamp: int
    first: int


class NsxReader(DataSourceReader):
    def __init__(self, options):
        self.files = expand(options["path"])
        self.only = [int(c) for c in options.get("channels", "").split(",") if c.strip()]
        self.start, self.end = int(options.get("start", 0)), int(options.get("end", 1 << 62))
        self.every = int(options.get("skip", 1))
        self.chunk = int(options.get("chunk_bytes", CHUNK_BYTES))

    def partitions(self):
        """Byte ranges of the samples [start, end), each of whole samples; headers are read here alone."""
        out = []
        for path in self.files:
            h, first = nsx_header(path), 0
            head = replace(h, packets=[])
            wide = 2 * max(1, len(h.channels))
            step = max(self.every, self.chunk // wide // self.every * self.every)
            for p in h.packets:
                a, b = max(self.start - first, 0), min(self.end - first, p.samples)
                a += -(a + first - self.start) % self.every if self.every > 1 else 0
                for k in range(a, b, step):
                    out.append(Run(path, head, p, k, min(step, b - k), round(p.stamp + k * h.clock / h.rate), first + k))
                first += p.samples
        return out or [Run("", None, None, 0, 0, 0, 0)]

    def read(self, part):
        if not part.path:
            return
        h = part.head
        n = len(h.channels)
        x = _samples(part.path, part.run, part.at, part.samples, n)[:: self.every]
        own = [k for k, c in enumerate(h.channels) if not self.only or c in self.only]
        if not own:
            return
        turned = np.empty((len(own), len(x)), np.int16)
        for at in range(0, len(x), TURNED):
            turned[:, at : at + TURNED] = x[at : at + TURNED, own].T
        m = len(own)
        rows = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * np.int32(len(x))), pa.array(turned.ravel()))
        same = lambda v, kind: pa.array([v] * m, kind)
        yield pa.RecordBatch.from_arrays([same(part.path, pa.string()), pa.array([h.channels[k] for k in own], pa.int32()), same(part.first, pa.int64()), same(part.stamp, pa.int64()), same(h.rate / self.every, pa.float64()), pa.array([h.scale[k] for k in own], pa.float64()), rows], [*NSX_FIELDS])


NSX_FIELDS = ("path", "channel", "first", "stamp", "rate", "scale", "samples")


class NsxSource(DataSource):
    """(path, channel, first, stamp, rate, scale, samples): a run of samples of one channel. Options: path, channels, start
    and end (sample numbers), skip (every n-th sample), chunk_bytes."""

    @classmethod
    def name(cls):
        return "nsx"

    def schema(self):
        return "path string, channel int, first long, stamp long, rate double, scale double, samples array<smallint>"

    def reader(self, schema: StructType):
        return NsxReader(self.options)

    def writer(self, schema: StructType, overwrite: bool):
        return NsxWriter(self.options)


@dataclass
class Written(WriterCommitMessage):
    path: str


class NsxWriter(DataSourceWriter):
    """A file for each partition that has rows (channel, first, samples): deal rows by recording before writing. Channels of
    one run must have equal lengths."""

    def __init__(self, options):
        self.folder, self.rate, self.clock = options["path"], float(options.get("rate", 30_000)), int(options.get("clock", 30_000))

    def write(self, rows):
        from pyspark import TaskContext

        runs: dict[int, dict[int, np.ndarray]] = {}
        for r in rows:
            runs.setdefault(r.first, {})[r.channel] = np.asarray(r.samples, "<i2")
        if not runs:
            return Written("")
        channels = sorted({c for run in runs.values() for c in run})
        packets = [(round(first * self.clock / self.rate), np.stack([run[c] for c in channels], axis=1)) for first, run in sorted(runs.items())]
        context = TaskContext.get()
        store, plain = _store(self.folder)
        store.create_dir(plain)
        path = posixpath.join(plain, f"part-{context.partitionId():05d}.ns6")
        with store.open_output_stream(f"{path}.{context.taskAttemptId()}") as f:
            f.write(nsx_bytes(channels, self.rate, packets, self.clock))
        store.move(f"{path}.{context.taskAttemptId()}", path)  # an attempt that fails leaves no file of that name
        return Written(path)


def nev_header(path: str) -> tuple[int, int, int]:
    """(where packets begin, bytes of a packet, clock)."""
    head = _read(path, 0, 336)
    if head[:8] != NEV_ID:
        raise ValueError(f"not an event recording: {path}")
    size, width, clock = struct.unpack_from("<III", head, 12)
    return size, width, clock


def nev_bytes(events: list[tuple[int, int]], spikes: list[tuple[int, int, int, np.ndarray]], wave: int = 48, clock: int = 30_000) -> bytes:
    """A file of digital events (stamp, code) and spikes (stamp, channel, unit, waveform), in order of time."""
    width = 8 + 2 * wave
    head = NEV_ID + bytes([2, 3]) + struct.pack("<H", 1) + struct.pack("<IIII", 336, width, clock, clock) + bytes(16) + b"tidemark".ljust(32, b"\0") + bytes(256)
    head += struct.pack("<I", 0)
    head = head[:336].ljust(336, b"\0")
    packets = [(t, struct.pack("<IHBBH", t, 0, 1, 0, code).ljust(width, b"\0")) for t, code in events]
    packets += [(t, struct.pack("<IHBB", t, c, u, 0) + np.asarray(w, "<i2").tobytes()) for t, c, u, w in spikes]
    return head + b"".join(p for _, p in sorted(packets, key=lambda x: x[0]))


class NevReader(DataSourceReader):
    def __init__(self, options):
        self.files, self.chunk = expand(options["path"]), int(options.get("chunk_bytes", CHUNK_BYTES))

    def partitions(self):
        out = []
        for path in self.files:
            begin, width, _ = nev_header(path)
            n = (_size(path) - begin) // width
            step = max(1, self.chunk // width)
            out += [Part(path, begin + k * width, min(step, n - k), 0, k) for k in range(0, n, step)]
        return out or [Part("", 0, 0, 0, 0)]

    def read(self, part):
        if not part.path:
            return
        _, width, _ = nev_header(part.path)
        raw = np.frombuffer(_read(part.path, part.offset, width * part.samples), np.uint8).reshape(-1, width)
        stamp = raw[:, :4].copy().view("<u4").ravel().astype(np.int64)
        packet = raw[:, 4:6].copy().view("<u2").ravel()
        digital = packet == 0
        code = np.where(digital, raw[:, 8:10].copy().view("<u2").ravel(), 0).astype(np.int32)
        waves = raw[:, 8:].copy().view("<i2")
        spike = (packet >= 1) & (packet <= 2048)
        yield pa.RecordBatch.from_arrays(
            [pa.array([part.path] * len(raw), pa.string()), pa.array(stamp), pa.array(packet.astype(np.int32)), pa.array(code, mask=~digital), pa.array(raw[:, 6].astype(np.int32), mask=~spike), pa.array([w if s else None for w, s in zip(waves, spike)], pa.list_(pa.int16()))],
            ["path", "stamp", "packet", "code", "unit", "samples"],
        )


class NevSource(DataSource):
    """(path, stamp, packet, code, unit, samples): packet 0 is a digital event with its code, packets 1 to 2048 are spikes of
    that channel with their unit and waveform. Options: path, chunk_bytes."""

    @classmethod
    def name(cls):
        return "nev"

    def schema(self):
        return "path string, stamp long, packet int, code int, unit int, samples array<smallint>"

    def reader(self, schema: StructType):
        return NevReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NsxSource)
    spark.dataSource.register(NevSource)


def pauses(df: DataFrame, clock: float) -> DataFrame:
    """Chunks of nsx with ``segment``: a new one begins where a chunk doesn't follow the last one in time."""
    from pyspark.sql import Window

    w = Window.partitionBy("path", "channel").orderBy("first")
    after = F.lag(F.col("stamp") + F.size("samples") * (clock / F.col("rate"))).over(w)
    new = F.when(F.abs(F.col("stamp") - after) > clock / F.col("rate"), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("segment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


#: NIfTI-1 data types.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}


def nifti_bytes(volume: np.ndarray, slope: float = 1.0, inter: float = 0.0) -> bytes:
    code = next(k for k, v in NIFTI_TYPES.items() if v == volume.dtype.str[1:])
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, volume.ndim, *volume.shape, *([1] * (7 - volume.ndim)))
    struct.pack_into("<hh", head, 70, code, volume.dtype.itemsize * 8)
    struct.pack_into("<fff", head, 108, 352.0, slope, inter)
    head[344:348] = b"n+1\0"
    return bytes(head) + volume.tobytes(order="F")


def nifti(spark: SparkSession, path: str) -> DataFrame:
    """(path, t, z, plane): each plane of each volume as an array of doubles, x fastest. Files come through Spark's own
    reader, one at a task; planes are its rows, so voxels are exploded only where they are needed."""

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                order = "<" if struct.unpack_from("<i", data, 0)[0] == 348 else ">"
                dims = struct.unpack_from(order + "8h", data, 40)
                code, = struct.unpack_from(order + "h", data, 70)
                offset, slope, inter = struct.unpack_from(order + "fff", data, 108)
                shape = tuple(max(1, d) for d in dims[1:5])[: max(3, dims[0])] + (1,) * max(0, 4 - max(3, dims[0]))
                x = np.frombuffer(data, order + NIFTI_TYPES[code], int(np.prod(shape)), int(offset)).reshape(shape, order="F")
                for t in range(shape[3]):
                    planes = x[:, :, :, t].astype(float) * (slope or 1.0) + (inter if slope else 0.0)
                    rows = [planes[:, :, z].ravel(order="F") for z in range(shape[2])]
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array([t] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([shape[0]] * n, pa.int32()), pa.array(rows, pa.list_(pa.float64()))], ["path", "t", "z", "width", "plane"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, t int, z int, width int, plane array<double>")


def voxels(planes: DataFrame) -> DataFrame:
    """(path, t, x, y, z, v)."""
    long = planes.select("path", "t", "z", "width", F.posexplode("plane").alias("k", "v"))
    return long.select("path", "t", (F.col("k") % F.col("width")).alias("x"), F.floor(F.col("k") / F.col("width")).cast("int").alias("y"), "z", "v")


def key_values(lines: Column) -> Column:
    """name = value lines of a text as a map; later names win, lines without = are left out."""
    pairs = F.filter(F.split(lines, "\r?\n"), lambda x: F.instr(x, "=") > 0)
    entries = F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("key"), F.trim(F.substr(x, F.instr(x, "=") + 1)).alias("value")))
    latest = F.filter(entries, lambda x, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(latest)


def condition_names(lines: DataFrame, column: str = "value") -> DataFrame:
    """(id, name): the first and the last token of each line that begins with a number."""
    tokens = F.split(F.trim(column), "\\s+")
    return lines.where(F.col(column).rlike("^\\s*[0-9]+\\s")).select(F.element_at(tokens, 1).cast("int").alias("id"), F.element_at(tokens, -1).alias("name"))


def run_log(lines: DataFrame, columns: list[str], column: str = "value") -> DataFrame:
    """The rows of a log, values separated by ; in the given order; lines with another number of values are the header's."""
    parts = F.split(column, ";")
    return lines.where(F.size(parts) == len(columns)).select(*(F.trim(parts[k]).alias(c) for k, c in enumerate(columns)))


def by_channel(df: DataFrame, path: str, keys: list[str], mode: str = "overwrite") -> None:
    """Parquet in folders by the keys, so that a later read of one channel prunes the rest."""
    df.repartition(*keys).sortWithinPartitions(*keys).write.mode(mode).partitionBy(*keys).parquet(path)
