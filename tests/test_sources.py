"""Readers and writers by round trips over synthetic files, and streams against batches."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.sources import recordings
from tidemark.streaming import events as streams


@pytest.fixture(scope="module")
def nsx(spark, tmp_path_factory):
    recordings.register(spark)
    folder = tmp_path_factory.mktemp("nsx")
    rng = np.random.default_rng(1)
    packets = [(0, rng.integers(-99, 99, (1000, 3)).astype(np.int16)), (90_000, rng.integers(-99, 99, (500, 3)).astype(np.int16))]
    (folder / "a.ns2").write_bytes(recordings.nsx_bytes([1, 5, 7], 1000.0, packets))
    return folder, packets


def joined(rows, channel):
    return np.concatenate([r.samples for r in sorted((r for r in rows if r.channel == channel), key=lambda r: r.first)])


def test_samples_come_back(spark, nsx):
    folder, packets = nsx
    whole = np.concatenate([x for _, x in packets])
    for size in (32 << 20, 600):
        rows = spark.read.format("nsx").option("path", f"{folder}/*.ns2").option("chunk_bytes", size).load().collect()
        for k, c in enumerate((1, 5, 7)):
            assert joined(rows, c).tolist() == whole[:, k].tolist()
    assert {r.stamp for r in rows if r["first"] == 1000} == {90_000} and rows[0].rate == 1000.0


@pytest.mark.parametrize("version", [(2, 1), (2, 2), (3, 0)])
def test_all_kinds_of_files(spark, nsx, tmp_path, version):
    """Also packets of one or few samples each, which are read as runs while their stamps go on."""
    rng = np.random.default_rng(2)
    x = rng.integers(-999, 999, (4000, 3)).astype(np.int16)
    cut = [(30 * k, x[k : k + 1]) for k in range(1500)] + [(30 * k + 7_000_000, x[k : k + 5]) for k in range(1500, 3000, 5)] + [(2**31, x[3000:])]
    (tmp_path / "a.ns2").write_bytes(recordings.nsx_bytes([4, 5, 9], 1000.0, cut, version=version))
    head = recordings.nsx_header(str(tmp_path / "a.ns2"))
    assert head.channels == [4, 5, 9] and head.rate == 1000.0
    assert [(p.stamp, p.samples) for p in head.packets] == ([(0, 4000)] if version == (2, 1) else [(0, 1500), (7_045_000, 1500), (2**31, 1000)])
    for size in (32 << 20, 700):
        rows = spark.read.format("nsx").option("path", f"{tmp_path}/a.ns2").option("chunk_bytes", size).load().collect()
        assert all(joined(rows, c).tolist() == x[:, k].tolist() for k, c in enumerate((4, 5, 9)))
    rows = spark.read.format("nsx").option("path", f"{tmp_path}/a.ns2").option("start", 1490).option("end", 2003).option("skip", 7).load().collect()
    assert joined(rows, 5).tolist() == x[1490:2003:7, 1].tolist()


def test_what_is_no_packet_is_an_error(nsx, tmp_path):
    data = recordings.nsx_bytes([1], 1000.0, [(0, np.zeros((5, 1), np.int16)), (9, np.zeros((5, 1), np.int16))])
    second = len(data) - 10 - 9
    (tmp_path / "b.ns2").write_bytes(data[:second] + b"\7" + data[second + 1 :])
    with pytest.raises(ValueError, match=f"no packet at byte {second}"):
        recordings.nsx_header(str(tmp_path / "b.ns2"))
    (tmp_path / "c.ns2").write_bytes(data[: second - 19] + bytes(12))  # no packet at all: six samples
    assert [(p.stamp, p.samples) for p in recordings.nsx_header(str(tmp_path / "c.ns2")).packets] == [(0, 6)]
    (tmp_path / "d.ns2").write_bytes(b"else")
    with pytest.raises(ValueError, match="not a sampled recording"):
        recordings.nsx_header(str(tmp_path / "d.ns2"))


def test_channels_ranges_and_steps(spark, nsx):
    folder, packets = nsx
    whole = np.concatenate([x for _, x in packets])
    read = lambda **o: spark.read.format("nsx").options(path=str(folder), **{k: str(v) for k, v in o.items()}).load().collect()
    rows = read(channels="5", start=300, end=1200, chunk_bytes=600)
    assert {r.channel for r in rows} == {5} and joined(rows, 5).tolist() == whole[300:1200, 1].tolist()
    assert joined(read(channels="1", skip=10, chunk_bytes=600), 1).tolist() == whole[::10, 0].tolist()
    assert read(start=5000) == []


def test_pauses(spark, nsx):
    df = spark.read.format("nsx").option("path", str(nsx[0])).option("chunk_bytes", 600).load()
    got = recordings.pauses(df, 30_000).groupBy("channel").agg(F.countDistinct("segment").alias("n")).collect()
    assert {r.n for r in got} == {2}


def test_written_samples_come_back(spark, tmp_path):
    recordings.register(spark)
    df = spark.createDataFrame([(c, 0, [c, 2, -3]) for c in (1, 2)], "channel int, first long, samples array<smallint>").coalesce(1)
    df.write.format("nsx").mode("append").option("path", str(tmp_path / "out")).option("rate", "1000").save()
    rows = spark.read.format("nsx").option("path", str(tmp_path / "out")).load().collect()
    assert sorted((r.channel, r.samples) for r in rows) == [(1, [1, 2, -3]), (2, [2, 2, -3])]


def test_not_a_recording(spark, tmp_path):
    (tmp_path / "x.ns2").write_bytes(b"something else" * 50)
    with pytest.raises(Exception, match="not a sampled recording"):
        spark.read.format("nsx").option("path", str(tmp_path / "x.ns2")).load().collect()


def test_events_come_back(spark, tmp_path):
    recordings.register(spark)
    (tmp_path / "a.nev").write_bytes(recordings.nev_bytes([(10, 500), (40, 7)], [(20, 3, 1, np.arange(48)), (30, 9, 0, -np.arange(48))]))
    for size in (32 << 20, 104):
        rows = spark.read.format("nev").option("path", str(tmp_path)).option("chunk_bytes", size).load().orderBy("stamp").collect()
        assert [(r.stamp, r.packet, r.code, r.unit) for r in rows] == [(10, 0, 500, None), (20, 3, None, 1), (30, 9, None, 0), (40, 0, 7, None)]
        assert rows[1].samples == list(range(48)) and rows[0].samples is None


def test_volumes(spark, tmp_path):
    v = np.arange(2 * 3 * 4, dtype=np.int16).reshape(2, 3, 4)
    (tmp_path / "v.nii").write_bytes(recordings.nifti_bytes(v, 2.0, 1.0))
    got = {(r.x, r.y, r.z): r.v for r in recordings.voxels(recordings.nifti(spark, str(tmp_path))).collect()}
    assert got == {(x, y, z): 2.0 * v[x, y, z] + 1 for x in range(2) for y in range(3) for z in range(4)}


def test_texts(spark, tmp_path):
    df = spark.createDataFrame([("a = 1\nb=x=y\nnothing\na=2",), (None,)], "t string")
    got = [r.m for r in df.select(recordings.key_values(F.col("t")).alias("m")).collect()]
    assert got[0] == {"a": "2", "b": "x=y"} and got[1] is None
    lines = spark.createDataFrame([("1 some file.png",), ("header",), ("22 x y z.bmp",), ("a; b ;c",)], "value string")
    assert [(r.id, r.name) for r in recordings.condition_names(lines).orderBy("id").collect()] == [(1, "file.png"), (22, "z.bmp")]
    assert [tuple(r) for r in recordings.run_log(lines, ["p", "q", "r"]).collect()] == [("a", "b", "c")]
    recordings.by_channel(spark.createDataFrame([(1, 2.0), (2, 3.0)], "ch int, v double"), str(tmp_path / "p"), ["ch"])
    assert spark.read.parquet(str(tmp_path / "p")).where("ch = 2").first().v == 3.0


def stream(spark, tmp_path, name, batches, schema, build, mode="append"):
    """What a stream makes of the batches, one file at a time."""
    folder = tmp_path / name
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / f"b{k}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "*"))
    q = build(source).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


ROWS = [[("a", 0, 1), ("a", 5, 9), ("b", 3, 1)], [("a", 6, 7), ("a", 30, 1), ("b", 4, 8)], [("a", 31, 7), ("a", 50, 2)]]


def test_stateful_streams_give_what_batches_give(spark, tmp_path):
    schema = "k string, t long, code int"
    got = stream(spark, tmp_path, "refractory", ROWS, schema, lambda s: streams.refractory(s, "t", ["k"], 2))
    assert sorted((r.k, r.t) for r in got) == [("a", 0), ("a", 5), ("a", 30), ("a", 50), ("b", 3)]
    got = stream(spark, tmp_path, "segments", ROWS, schema, lambda s: streams.segments(s, "t", "code", ["k"], 1))
    assert sorted((r.k, r.t, r.trial) for r in got) == [("a", 5, 1), ("a", 6, 1), ("a", 31, 2), ("a", 50, 2), ("b", 4, 1)]
    got = stream(spark, tmp_path, "stretches", ROWS, schema, lambda s: streams.stretches(s, "t", ["k"], 10))
    assert sorted((r.k, r.t, r.stretch) for r in got) == [("a", 0, 0), ("a", 5, 0), ("a", 6, 0), ("a", 30, 1), ("a", 31, 1), ("a", 50, 2), ("b", 3, 0), ("b", 4, 0)]


def test_windowed_streams(spark, tmp_path):
    t = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    rows = [[("a", t(1)), ("a", t(2))], [("a", t(6)), ("b", t(7))]]
    schema = "k string, at timestamp"
    got = stream(spark, tmp_path, "fixed", rows, schema, lambda s: streams.windowed_counts(s, "at", ["k"], "5 minutes"), "complete")
    assert sorted((r.k, r.n) for r in got) == [("a", 1), ("a", 2), ("b", 1)]
    got = stream(spark, tmp_path, "sessions", rows, schema, lambda s: streams.session_counts(s, "at", ["k"], "3 minutes"), "complete")
    assert sorted((r.k, r.n) for r in got) == [("a", 1), ("a", 2), ("b", 1)]
