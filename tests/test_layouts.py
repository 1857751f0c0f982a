"""Declared layouts: values against a plain reading with struct, files written back equal, any chunk size."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.sources import layouts
from tidemark.sources.layouts import Field, Loop, Rest, When


def surface_bytes(rng, vertices=2500, triangles=1200, version=4.0, rest=b"tail"):
    near = [rng.integers(0, vertices, rng.integers(0, 9)).astype("<u4") for _ in range(vertices)]
    values = {k: rng.normal(size=n).astype("<f4") for k, n in (("coordinates", 3 * vertices), ("normals", 3 * vertices))}
    out = struct.pack("<fiII3f", version, 0, vertices, triangles, 1, 2, 3) + values["coordinates"].tobytes() + values["normals"].tobytes() + struct.pack("<8f", *range(8))
    out += rng.integers(0, 99, vertices).astype("<u4").tobytes() + b"".join(struct.pack("<I", len(x)) + x.tobytes() for x in near)
    out += rng.integers(0, vertices, 3 * triangles).astype("<u4").tobytes() + struct.pack("<I2I", 2, 7, 8) + (b"other.srf\0" if version > 3 else b"") + rest
    return out, values, near


def map_bytes(rng, vertices=3000, version=5, kinds=(1, 3, 2)):
    out, values = struct.pack("<HIH", version, vertices, len(kinds)) + b"mesh.srf\0", []
    for k, kind in enumerate(kinds):
        out += struct.pack("<I", kind) + (struct.pack("<IIIi", 9, 1, 8, -1) if kind == 3 else b"") + struct.pack("<IBff", 50, 1, 2.5, 8.0) + (struct.pack("<I", 0) if version > 3 else b"")
        out += struct.pack("<II", 20, 0) + (struct.pack("<I", 3) if version > 4 else b"") + struct.pack("<I", 77) + bytes(range(6)) + (bytes(range(6)) if version > 3 else b"") + b"\1" + (b"table\xe9\0" if version > 4 else b"")
        values.append(rng.normal(size=vertices).astype("<f4"))
        out += struct.pack("<f", 1.0) + f"map {k}".encode() + b"\0" + values[-1].tobytes()
    return out, values


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    spark.dataSource.register(layouts.LayoutSource)
    folder, rng = tmp_path_factory.mktemp("layouts"), np.random.default_rng(1)
    made = {"a.srf": surface_bytes(rng), "b.srf": surface_bytes(rng, 30, 9, 3.0, b""), "a.smp": map_bytes(rng), "b.smp": map_bytes(rng, 40, 2, (3,)), "none.smp": (struct.pack("<HIH", 5, 10, 0) + b"\0", [])}
    for name, x in made.items():
        (folder / name).write_bytes(x[0])
    return folder, made


def load(spark, path, layout, chunk=layouts.CHUNK_BYTES):
    return spark.read.format("layout").option("path", str(path)).option("layout", layout).option("chunk_bytes", chunk).load()


def values(df, file, name, turns=()):
    rows = layouts.elements(df, name).where(F.col("file").endswith(file)).orderBy("index").collect()
    return np.array([r.value for r in rows if tuple(r.turns) == turns])


@pytest.mark.parametrize("chunk", [layouts.CHUNK_BYTES, 5000, 999])
def test_values_at_any_chunk_size(spark, files, chunk):
    folder, made = files
    df = load(spark, folder / "*.smp", "surface_map", chunk).cache()
    for name in ("a.smp", "b.smp"):
        for k, want in enumerate(made[name][1]):
            assert (values(df, name, "values", (k,)).astype("<f4") == want).all()
    told = {(r.file[-5:], tuple(r.turns)): r.fields for r in layouts.scalars(df).collect()}
    assert told["a.smp", ()] == {"version": "5", "vertices": "3000", "maps": "3", "surface": "mesh.srf"}
    assert told["a.smp", (1,)]["overlay"] == "-1" and told["a.smp", (1,)]["lookup"] == "tableé" and "overlay" not in told["a.smp", (0,)] and told["a.smp", (2,)]["name"] == "map 2"
    assert "use_above" not in told["b.smp", (0,)] and told["e.smp", ()]["maps"] == "0"
    df.unpersist()


def test_surfaces_with_loops_of_any_length(spark, files):
    folder, made = files
    df = load(spark, folder / "*.srf", "surface", 20_000).cache()
    _, want, near = made["a.srf"]
    assert (values(df, "a.srf", "coordinates").astype("<f4") == want["coordinates"]).all() and (values(df, "a.srf", "normals").astype("<f4") == want["normals"]).all()
    got = {r.turns[0]: r.whole for r in df.where("field = 'neighbor' and file like '%a.srf'").collect()}
    assert len(got) == len(near) and all(got[k] == x.tolist() for k, x in enumerate(near))
    assert values(df, "a.srf", "rest").astype("u1").tobytes() == b"tail" and df.where("field = 'linked'").count() == 1
    df.unpersist()


@pytest.mark.parametrize("layout,ending", [("surface", "srf"), ("surface_map", "smp")])
def test_written_back_equal(spark, files, tmp_path, layout, ending):
    folder, made = files
    done = {r.file.rsplit("/", 1)[1]: r.bytes for r in layouts.write(load(spark, folder / f"*.{ending}", layout, 7000), str(tmp_path)).collect()}
    want = {k: v[0] for k, v in made.items() if k.endswith(ending)}
    assert done == {k: len(v) for k, v in want.items()} and all((tmp_path / k).read_bytes() == v for k, v in want.items())


def test_changed_values_are_written(spark, files, tmp_path):
    folder, made = files
    df = load(spark, folder / "a.smp", "surface_map").withColumn("numbers", F.when(F.col("field") == "values", F.transform("numbers", lambda v: v * 2)).otherwise(F.col("numbers")))
    layouts.write(df, str(tmp_path)).collect()
    got = load(spark, tmp_path / "a.smp", "surface_map")
    assert (values(got, "a.smp", "values", (2,)).astype("<f4") == made["a.smp"][1][2] * 2).all()


def test_own_layouts_nested_loops_and_errors(spark, tmp_path):
    items = [Field("u1", "n"), Loop("n", [Field(">i2", "m"), Loop("m", [When("m % 2 == 1 and not n < 2", [Field("<f8", "x", ("m - 1 + 1", 2))])])])]
    assert layouts.from_json(layouts.to_json(items)) == items
    data = b"\2" + struct.pack(">h", 1) + struct.pack("<2d", 1.5, 2.5) + struct.pack(">h", 2)
    (tmp_path / "x.bin").write_bytes(data)
    df = load(spark, tmp_path / "x.bin", layouts.to_json(items))
    assert [(r.field, r.turns, r.numbers or r.whole) for r in df.orderBy("offset").collect()] == [("n", [], [2]), ("m", [0], [1]), ("x", [0, 0], [1.5, 2.5]), ("m", [1], [2])]
    for cut, said in ((data[:-1], "ends within m"), (data + b"z", "1 bytes after"), (b"", "ends within n")):
        (tmp_path / "x.bin").write_bytes(cut)
        with pytest.raises(Exception, match=said):
            load(spark, tmp_path / "x.bin", layouts.to_json(items)).collect()
    (tmp_path / "x.bin").write_bytes(data + b"z")
    assert load(spark, tmp_path / "x.bin", layouts.to_json([*items, Rest("more")])).where("field = 'more'").first().whole == [ord("z")]
    with pytest.raises(ValueError, match="not an expression"):
        layouts.value_of("__import__('os')", {})
