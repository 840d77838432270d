"""Stores written and read back: storage order, flat and ragged arrays, levels, appends, plates, streams and the chunk source."""

import dataclasses
import json
import os

import numpy as np
import pytest

from gridloom.operators import blocks
from gridloom.plans.layout import ArraySpec, Dimension as D, Layout, levels
from gridloom.settings import Acquisition, FieldOfView, Plate, S3Settings, StoreSettings, Well
from gridloom.sources import chunks, store
from gridloom.streaming.writer import GridStore, StreamError, parse_json


def spec(*dims, key="a", **more):
    return ArraySpec(key, more.pop("dtype", "uint16"), tuple(D(n, k, *s) for n, k, *s in dims), **more)


def frames_of(spark, images):
    return spark.createDataFrame([(i, bytearray(np.ascontiguousarray(im).tobytes())) for i, im in enumerate(images)], "frame_id long, data binary")


def read_back(spark, root, key):
    """The whole stored array, by its own metadata."""
    s, shape = chunks.stored_spec(f"{root}/{key}".rstrip("/"))
    s = dataclasses.replace(s, key=key)
    dims = s.dims
    out = np.zeros([-(-n // (d.chunk * d.shard)) * d.chunk * d.shard for n, d in zip(shape, dims, strict=True)], np.dtype(s.dtype).newbyteorder("<"))
    slots = int(np.prod([d.shard for d in dims]))
    top = f"{root}/{key}".rstrip("/") + "/c"
    for folder, _, names in os.walk(top):
        for name in names:
            shard = [int(x) for x in os.path.relpath(f"{folder}/{name}", top).split("/")]
            with open(f"{folder}/{name}", "rb") as f:
                got = store.read_shard(f.read(), slots)
            for slot, payload in got.items():
                at, k = [], slot
                for d in reversed(dims):
                    k, x = divmod(k, d.shard)
                    at.insert(0, x)
                place = tuple(slice((sh * d.shard + a) * d.chunk, (sh * d.shard + a + 1) * d.chunk) for sh, d, a in zip(shard, dims, at, strict=True))
                out[place] = np.frombuffer(store.decoder(s)(payload), out.dtype).reshape([d.chunk for d in dims])
    return out[tuple(slice(0, n) for n in shape)]


@pytest.mark.parametrize("order", [None, (0, 2, 1, 3, 4), (0, 1, 2, 4, 3), (0, 2, 1, 4, 3)])
def test_storage_orders(spark, tmp_path, order):
    s = spec(("t", "time", 0, 1, 1), ("c", "channel", 3, 1, 2), ("z", "space", 4, 3, 1), ("y", "space", 9, 4, 2), ("x", "space", 7, 4, 1), order=order, dtype="int32")
    images = np.random.default_rng(0).integers(-99, 99, (24, 9, 7)).astype("<i4")
    store.write_array(frames_of(spark, images), s, str(tmp_path)).collect()
    store.commit(s, str(tmp_path), 24)
    want = images.reshape(2, 3, 4, 9, 7)
    assert (read_back(spark, str(tmp_path), "a") == (want if order is None else want.transpose(order))).all()


def test_flat_and_ragged_arrays(spark, tmp_path):
    flat = spec(("y", "space", 64, 32, 1), ("x", "space", 100, 64, 1), key="flat")
    image = np.random.default_rng(1).integers(0, 999, (64, 100)).astype("<u2")
    store.write_array(frames_of(spark, [image]), flat, str(tmp_path)).collect()
    store.commit(flat, str(tmp_path), 1)
    assert sorted(os.listdir(tmp_path / "flat/c")) == ["0", "1"] and (read_back(spark, str(tmp_path), "flat") == image).all()
    long = spec(("t", "time", 0, 1, 16), ("y", "space", 5, 5, 1), ("x", "space", 5, 5, 1), key="long", dtype="uint8")
    images = np.full((17, 5, 5), 7, "u1")
    sizes = {r.path: r.bytes for r in store.write_array(frames_of(spark, images), long, str(tmp_path)).collect()}
    assert sizes == {"c/0/0/0": 16 * 25 + 16 * 16 + 4, "c/1/0/0": 25 + 16 * 16 + 4}


def test_array_metadata():
    s = spec(("z", "space", 2, 1, 2), ("y", "space", 64, 16, 2), ("x", "space", 64, 16, 2), compressor="zstd", level=3, attributes={"k": 1})
    doc = store.array_metadata(s, 2)
    assert doc["shape"] == [2, 64, 64] and doc["chunk_grid"]["configuration"]["chunk_shape"] == [2, 32, 32] and doc["attributes"] == {"k": 1}
    inner = doc["codecs"][0]["configuration"]
    assert inner["chunk_shape"] == [1, 16, 16] and [c["name"] for c in inner["codecs"]] == ["bytes", "zstd"] and inner["index_location"] == "end"
    blosc = store.codec_documents(dataclasses.replace(s, compressor="blosc-lz4", shuffle=1))[1]
    assert blosc["configuration"] == {"cname": "lz4", "clevel": 3, "shuffle": "shuffle", "typesize": 2, "blocksize": 0}


def test_multiscale_metadata():
    s = spec(("t", "time", 5, 5, 1), ("z", "space", 1, 1, 1, None, 1.36), ("y", "space", 48, 16, 2, "micrometer", 0.85), ("x", "space", 64, 16, 2, None, 0.85), method="mean")
    m = store.multiscale_metadata(s)["attributes"]["ome"]["multiscales"][0]
    assert [d["coordinateTransformations"][0]["scale"] for d in m["datasets"]] == [[1.0, 1.36, 0.85, 0.85], [1.0, 1.36, 1.7, 1.7], [1.0, 1.36, 3.4, 3.4]]
    assert m["type"] == "local_mean" and m["metadata"]["kwargs"]["factors"] == "(2, 2)" and m["axes"][2] == {"name": "y", "type": "space", "unit": "micrometer"}
    assert "type" not in store.multiscale_metadata(dataclasses.replace(s, method=None))["attributes"]["ome"]["multiscales"][0]


def pooled_by_hand(volume, method):
    """One level of a (z, y, x) volume, one pixel after the other."""
    how = {"mean": lambda v: int(sum(map(int, v)) / len(v)), "min": min, "max": max, "decimate": lambda v: v[0]}[method]
    z, y, x = volume.shape
    flat = np.array([[[how([p[min(2 * i + a, y - 1), min(2 * j + b, x - 1)] for a in (0, 1) for b in (0, 1)]) for j in range(-(-x // 2))] for i in range(-(-y // 2))] for p in volume])
    return np.array([[[how([flat[2 * k, i, j], flat[2 * k + 1, i, j]]) if 2 * k + 1 < z else flat[2 * k, i, j] for j in range(flat.shape[2])] for i in range(flat.shape[1])] for k in range(-(-z // 2))])


@pytest.mark.parametrize("method", ["decimate", "mean", "min", "max"])
def test_pyramid_of_blocks(spark, tmp_path, method):
    s = spec(("t", "time", 0, 1, 1), ("z", "space", 3, 1, 1), ("y", "space", 9, 3, 1), ("x", "space", 7, 2, 1), method=method, dtype="int16")
    images = np.random.default_rng(2).integers(-500, 500, (6, 9, 7)).astype("<i2")
    store.write_pyramid(frames_of(spark, images), s, str(tmp_path))
    want = images.reshape(2, 3, 9, 7)
    for k in range(len(levels(s))):
        assert (read_back(spark, str(tmp_path), f"a/{k}") == want).all(), k
        want = np.stack([pooled_by_hand(v, method) for v in want])
    assert k == 2 and json.loads((tmp_path / "a/zarr.json").read_text())["node_type"] == "group"


def test_pooling_rules():
    nan = np.float32("nan")
    a, b = np.array([nan, 1, 3], "<f4"), np.array([1, nan, 2], "<f4")
    assert np.isnan(blocks.pooled([a, b], "min")[0]) and blocks.pooled([a, b], "min")[1:].tolist() == [1, 2] and blocks.pooled([a, b], "max")[2] == 3
    assert blocks.pooled([np.array([-3], "i1"), np.array([-4], "i1")], "mean").tolist() == [-3]
    big = np.array([2**64 - 1], "u8")
    assert blocks.pooled([big, big], "mean")[0] == big[0] and blocks.pooled([np.array([1.0], "f4"), np.array([2.5], "f4")], "mean").tolist() == [1.75]
    with_edge = blocks.pool_plane(np.arange(15, dtype="u1").reshape(3, 5), "mean")
    assert with_edge.tolist() == [[3, 5, 6], [10, 12, 14]]


def test_trailing_half_pair_is_dropped(spark):
    fine = spec(("t", "time", 0, 1, 1), ("z", "space", 4, 1, 1), ("y", "space", 4, 4, 1), ("x", "space", 4, 4, 1), method="mean")
    coarse = levels(fine)[1]
    got = blocks.next_level(frames_of(spark, np.full((7, 4, 4), 5, "<u2")), fine, coarse).collect()
    assert sorted(r.frame_id for r in got) == [0, 1, 2]


def settings(path, *arrays, **more):
    return StoreSettings(str(path / "s"), tuple(arrays), **more)


def test_appends_of_any_size(spark, tmp_path):
    s = spec(("t", "time", 0, 1, 1), ("y", "space", 8, 8, 1), ("x", "space", 6, 6, 1), key="", dtype="uint8")
    data = np.arange(5 * 48, dtype="u1").reshape(5, 8, 6)
    with GridStore(spark, settings(tmp_path, s)) as g:
        raw = data.tobytes()
        for at in range(0, 100, 12):
            g.append(raw[at : min(at + 12, 100)])
        g.append(raw[100:192])
        g.append(raw[192:199])
        assert g.residues() == {"": 7} and g.current_memory_usage() > 0 and g.is_active
    assert not g.is_active and g.close() is None
    assert (read_back(spark, str(tmp_path / "s"), "") == data[:4]).all() and not (tmp_path / "s/.staged").exists()


def test_strided_arrays_types_and_skips(spark, tmp_path):
    s = spec(("t", "time", 0, 1, 2), ("z", "space", 2, 1, 1), ("y", "space", 4, 4, 1), ("x", "space", 6, 3, 1), key="/p//q/", dtype="int32")
    whole = np.arange(3 * 2 * 6 * 4, dtype="<i4").reshape(3, 2, 6, 4)
    with GridStore(spark, settings(tmp_path, s)) as g:
        g.append(whole.transpose(0, 1, 3, 2)[:2], "p/q")
        g.skip(96, "p/q")
        g.append(whole[2, 1].T, "p/q")
        with pytest.raises(ValueError):
            g.append(np.zeros(3, complex), "p/q")
        with pytest.raises(KeyError):
            g.append(b"", "other")
        g.write_custom_metadata('{"a": 1 /* one */, // two\n "b": "//x"}')
        g.write_custom_metadata("[1]", "x/y")
        g.write_custom_metadata("2", "a")
        with pytest.raises(ValueError):
            g.write_custom_metadata("{}", "ome")
    want = whole.transpose(0, 1, 3, 2).copy()
    want[2, 0] = 0
    assert (read_back(spark, str(tmp_path / "s"), "p/q") == want).all()
    doc = json.loads((tmp_path / "s/p/q/zarr.json").read_text())
    assert doc["attributes"] == {"a": 2, "b": "//x", "x/y": [1]} and doc["shape"] == [3, 2, 4, 6]
    assert json.loads((tmp_path / "s/p/zarr.json").read_text())["node_type"] == json.loads((tmp_path / "s/zarr.json").read_text())["node_type"] == "group"


def test_overflow_is_refused_whole(spark, tmp_path):
    s = spec(("z", "space", 2, 1, 1), ("y", "space", 4, 4, 1), ("x", "space", 4, 4, 1), dtype="uint8")
    with GridStore(spark, settings(tmp_path, s)) as g:
        g.append(bytes(range(16)) * 1)
        with pytest.raises(ValueError):
            g.append(bytes(17))
        g.append(b"\1" * 16)
    assert read_back(spark, str(tmp_path / "s"), "a").sum() == 120 + 16


def test_failure_ends_the_store(spark, tmp_path, monkeypatch):
    s = spec(("z", "space", 0, 1, 1), ("y", "space", 4, 4, 1), ("x", "space", 4, 4, 1), dtype="uint8")
    g = GridStore(spark, settings(tmp_path, s))
    monkeypatch.setattr(g.arrays["a"], "take", lambda data: (_ for _ in ()).throw(RuntimeError("disk")))
    with pytest.raises(RuntimeError):
        g.append(b"x")
    with pytest.raises(StreamError):
        g.append(b"x")
    with pytest.raises(StreamError):
        g.close()


def test_rollover_writes_full_layers(spark, tmp_path):
    s = spec(("t", "time", 0, 2, 2), ("y", "space", 4, 4, 1), ("x", "space", 4, 4, 1), dtype="uint8")
    g = GridStore(spark, settings(tmp_path, s))
    g.arrays["a"].most = 3
    g.append(np.ones((7, 4, 4), "u1"))
    assert (tmp_path / "s/a/c/0/0/0").exists() and not (tmp_path / "s/a/c/1").exists()
    assert json.loads((tmp_path / "s/a/zarr.json").read_text())["shape"] == [4, 4, 4]
    g.close()
    assert (tmp_path / "s/a/c/1/0/0").exists() and json.loads((tmp_path / "s/a/zarr.json").read_text())["shape"] == [7, 4, 4]


def test_creation_modes(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/old").write_text("x")
    store.create_store(str(tmp_path / "s"), "append")
    assert (tmp_path / "s/old").exists()
    with pytest.raises(FileExistsError):
        store.create_store(str(tmp_path / "s"))
    store.create_store(str(tmp_path / "s"), "overwrite")
    assert not (tmp_path / "s/old").exists()
    (tmp_path / "f").write_text("x")
    with pytest.raises(ValueError):
        store.create_store(str(tmp_path / "f"), "append")


def image(**more):
    return ArraySpec("", "uint8", (D("z", "space", 0, 1, 1), D("y", "space", 4, 4, 1), D("x", "space", 4, 4, 1)), **more)


def plate(**more):
    given = {"path": "plate", "name": "p", "row_names": tuple("ABCD"), "column_names": tuple("1234567"), "acquisitions": (Acquisition(0, "first", start_time=5), Acquisition(1, "second", None, 6, 9))}
    given["wells"] = (Well("C", "5", (FieldOfView("fov1", image(), 0), FieldOfView("fov2", image(), 1))), Well("D", "7", (FieldOfView("fov1", image(), 0),)))
    return Plate(**given | more)


def test_plate_store(spark, tmp_path):
    s = StoreSettings(str(tmp_path / "s"), plates=(plate(),))
    assert s.keys() == ["plate/C/5/fov1", "plate/C/5/fov2", "plate/D/7/fov1"]
    with GridStore(spark, s) as g:
        g.append(np.ones((2, 4, 4), "u1"), "plate/C/5/fov1")
    doc = json.loads((tmp_path / "s/plate/zarr.json").read_text())["attributes"]["ome"]
    got = doc["plate"]
    assert doc["version"] == got["version"] == "0.5" and got["field_count"] == 2 and got["name"] == "plate"
    assert [(a["id"], a["maximumfieldcount"], a.get("endtime")) for a in got["acquisitions"]] == [(0, 1, None), (1, 1, 9)]
    assert [(w["path"], w["rowIndex"], w["columnIndex"]) for w in got["wells"]] == [("C/5", 2, 4), ("D/7", 3, 6)]
    well = json.loads((tmp_path / "s/plate/C/5/zarr.json").read_text())["attributes"]["ome"]["well"]
    assert well["images"] == [{"path": "fov1", "acquisition": 0}, {"path": "fov2", "acquisition": 1}]
    # images are groups of levels, with or without a method, and their documents are there without a frame
    assert json.loads((tmp_path / "s/plate/D/7/fov1/zarr.json").read_text())["attributes"]["ome"]["multiscales"][0]["datasets"][0]["path"] == "0"
    assert read_back(spark, str(tmp_path / "s"), "plate/C/5/fov1/0").sum() == 32


@pytest.mark.parametrize(
    "change",
    [
        {"row_names": ()}, {"row_names": ("A", "a", "C", "D")}, {"column_names": ("1", "5", "7", "x y")}, {"name": ""}, {"path": ""}, {"acquisitions": (Acquisition(0), Acquisition(0), Acquisition(1))},
        {"acquisitions": (Acquisition(0),)}, {"row_names": ("A", "B")}, {"wells": (Well("C", "5", (FieldOfView("f", image()), FieldOfView("f", image()))),)},
        {"wells": (Well("C", "5", (FieldOfView("f", dataclasses.replace(image(), key="k")),)),)}, {"wells": (Well("C", "5", ()),)},
    ],
)
def test_plate_problems(change):
    assert plate().problems() == [] and plate(**change).problems()


def test_store_problems(tmp_path):
    flat = spec(("y", "space", 8, 8, 1), ("x", "space", 8, 8, 1))
    key = lambda k, **m: dataclasses.replace(flat, key=k, **m)
    assert settings(tmp_path, key("a/b"), key("c")).problems() == []
    for bad in ([], [key(""), key("b")], [key("a"), key("a/b")], [key("a", method="mean"), key("a/0")], [key("a"), key(" /a/")], [key("a/zarr.json")], [key("a b")], [key("a", compressor="blosc-lz4", level=10)], [key("a", compressor="blosc-zstd", shuffle=3)], [key("a", compressor="zstd", shuffle=1)], [key("a", compressor="lzma")]):
        assert settings(tmp_path, *bad).problems(), bad
    assert settings(tmp_path, key("a", method="mean"), key("a/labels")).problems() == []
    assert StoreSettings("", (flat,)).problems() and StoreSettings("/no/such/place/s", (flat,)).problems()
    assert S3Settings("http://h", "bucket").problems() == [] and len(S3Settings(" ", "ab").problems()) == 2
    assert StoreSettings("x", (flat,), s3=S3Settings("http://h", "bucket")).root == "s3a://bucket/x"


def test_json_with_comments():
    assert parse_json('{"a": "/* no */", /* yes */ "b": [1, // two\n 2]}') == {"a": "/* no */", "b": [1, 2]}


def test_stream_to_store(spark, tmp_path):
    from gridloom.streaming.ingest import StoreSink

    s = spec(("t", "time", 0, 2, 1), ("y", "space", 4, 4, 1), ("x", "space", 4, 4, 1), dtype="uint8")
    images = np.random.default_rng(3).integers(1, 9, (5, 4, 4)).astype("u1")
    for part in ((0, 1), (2,), (3, 4)):
        spark.createDataFrame([(i, bytearray(images[i].tobytes())) for i in part], "frame_id long, data binary").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    sink = StoreSink(s, str(tmp_path / "s"))
    frames = spark.readStream.schema("frame_id long, data binary").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sink.start(frames, str(tmp_path / "ck")).awaitTermination()
    assert json.loads((tmp_path / "s/a/zarr.json").read_text())["shape"] == [4, 4, 4]
    assert sink.finish(spark) == 5 and (read_back(spark, str(tmp_path / "s"), "a") == images).all()


def test_reframing_over_batches(spark, tmp_path):
    from gridloom.streaming.ingest import reframe

    def run(parts, name, most=0):
        for i, rows in enumerate(parts):
            spark.createDataFrame(rows, "array_key string, seq long, data binary").coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        stream = spark.readStream.schema("array_key string, seq long, data binary").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
        q = reframe(stream, 3, most).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"{name}.ck")).start()
        q.awaitTermination()
        return sorted((r.array_key, r.frame_id, bytes(r.data)) for r in spark.table(name).collect())

    # part 1 comes a batch later than part 2; null is an empty part
    parts = [[("k", 0, bytearray(b"ab")), ("k", 2, bytearray(b"fgh"))], [("k", 1, bytearray(b"cde")), ("m", 0, None)], [("m", 1, bytearray(b"xyz")), ("k", 3, bytearray(b"i"))]]
    assert run(parts, "late") == [("k", 0, b"abc"), ("k", 1, b"def"), ("k", 2, b"ghi"), ("m", 0, b"xyz")]
    for name, rows, most in (("twice", [[("k", 0, bytearray(b"a"))], [("k", 0, bytearray(b"a"))]], 0), ("much", [[("k", 0, bytearray(b"abcdefg"))]], 6)):
        with pytest.raises(Exception, match="twice or too late|more bytes"):
            run(rows, name, most)


def test_chunk_source_prunes(spark, tmp_path):
    s = spec(("t", "time", 0, 1, 2), ("y", "space", 8, 4, 1), ("x", "space", 8, 4, 2), compressor="zstd")
    images = np.random.default_rng(4).integers(1, 99, (5, 8, 8)).astype("<u2")
    store.write_array(frames_of(spark, images), s, str(tmp_path)).collect()
    store.commit(s, str(tmp_path), 5)
    chunks.register(spark)
    df = spark.read.format("gridloom").option("path", str(tmp_path / "a")).load()
    assert df.count() == 5 * 4
    some = df.filter("t >= 2 and t < 4 and y = 1 and x in (0, 1)").collect()
    assert sorted((r.t, r.y, r.x) for r in some) == [(t, 1, x) for t in (2, 3) for x in (0, 1)]
    for r in some:
        assert (np.frombuffer(bytes(r.data), "<u2").reshape(4, 4) == images[r.t, 4:, 4 * r.x : 4 * r.x + 4]).all()
    from pyspark.sql.datasource import EqualTo, GreaterThan

    reader = chunks.ChunkReader(str(tmp_path / "a"))
    left = list(reader.pushFilters([EqualTo(("t",), 4), GreaterThan(("y",), 0), EqualTo(("data",), b"")]))
    assert len(left) == 1 and [p.at for p in reader.partitions()] == [(2, 1, 0)]


def test_layers_bands_and_empty_slots():
    banded = Layout(spec(("t", "time", 0, 1, 1), ("z", "space", 1000, 64, 3), ("y", "space", 64, 64, 1), ("x", "space", 64, 64, 1)))
    assert (banded.banded, banded.bands, banded.band_frames, banded.chunk_layer_frames, banded.band_chunks) == (True, 16, 64, 1000, 1)
    deep = Layout(spec(("t", "time", 0, 1, 1), ("a", "other", 8, 2, 1), ("b", "other", 10, 5, 1), ("y", "space", 64, 64, 1), ("x", "space", 64, 64, 1)))
    assert (deep.banded, deep.bands, deep.band_frames, deep.chunk_layer_frames, deep.band_chunks) == (True, 4, 20, 80, 2)
    assert not Layout(spec(("t", "time", 0, 4, 1), ("z", "space", 256, 64, 1), ("y", "space", 64, 64, 1), ("x", "space", 64, 64, 1))).banded
    ragged = Layout(spec(("t", "time", 0, 32, 1), ("y", "space", 960, 320, 2), ("x", "space", 1080, 270, 3)))
    assert [ragged.shard_layer_chunks(k, 0) for k in range(4)] == [[0, 1, 2, 4, 5, 6], [3, 7], [8, 9, 10], [11]]
    assert [ragged.empty_slots(k, 0) for k in range(4)] == [[], [1, 2, 4, 5], [3, 4, 5], [1, 2, 3, 4, 5]]


def test_frame_ids_in_storage_order(spark):
    from pyspark.sql import functions as F

    from gridloom.functions import lattice as la

    lay = Layout(spec(("t", "time", 0, 1, 1), ("c", "channel", 3, 1, 1), ("z", "space", 4, 1, 1), ("y", "space", 2, 2, 1), ("x", "space", 2, 2, 1), order=(0, 2, 1, 3, 4)))
    want = np.arange(24).reshape(2, 3, 4).transpose(0, 2, 1).ravel().argsort().tolist()
    assert [lay.transposed(i) for i in range(24)] == want
    assert [r[0] for r in spark.range(24).select(la.transposed(lay, F.col("id"))).collect()] == want
