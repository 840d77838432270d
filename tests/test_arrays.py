import dataclasses

import numpy as np
import pytest

from gridloom.plans.layout import ArraySpec, Dimension as D, Layout, key_problem, levels, memory_estimate, validate
from gridloom.sources import store


def spec(*dims, **more):
    return ArraySpec("a", more.pop("dtype", "uint16"), tuple(D(n, k, *s) for n, k, *s in dims), **more)


def test_lattice_goldens():
    lay = Layout(spec(("t", "time", 0, 5, 1), ("c", "channel", 3, 2, 1), ("z", "space", 5, 2, 1), ("y", "space", 48, 16, 1), ("x", "space", 64, 16, 1)))
    for frame, t, c, z, tile, inside in [(0, 0, 0, 0, 0, 0), (1, 0, 0, 0, 0, 512), (4, 0, 0, 2, 24, 0), (12, 0, 1, 1, 48, 0), (26, 0, 1, 0, 36, 2560), (33, 0, 0, 1, 12, 4608), (74, 0, 1, 2, 60, 8192), (75, 1, 0, 0, 0, 0)]:
        assert [lay.lattice(frame, i) for i in range(3)] == [t, c, z]
        assert (lay.tile_offset(frame), lay.internal_offset(frame)) == (tile, inside)


def test_shard_goldens():
    lay = Layout(spec(("t", "time", 0, 32, 1), ("y", "space", 960, 320, 2), ("x", "space", 1080, 270, 3)))
    assert [(lay.shard_of(c), lay.slot_of(c)) for c in range(12)] == [(0, 0), (0, 1), (0, 2), (1, 0), (0, 3), (0, 4), (0, 5), (1, 3), (2, 0), (2, 1), (2, 2), (3, 0)]


def test_levels_and_memory():
    big = spec(("z", "space", 1000, 256, 4), ("y", "space", 2000, 256, 8), ("x", "space", 2000, 256, 8), dtype="uint8", method="mean")
    assert [tuple(d.size for d in s.dims) for s in levels(big)] == [(1000, 2000, 2000), (500, 1000, 1000), (250, 500, 500), (250, 250, 250)]
    assert len(levels(dataclasses.replace(big, max_levels=1))) == 2
    s = spec(("t", "time", 0, 5, 1), ("c", "channel", 3, 1, 1), ("z", "space", 6, 2, 1), ("y", "space", 48, 16, 1), ("x", "space", 64, 16, 1))
    assert memory_estimate([s]) == 3704832


def test_validation():
    good = spec(("t", "time", 0, 1, 1), ("y", "space", 8, 8, 1), ("x", "space", 8, 8, 1))
    assert validate(good) == []
    assert validate(dataclasses.replace(good, dtype="text")) and validate(dataclasses.replace(good, dims=good.dims[:1]))
    assert validate(dataclasses.replace(good, order=(1, 0, 2)))
    assert key_problem("a/b") is None and key_problem("a/../b") and key_problem("__a") and key_problem("a b")


def test_crc_and_shard():
    assert store.crc32c(b"123456789") == 0xE3069283
    data = store.shard_bytes({1: b"abc"}, 2)
    assert len(data) == 3 + 36 and store.read_shard(data, 2) == {1: b"abc"}
    with pytest.raises(ValueError):
        store.read_shard(data[:-1] + b"\0", 2)


@pytest.mark.parametrize("compressor", ["none", "zstd"])
def test_write_and_read(spark, tmp_path, compressor):
    s = spec(("t", "time", 0, 2, 1), ("z", "space", 3, 2, 2), ("y", "space", 5, 4, 2), ("x", "space", 7, 4, 1), compressor=compressor)
    lay = Layout(s)
    images = np.random.default_rng(0).integers(0, 99, (6, 5, 7)).astype("<u2")
    images[1] = 0
    frames = spark.createDataFrame([(i, bytearray(im.tobytes())) for i, im in enumerate(images)], "frame_id long, data binary")
    assert store.write_array(frames, s, str(tmp_path)).count() == 2
    store.commit(s, str(tmp_path), 6)
    back = np.zeros((2, 4, 8, 8), "<u2")
    for path, slot, data in store.read_chunks(spark, s, str(tmp_path)).collect():
        shard = [int(p) for p in path.split("/")[1:]]
        dims, at = [d.shard for d in lay.axes], []
        for n in reversed(dims):
            at.insert(0, slot % n)
            slot //= n
        o = [(sh * n + a) * d.chunk for sh, n, a, d in zip(shard, dims, at, lay.axes, strict=True)]
        back[o[0] : o[0] + 2, o[1] : o[1] + 2, o[2] : o[2] + 4, o[3] : o[3] + 4] = np.frombuffer(bytes(data), "<u2").reshape(2, 2, 4, 4)
    assert (back[:, :3, :5, :7].reshape(6, 5, 7) == images).all()


def test_float_pool_nan(spark):
    from gridloom.operators.pooling import pool_floats

    nan = float("nan")
    df = spark.createDataFrame([(0, 0, nan), (0, 1, 1.0), (1, 0, 2.0), (1, 1, 3.0), (0, 2, 5.0), (0, 3, nan), (1, 2, 4.0), (1, 3, 6.0), (0, 4, 7.0)], "y long, x long, v double")
    got = {(r.y, r.x): r.v for r in pool_floats(df, [], "min").collect()}
    assert np.isnan(got[0, 0]) and got[0, 1] == 4.0 and got[0, 2] == 7.0


def test_queries_match_sql(spark):
    import duckdb

    from gridloom import catalogue

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "events", "embeddings", "pages", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    sql = catalogue.oracle_sql()
    for name, query in catalogue.queries().items():
        a = query(spark, sf).toPandas()
        b = con.execute(sql[name]).df()[list(a.columns)]
        rows = lambda d: sorted(map(str, (tuple(float(v) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v) for v in r) for r in d.itertuples(index=False, name=None))))
        assert rows(a) == rows(b), name


def test_stream_reframes(spark, tmp_path):
    from gridloom.streaming.ingest import reframe

    for i, part in enumerate((b"abc", b"defg", b"h")):
        spark.createDataFrame([("k", i, bytearray(part))], "array_key string, seq long, data binary").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("array_key string, seq long, data binary").parquet(str(tmp_path / "in"))
    q = reframe(stream, 3).writeStream.format("memory").queryName("framed").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    assert sorted((r.frame_id, bytes(r.data)) for r in spark.table("framed").collect()) == [(0, b"abc"), (1, b"def")]


def test_zero_fill_of_all_frames(spark, monkeypatch):
    from gridloom import catalogue

    for n in (0, 20, 200):
        monkeypatch.setattr(catalogue, "frames_of", lambda spark, sf, n=n: spark.range(n).selectExpr("id as frame", "id + 7 as total"))
        assert sorted(map(tuple, catalogue.zero_fill(spark, "").collect())) == [(i, i + 7 if i % 3 != 1 else 0) for i in range(n)]
