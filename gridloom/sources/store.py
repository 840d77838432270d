"""Writing arrays as chunked, sharded stores, and reading them back.

One shuffle: frames are cut into tiles where they are, tiles are dealt by shard and sorted by slot, and a task streams each shard into one file:
chunk payloads in slot order, an index of (offset, length) pairs, and its crc32c. A task holds one chunk. Chunks without a nonzero byte are left
out. Files are written whole under a temporary name first, so a task that runs twice leaves one file. Metadata is written last.

Paths: a local folder, or a URI that both Spark and ``pyarrow.fs`` know; ``s3a://`` and ``s3://`` mean the same store. On a cluster the
folder must be one that all executors share.
"""

from __future__ import annotations

import json
import struct
import uuid
from functools import lru_cache
from math import prod

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.checkpoints import materialise
from gridloom.operators import blocks
from gridloom.plans.layout import ArraySpec, Dimension, Layout, levels, validate

MISSING = 2**64 - 1
POLYNOMIAL = 0x82F63B78  # Castagnoli, reflected
VERSION = "0.5"

#: Names of the pooling methods in the metadata, and how a reader can reproduce them.
METHOD_NAMES = {"decimate": "decimate", "mean": "local_mean", "min": "local_min", "max": "local_max"}
PROVENANCE = {
    "mean": {
        "description": "The fields in the metadata describe how to reproduce this multiscaling in scikit-image. The method and its parameters are given here.",
        "method": "skimage.transform.downscale_local_mean", "version": "0.25.2", "kwargs": {"factors": "(2, 2)", "cval": "0"},
    },
    "decimate": {
        "description": "Subsampling by taking every 2nd pixel/voxel (top-left corner of each 2x2 block). Equivalent to numpy array slicing with stride 2.",
        "method": "np.ndarray.__getitem__", "version": "2.2.6", "args": ["(slice(0, None, 2), slice(0, None, 2))"],
    },
    "min": {
        "description": "Minimum pooling over 2x2 blocks. Equivalent to reshaping into blocks and taking numpy.min along block dimensions.",
        "method": "skimage.measure.block_reduce", "version": "0.25.2", "kwargs": {"func": "np.min"},
    },
    "max": {
        "description": "Maximum pooling over 2x2 blocks. Equivalent to reshaping into blocks and taking numpy.max along block dimensions.",
        "method": "skimage.measure.block_reduce", "version": "0.25.2", "kwargs": {"func": "np.max"},
    },
}


@lru_cache
def _crc_tables() -> list[list[int]]:
    """Table k gives the remainder of a byte that k zero bytes follow."""
    first = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (POLYNOMIAL if n & 1 else 0)
        first.append(n)
    tables = [first]
    for _ in range(7):
        tables.append([tables[-1][n] >> 8 ^ first[tables[-1][n] & 255] for n in range(256)])
    return tables


def crc32c(data: bytes) -> int:
    """Checksum, eight bytes a step."""
    t = _crc_tables()
    c, whole = 0xFFFFFFFF, len(data) // 8 * 8
    for low, high in struct.iter_unpack("<II", data[:whole]):
        low ^= c
        c = t[7][low & 255] ^ t[6][low >> 8 & 255] ^ t[5][low >> 16 & 255] ^ t[4][low >> 24] ^ t[3][high & 255] ^ t[2][high >> 8 & 255] ^ t[1][high >> 16 & 255] ^ t[0][high >> 24]
    for b in data[whole:]:
        c = t[0][(c ^ b) & 255] ^ c >> 8
    return c ^ 0xFFFFFFFF


def filesystem(path: str):
    """(pyarrow file system, path on it)."""
    from pyarrow import fs

    if "://" not in path:
        return fs.LocalFileSystem(), path.removeprefix("file:")
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def for_spark(path: str) -> str:
    return path.replace("s3://", "s3a://", 1)


def put(path: str, data: bytes) -> None:
    """Writes ``data`` at ``path`` by way of a temporary name."""
    fs, at = filesystem(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    part = f"{at}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(part) as f:
        f.write(data)
    fs.move(part, at)


def create_store(root: str, mode: str = "error") -> None:
    """Makes the store's folder: ``overwrite`` removes what is there, ``append`` keeps it, ``error`` wants nothing there."""
    from pyarrow.fs import FileType

    if mode not in ("overwrite", "append", "error"):
        raise ValueError(f"unknown mode {mode}")
    fs, at = filesystem(root.rstrip("/"))
    kind = fs.get_file_info(at).type
    if kind == FileType.File:
        raise ValueError(f"{root} is not a folder")
    if kind == FileType.Directory and mode == "error":
        raise FileExistsError(root)
    if kind == FileType.Directory and mode == "overwrite":
        fs.delete_dir(at)
    fs.create_dir(at, recursive=True)


def encoder(spec: ArraySpec):
    """Compresses a chunk; blosc needs a library that is not part of the usual set."""
    if spec.compressor == "none":
        return lambda x: x
    if spec.compressor == "zstd":
        import zstandard

        return zstandard.ZstdCompressor(level=spec.level).compress
    try:
        import blosc
    except ImportError as e:
        raise RuntimeError(f"{spec.compressor} needs the library blosc") from e
    size = Layout(spec).bytes
    return lambda x: blosc.compress(x, typesize=size, clevel=spec.level, shuffle=spec.shuffle, cname=spec.compressor.removeprefix("blosc-"))


def decoder(spec: ArraySpec):
    if spec.compressor == "none":
        return lambda x: x
    if spec.compressor == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompress
    import blosc

    return blosc.decompress


def index_bytes(index: dict[int, tuple[int, int]], slots: int) -> bytes:
    """A shard's index (offset, length of each slot) and its checksum."""
    flat = [x for k in range(slots) for x in index.get(k, (MISSING, MISSING))]
    table = struct.pack(f"<{2 * slots}Q", *flat)
    return table + struct.pack("<I", crc32c(table))


def shard_bytes(payloads: dict[int, bytes], slots: int) -> bytes:
    """A shard of the payloads by slot: payloads, index, checksum of the index."""
    index, at = {}, 0
    for slot in sorted(payloads):
        index[slot] = at, len(payloads[slot])
        at += len(payloads[slot])
    return b"".join(payloads[k] for k in sorted(payloads)) + index_bytes(index, slots)


def read_index(data: bytes, slots: int) -> dict[int, tuple[int, int]]:
    """(offset, length) by slot, from a shard's last bytes; raises ValueError if they are damaged."""
    table = data[-16 * slots - 4 : -4]
    if len(table) != 16 * slots or crc32c(table) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("the shard's index does not match its checksum")
    pairs = struct.unpack(f"<{2 * slots}Q", table)
    return {k: pairs[2 * k : 2 * k + 2] for k in range(slots) if pairs[2 * k] != MISSING}


def read_shard(data: bytes, slots: int) -> dict[int, bytes]:
    """Payloads by slot."""
    return {k: data[at : at + n] for k, (at, n) in read_index(data, slots).items()}


class ShardFile:
    """A shard that is written chunk by chunk under a temporary name."""

    def __init__(self, path: str):
        self.fs, self.at = filesystem(path)
        self.fs.create_dir(self.at.rpartition("/")[0], recursive=True)
        self.part = f"{self.at}.{uuid.uuid4().hex}.tmp"
        self.out, self.size, self.index = self.fs.open_output_stream(self.part), 0, {}

    def add(self, slot: int, payload: bytes) -> None:
        self.out.write(payload)
        self.index[slot] = self.size, len(payload)
        self.size += len(payload)

    def close(self, slots: int) -> int:
        """Writes the index, gives the file its name and returns its size."""
        tail = index_bytes(self.index, slots)
        self.out.write(tail)
        self.out.close()
        self.fs.move(self.part, self.at)
        return self.size + len(tail)


def node(root: str, key: str) -> str:
    return f"{root.rstrip('/')}/{key}".rstrip("/")


def write_array(frames: DataFrame, spec: ArraySpec, root: str) -> DataFrame:
    """Writes the frames (frame_id, data), in acquisition order, of one array under ``root/key``; returns (path, chunks, bytes) of its shards.

    The shards are written when the result is read; ``commit`` writes the metadata afterwards.
    """
    if bad := validate(spec):
        raise ValueError("; ".join(bad))
    layout = Layout(Layout(spec).stored)
    chunk_bytes = prod(d.chunk for d in layout.axes) * layout.bytes
    plane_bytes = layout.axes[-2].chunk * layout.axes[-1].chunk * layout.bytes
    base = node(root, spec.key)

    def run(batches):
        encode, now, shard, rows = encoder(spec), None, None, []
        for path, slot, chunk in blocks.assembled(batches, plane_bytes, chunk_bytes):
            if path != now:
                if shard is not None:
                    rows.append((now, len(shard.index), shard.close(layout.slots)))
                now, shard = path, ShardFile(f"{base}/{path}")
            if chunk is not None:
                shard.add(slot, encode(chunk))
        if shard is not None:
            rows.append((now, len(shard.index), shard.close(layout.slots)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "chunks", "bytes"])

    dealt = blocks.tiles(frames, spec).repartition("path").sortWithinPartitions("path", "slot", "plane")
    return dealt.mapInArrow(run, "path string, chunks long, bytes long")


def write_pyramid(frames: DataFrame, spec: ArraySpec, root: str) -> list[DataFrame]:
    """Writes all levels of ``spec`` under ``root/key/<level>`` and the group's document; returns each level's shards.

    A level's frames are written to the checkpoint folder before the next one is made of them. An array without a method has one level.
    """
    import dataclasses

    if bad := validate(spec):
        raise ValueError("; ".join(bad))
    now, out = blocks.stored_frames(frames, spec), []
    stored = Layout(spec).stored
    plans = levels(stored)
    for k, plan in enumerate(plans):
        if k:
            now = materialise(blocks.next_level(now, plans[k - 1], plan))
        one = dataclasses.replace(plan, key=f"{spec.key}/{k}".lstrip("/"), method=None)
        done = materialise(write_array(now, one, root))
        last = now.agg(F.max("frame_id")).first()[0]
        commit(dataclasses.replace(one, attributes={}), root, 0 if last is None else last + 1)
        out.append(done)
    put(node(root, spec.key) + "/zarr.json", json.dumps(multiscale_metadata(spec)).encode())
    return out


def codec_documents(spec: ArraySpec) -> list[dict]:
    codecs: list[dict] = [{"name": "bytes", "configuration": {"endian": "little"}}]
    if spec.compressor == "zstd":
        codecs.append({"name": "zstd", "configuration": {"level": spec.level, "checksum": False}})
    elif spec.compressor != "none":
        shuffle = ("noshuffle", "shuffle", "bitshuffle")[spec.shuffle]
        codecs.append({"name": "blosc", "configuration": {"cname": spec.compressor.removeprefix("blosc-"), "clevel": spec.level, "shuffle": shuffle, "typesize": Layout(spec).bytes, "blocksize": 0}})
    return codecs


def array_metadata(spec: ArraySpec, frames: int) -> dict:
    """The array's metadata document after ``frames`` frames."""
    layout = Layout(Layout(spec).stored)
    dims = layout.axes[1:] if spec.flat else layout.axes
    return {
        "zarr_format": 3, "node_type": "array", "shape": layout.shape_after(frames), "data_type": spec.dtype, "fill_value": 0,
        "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [d.chunk * d.shard for d in dims]}},
        "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}},
        "dimension_names": [d.name for d in dims], "attributes": dict(spec.attributes), "storage_transformers": [],
        "codecs": [{"name": "sharding_indexed", "configuration": {
            "chunk_shape": [d.chunk for d in dims], "codecs": codec_documents(spec), "index_location": "end",
            "index_codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "crc32c"}],
        }}],
    }


def level_scale(base: Dimension, down: Dimension) -> float:
    """A spatial axis is coarser by the next power of two of the ratio of the sizes."""
    if base.kind != "space" or not down.size:
        return base.scale
    return base.scale * (1 << (-(-base.size // down.size) - 1).bit_length())


def multiscale_metadata(spec: ArraySpec) -> dict:
    """The group document over the levels of ``spec``."""
    plans = levels(Layout(spec).stored)
    first = plans[0].dims
    axes = [{"name": d.name, "type": d.kind} | ({"unit": d.unit} if d.unit else {}) for d in first]
    sets = [{"path": str(k), "coordinateTransformations": [{"type": "scale", "scale": [level_scale(a, b) for a, b in zip(first, p.dims, strict=True)]}]} for k, p in enumerate(plans)]
    scales: dict = {"axes": axes, "datasets": sets}
    if len(plans) > 1:
        scales |= {"type": METHOD_NAMES[spec.method], "metadata": PROVENANCE[spec.method]}
    return {"zarr_format": 3, "node_type": "group", "attributes": {"ome": {"version": VERSION, "name": "/", "multiscales": [scales]}, **spec.attributes}}


def group_metadata() -> dict:
    return {"zarr_format": 3, "node_type": "group", "attributes": {}}


def commit(spec: ArraySpec, root: str, frames: int) -> None:
    """Writes the metadata, last of all."""
    put(node(root, spec.key) + "/zarr.json", json.dumps(array_metadata(spec, frames)).encode())


def read_chunks(spark: SparkSession, spec: ArraySpec, root: str) -> DataFrame:
    """(path, slot, data) of the stored chunks; chunks that are all zero are not stored."""
    slots = Layout(spec).slots

    def run(batches):
        decode = decoder(spec)
        for batch in batches:
            rows = ((path, slot, decode(payload)) for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for slot, payload in read_shard(data, slots).items())
            yield from blocks.emit(rows, ["path", "slot", "data"], [pa.string(), pa.int32(), pa.binary()])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{for_spark(node(root, spec.key))}/c")
    return files.select(F.regexp_extract("path", "(c(?:/[0-9]+)+)$", 1).alias("path"), "content").mapInArrow(run, "path string, slot int, data binary")
