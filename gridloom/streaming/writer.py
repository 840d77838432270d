"""A store that is appended to: bytes or numpy arrays in, shards, levels and metadata out.

The caller's appends are cut into frames; full queues of frames go to a staging table, and Spark jobs make shards of it: a shard layer as soon as
it is full, the rest and all coarser levels when the store is closed. The first error ends the store: later appends and ``close`` raise it.
"""

from __future__ import annotations

import json
import re
from dataclasses import replace
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.operators import plates as pl
from gridloom.plans.layout import DTYPES, QUEUE_BYTES, QUEUE_FRAMES, ArraySpec, Layout
from gridloom.settings import StoreSettings, normal_key
from gridloom.sources import store

FRAMES = "frame_id long, data binary"


class StreamError(OSError):
    """The store has failed and takes no more data."""


def parse_json(text: str) -> Any:
    """JSON that may have comments."""
    kept = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    return json.loads(kept)


def planes(data: np.ndarray):
    """Bytes of an array in C order, plane by plane where it isn't contiguous, so that no whole copy is made."""
    little = data.dtype.newbyteorder("<")
    if data.ndim <= 2 or data.flags.c_contiguous:
        yield np.ascontiguousarray(data, little).tobytes()
    else:
        for part in data:
            yield from planes(part)


class ArrayWriter:
    """One array's appends. Frames that are staged but in no shard yet lie in ``folder``."""

    def __init__(self, spark: SparkSession, spec: ArraySpec, root: str, grouped: bool):
        self.spark, self.spec, self.root, self.grouped = spark, spec, root, grouped
        self.layout = Layout(spec)
        self.bytes_in = 0
        self.rest = bytearray()
        self.queue: list[tuple[int, bytes]] = []
        self.frames = self.staged = self.layers = 0
        self.attributes = dict(spec.attributes)
        self.folder = store.node(root, f".staged/{spec.key or 'root'}")
        self.most = max(QUEUE_FRAMES[0], min(QUEUE_FRAMES[1], QUEUE_BYTES // self.layout.frame_bytes))

    def check_room(self, n: int) -> None:
        most = self.layout.most_bytes
        if most and self.bytes_in + n > most:
            raise ValueError(f"{self.spec.key or 'root'}: {n} bytes more than the array holds")

    def take(self, data: bytes | bytearray) -> None:
        size = self.layout.frame_bytes
        self.bytes_in += len(data)
        self.rest += data
        whole = len(self.rest) // size
        for k in range(whole):
            self.queue.append((self.frames, bytes(self.rest[k * size : (k + 1) * size])))
            self.frames += 1
            if len(self.queue) >= self.most:
                self.stage()
        del self.rest[: whole * size]

    def staged_frames(self) -> DataFrame:
        return self.spark.read.schema(FRAMES).parquet(store.for_spark(self.folder))

    def stage(self) -> None:
        """Appends the queued frames to the staging table and writes the shard layers that are full now."""
        if not self.queue:
            return
        rows = [(i, bytearray(d)) for i, d in self.queue]
        self.spark.createDataFrame(rows, FRAMES).write.mode("append").parquet(store.for_spark(self.folder))
        self.staged += len(self.queue)
        self.queue = []
        layer = self.layout.shard_layer_frames
        if not self.grouped and self.staged // layer > self.layers:
            self.write_layers(self.staged // layer)

    def write_layers(self, upto: int) -> None:
        layer = self.layout.shard_layer_frames
        # a storage order moves frames within a layer only
        some = self.staged_frames().filter((F.col("frame_id") >= self.layers * layer) & (F.col("frame_id") < upto * layer))
        store.write_array(some, self.spec, self.root).collect()  # a row a shard
        self.layers = upto
        store.commit(replace(self.spec, attributes=self.attributes), self.root, min(self.frames, upto * layer))

    def close(self) -> None:
        """Writes what is left. Bytes short of a frame are dropped; ``residue`` tells how many."""
        self.stage()
        spec = replace(self.spec, attributes=self.attributes)
        if self.grouped:
            some = self.staged_frames() if self.staged else self.spark.createDataFrame([], FRAMES)
            store.write_pyramid(some, spec, self.root)
        elif self.frames or self.attributes:
            if self.frames > self.layers * self.layout.shard_layer_frames:
                self.write_layers(-(-self.frames // self.layout.shard_layer_frames))
            store.commit(spec, self.root, self.frames)

    @property
    def residue(self) -> int:
        return len(self.rest)

    @property
    def held(self) -> int:
        return len(self.rest) + sum(len(d) for _, d in self.queue)


class GridStore:
    """A store open for appending.

        with GridStore(spark, settings) as s:
            s.append(images, "path/to/array")
    """

    def __init__(self, spark: SparkSession, settings: StoreSettings):
        if bad := settings.problems():
            raise ValueError("; ".join(bad))
        self.spark, self.settings, self.error, self.closed = spark, settings, None, False
        store.create_store(settings.root, "overwrite" if settings.overwrite else "append")
        self.arrays = {a.key: ArrayWriter(spark, a, settings.root, a.key in settings.grouped) for a in settings.arrays}

    def __enter__(self) -> GridStore:
        return self

    def __exit__(self, kind: type | None, *_: object) -> None:
        if kind is None or self.error is None:
            self.close()

    @property
    def is_active(self) -> bool:
        return not self.closed and self.error is None

    def _array(self, key: str | None) -> ArrayWriter:
        if key is None:
            if len(self.arrays) != 1:
                raise KeyError("a store of several arrays needs a key")
            return next(iter(self.arrays.values()))
        if (name := normal_key(key)) not in self.arrays:
            raise KeyError(key)
        return self.arrays[name]

    def _open(self) -> None:
        if self.error is not None:
            raise StreamError(f"the store has failed: {self.error}") from self.error
        if self.closed:
            raise StreamError("the store is closed")

    def append(self, data: bytes | np.ndarray, key: str | None = None) -> int:
        """Takes any number of bytes and returns it. What doesn't fit into a bounded array is refused before any of it is taken."""
        self._open()
        to = self._array(key)
        if isinstance(data, np.ndarray) and data.dtype.name not in DTYPES:
            raise ValueError(f"unknown type {data.dtype}")
        parts = planes(data) if isinstance(data, np.ndarray) else [data]
        n = data.nbytes if isinstance(data, np.ndarray) else len(data)
        to.check_room(n)
        try:
            for part in parts:
                to.take(part)
        except Exception as e:
            self.error = e
            raise
        return n

    def skip(self, n_bytes: int, key: str | None = None) -> int:
        """Appends zeros."""
        self._open()
        to = self._array(key)
        to.check_room(n_bytes)
        step = to.layout.frame_bytes
        for at in range(0, n_bytes, step):
            to.take(bytes(min(step, n_bytes - at)))
        return n_bytes

    def write_custom_metadata(self, document: str, metadata_key: str = "", array_key: str | None = None) -> None:
        """Merges JSON under the array's attributes, or puts it at one key (slashes are part of the key); later writes win; ``ome`` is reserved."""
        self._open()
        to, value, key = self._array(array_key), parse_json(document), normal_key(metadata_key)
        if not key and not isinstance(value, dict):
            raise ValueError("without a key an object is needed")
        new = {key: value} if key else value
        if "ome" in new:
            raise ValueError("the key ome is reserved")
        to.attributes |= new

    def current_memory_usage(self) -> int:
        return sum(a.held for a in self.arrays.values())

    def residues(self) -> dict[str, int]:
        """Bytes of each array that are short of a frame."""
        return {k: a.residue for k, a in self.arrays.items()}

    def close(self) -> None:
        """Writes all that is left and the groups' documents; a second call does nothing."""
        if self.closed:
            return
        self.closed = True
        if self.error is not None:
            raise StreamError(f"the store has failed: {self.error}") from self.error
        for a in self.arrays.values():
            a.close()
        self._write_groups()
        fs, at = store.filesystem(store.node(self.settings.root, ".staged"))
        if fs.get_file_info(at).type.name == "Directory":
            fs.delete_dir(at)

    def _write_groups(self) -> None:
        """A document for each folder above an array; plates and wells have their own."""
        keys = self.spark.createDataFrame([(k,) for k in self.arrays], "array_key string")
        t = self.settings.tables(self.spark)
        documents = dict(map(tuple, pl.plate_documents(t["wells"], t["rows"], t["columns"], t["fovs"], t["acquisitions"]).union(pl.well_documents(t["fovs"])).collect())) if self.settings.plates else {}
        paths = {r.path for r in pl.group_paths(keys).collect()} | ({""} if "" not in self.arrays else set())
        for path in sorted(paths):
            store.put(store.node(self.settings.root, path) + "/zarr.json", (documents.get(path) or json.dumps(store.group_metadata())).encode())
