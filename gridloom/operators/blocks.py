"""Whole frames as binary blocks: storage order, tiles, chunks, shards and pyramid levels.

Frames are rows (frame_id, data) of raw little-endian planes. Work on one frame needs no shuffle; chunks and shards meet in one.
"""

from __future__ import annotations

from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridloom.functions import lattice as la
from gridloom.plans.layout import ArraySpec, Layout

#: Bytes of data that one output batch gathers before it is sent on.
MOST_BYTES = 16 << 20


def dtype_of(spec: ArraySpec) -> np.dtype:
    return np.dtype(spec.dtype).newbyteorder("<")


def emit(rows, names: list[str], types: list[pa.DataType]):
    """Record batches of ``rows``, whose last value is binary, of about MOST_BYTES each."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + len(row[-1] or b"")
        if size >= MOST_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)


def over_frames(frames: DataFrame, use) -> DataFrame:
    """(frame_id, data) with ``use`` applied to each frame's bytes."""

    def run(batches):
        for batch in batches:
            yield from emit(((i, use(d)) for i, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)), ["frame_id", "data"], [pa.int64(), pa.binary()])

    return frames.select("frame_id", "data").mapInArrow(run, "frame_id long, data binary")


def stored_frames(frames: DataFrame, spec: ArraySpec) -> DataFrame:
    """Acquired frames in storage order: ids permuted, rows and columns exchanged where the storage order says so."""
    layout = Layout(spec)
    out = frames.select(la.transposed(layout, F.col("frame_id").cast("long")).alias("frame_id"), "data")
    if not layout.swapped:
        return out
    kind, shape = dtype_of(spec), (layout.width, layout.height)
    return over_frames(out, lambda d: np.ascontiguousarray(np.frombuffer(d, kind).reshape(shape).T).tobytes())


def tiles(frames: DataFrame, spec: ArraySpec) -> DataFrame:
    """(path, slot, plane, data): frames cut into full chunk planes by shard path, slot and plane within the chunk; null data if all bytes are zero."""
    frames, spec = stored_frames(frames, spec), Layout(spec).stored
    layout, kind = Layout(spec), dtype_of(spec)
    cy, cx = layout.axes[-2].chunk, layout.axes[-1].chunk
    plane_bytes = cy * cx * layout.bytes
    weights = [prod(e.shard for e in layout.axes[i + 1 :]) for i in range(len(layout.axes))]

    def cut(frame: int, data: bytes):
        image = np.frombuffer(data, kind).reshape(layout.height, layout.width)
        lead = [layout.lattice(frame, i) for i in range(len(layout.axes) - 2)]
        plane = layout.internal_offset(frame) // plane_bytes
        for y in range(layout.axes[-2].chunks):
            for x in range(layout.axes[-1].chunks):
                part = image[y * cy : (y + 1) * cy, x * cx : (x + 1) * cx]
                at = [*lead, y, x]
                shard = [a // d.shard for a, d in zip(at, layout.axes, strict=True)]
                slot = sum(a % d.shard * w for a, d, w in zip(at, layout.axes, weights, strict=True))
                data = None
                if np.ascontiguousarray(part).view(np.uint8).any():
                    tile = np.zeros((cy, cx), kind)
                    tile[: part.shape[0], : part.shape[1]] = part
                    data = tile.tobytes()
                yield "/".join(["c", *map(str, shard[1:] if spec.flat else shard)]), slot, plane, data

    def run(batches):
        for batch in batches:
            rows = (r for i, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in cut(i, d))
            yield from emit(rows, ["path", "slot", "plane", "data"], [pa.string(), pa.int32(), pa.int64(), pa.binary()])

    return frames.mapInArrow(run, "path string, slot int, plane long, data binary")


def chunk_blocks(frames: DataFrame, spec: ArraySpec) -> DataFrame:
    """(path, slot, data): the chunks of an array, full size; a chunk without a nonzero byte has null data.

    Tiles are dealt by chunk and sorted, and a task assembles one chunk after the other.
    """
    layout = Layout(Layout(spec).stored)
    plane_bytes = layout.axes[-2].chunk * layout.axes[-1].chunk * layout.bytes
    chunk_bytes = prod(d.chunk for d in layout.axes) * layout.bytes
    dealt = tiles(frames, spec).repartition("path", "slot").sortWithinPartitions("path", "slot", "plane")

    def run(batches):
        yield from emit(assembled(batches, plane_bytes, chunk_bytes), ["path", "slot", "data"], [pa.string(), pa.int32(), pa.binary()])

    return dealt.mapInArrow(run, "path string, slot int, data binary")


def assembled(batches, plane_bytes: int, chunk_bytes: int):
    """Yields (path, slot, chunk or None) from tiles (path, slot, plane, data) that are sorted; holds one chunk."""
    now, block = None, None
    for batch in batches:
        for path, slot, plane, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (path, slot) != now:
                if now is not None:
                    yield *now, None if block is None else bytes(block)
                now, block = (path, slot), None
            if data is not None:
                if block is None:
                    block = bytearray(chunk_bytes)
                block[plane * plane_bytes : (plane + 1) * plane_bytes] = data
    if now is not None:
        yield *now, None if block is None else bytes(block)


def pooled(parts: list[np.ndarray], method: str) -> np.ndarray:
    """Corners taken together in their order, in their own type; means of whole numbers truncate toward zero, of an exact sum."""
    out = parts[0]
    if method == "decimate":
        return out
    if method == "mean":
        if out.dtype.kind == "f":
            for p in parts[1:]:
                out = out + p
            return (out / out.dtype.type(len(parts))).astype(parts[0].dtype)
        wide = [p.astype(object if out.dtype.itemsize == 8 else np.int64) for p in parts]
        total = sum(wide[1:], wide[0])
        cut = abs(total) // len(parts)
        return np.where(total < 0, -cut, cut).astype(out.dtype)
    for p in parts[1:]:
        out = np.where(p < out if method == "min" else p > out, p, out)  # NaN: never taken, never replaced
    return out


def pool_plane(image: np.ndarray, method: str) -> np.ndarray:
    """Halves both axes of a plane; an odd last row or column is repeated."""
    h, w = image.shape
    image = np.pad(image, ((0, h % 2), (0, w % 2)), "edge")
    return pooled([image[r::2, c::2] for r in (0, 1) for c in (0, 1)], method)


def next_level(frames: DataFrame, fine: ArraySpec, coarse: ArraySpec) -> DataFrame:
    """The frames of the level ``coarse`` from those of ``fine``, both in storage order.

    Planes are halved where they lie. Pairs of planes along z meet by id, two rows a group; an odd last plane passes, a plane whose partner
    never came is dropped.
    """
    a, b = Layout(fine), Layout(coarse)
    kind, method, shape = dtype_of(fine), fine.method, (a.height, a.width)
    if b.height != a.height:
        frames = over_frames(frames, lambda d: pool_plane(np.frombuffer(d, kind).reshape(shape), method).astype(kind).tobytes())
    depth, half = a.axes[-3].size, b.axes[-3].size
    if depth == half or fine.flat:
        return frames
    z = F.col("frame_id") % depth
    pair = la.div(F.col("frame_id"), depth) * half + la.div(z, 2)
    met = frames.select(pair.alias("frame_id"), z.alias("z"), "data").groupBy("frame_id").agg(F.sort_array(F.collect_list(F.struct("z", "data"))).alias("planes"))
    met = met.select("frame_id", F.col("planes")[0]["data"].alias("first"), F.get("planes", F.lit(1))["data"].alias("second"), F.col("planes")[0]["z"].alias("z"))
    met = met.filter(F.col("second").isNotNull() | ((F.lit(depth % 2 == 1)) & (F.col("z") == depth - 1)))

    def run(batches):
        for batch in batches:
            rows = ((i, x if y is None else pooled([np.frombuffer(x, kind), np.frombuffer(y, kind)], method).astype(kind).tobytes()) for i, x, y in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True))
            yield from emit(rows, ["frame_id", "data"], [pa.int64(), pa.binary()])

    return met.mapInArrow(run, "frame_id long, data binary")
