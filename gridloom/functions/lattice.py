"""Index arithmetic of arrays as Column expressions: no shuffle, no lookup table."""

from __future__ import annotations

from math import prod

from pyspark.sql import Column, functions as F

from gridloom.plans.layout import Layout


def div(a: Column, b: int) -> Column:
    """Whole-number quotient of a non-negative column."""
    return F.call_function("div", a, F.lit(b))


def frame_coords(layout: Layout, frame: Column) -> list[Column]:
    """Coordinates of a frame on all axes but the last two, in storage order."""
    out = []
    for i, stride in enumerate(layout.frame_strides()):
        at = div(frame, stride)
        out.append(at if i == 0 else at % layout.axes[i].size)
    return out


def transposed(layout: Layout, frame: Column) -> Column:
    """Storage frame id of an acquisition frame id: decoded in one order of the axes and encoded in the other."""
    spec = layout.spec
    order = spec.order
    if order is None or spec.flat:
        return frame
    dims, n = spec.dims, len(spec.dims) - 2
    at = []
    for i in range(n):
        a = div(frame, prod(d.size for d in dims[i + 1 : n]))
        at.append(a if i == 0 else a % dims[i].size)
    out = F.lit(0).cast("long")
    for k, i in enumerate(order[:n]):
        out = out + at[i] * prod(dims[j].size for j in order[k + 1 : n])
    return out


def lattice(layout: Layout, frame: Column, axis: int) -> Column:
    return div(frame_coords(layout, frame)[axis], layout.axes[axis].chunk)


def tile_offset(layout: Layout, frame: Column) -> Column:
    out = F.lit(0).cast("long")
    for i in range(1, len(layout.axes) - 2):
        out = out + lattice(layout, frame, i) * prod(d.chunks for d in layout.axes[i + 1 :])
    return out


def internal_offset(layout: Layout, frame: Column) -> Column:
    out = F.lit(0).cast("long")
    for i, at in enumerate(frame_coords(layout, frame)):
        out = out + at % layout.axes[i].chunk * prod(d.chunk for d in layout.axes[i + 1 : -2])
    return out * (layout.axes[-2].chunk * layout.axes[-1].chunk * layout.bytes)


def chunk_of(layout: Layout, frame: Column, y: Column, x: Column) -> Column:
    """Index of a pixel's chunk in the row-major lattice of all chunks."""
    at = [*(lattice(layout, frame, i) for i in range(len(layout.axes) - 2)), div(y, layout.axes[-2].chunk), div(x, layout.axes[-1].chunk)]
    out = F.lit(0).cast("long")
    for i, a in enumerate(at):
        out = out + a * prod(d.chunks for d in layout.axes[i + 1 :])
    return out


def chunk_coords(layout: Layout, chunk: Column) -> list[Column]:
    out = []
    for i in range(len(layout.axes)):
        a = div(chunk, prod(d.chunks for d in layout.axes[i + 1 :]))
        out.append(a if i == 0 else a % layout.axes[i].chunks)
    return out


def shard_of(layout: Layout, chunk: Column) -> Column:
    """Index of a chunk's shard within its append shard."""
    at, out = chunk_coords(layout, chunk), F.lit(0).cast("long")
    for i in range(1, len(at)):
        out = out + div(at[i], layout.axes[i].shard) * prod(d.shards for d in layout.axes[i + 1 :])
    return out


def slot_of(layout: Layout, chunk: Column) -> Column:
    """Index of a chunk within its shard."""
    at, out = chunk_coords(layout, chunk), F.lit(0).cast("long")
    for i, a in enumerate(at):
        out = out + a % layout.axes[i].shard * prod(d.shard for d in layout.axes[i + 1 :])
    return out


def shard_path(layout: Layout, chunk: Column) -> Column:
    at = [div(a, d.shard).cast("string") for a, d in zip(chunk_coords(layout, chunk), layout.axes, strict=True)]
    return F.concat_ws("/", F.lit("c"), *(at[1:] if layout.spec.flat else at))


def shape_after(layout: Layout, frames: Column) -> list[Column]:
    """Sizes of the array's axes when ``frames`` frames have been written."""
    for d in reversed(layout.inner):
        frames = div(frames + (d.size - 1), d.size)
    out = [frames, *(F.lit(d.size).cast("long") for d in layout.axes[1:])]
    return out[1:] if layout.spec.flat else out


def shard_layer(layout: Layout, frame: Column) -> Column:
    """Append shard of a storage frame: it changes when a shard is full and files roll over."""
    return div(frame, layout.shard_layer_frames)


def chunk_layer(layout: Layout, frame: Column) -> Column:
    """Chunk layer of a storage frame: chunks are complete when it changes."""
    return div(frame, layout.chunk_layer_frames)


def band(layout: Layout, frame: Column) -> Column:
    """Band of a storage frame within its chunk layer; 0 where layers are not flushed band by band."""
    return div(frame % layout.chunk_layer_frames, layout.band_frames) if layout.banded else F.lit(0).cast("long")


def normal_key(key: Column) -> Column:
    """White space and slashes trimmed off, runs of slashes joined."""
    return F.regexp_replace(F.regexp_replace(key, r"^[\s/]+|[\s/]+$", ""), "/+", "/")


def valid_key(key: Column) -> Column:
    return key.rlike(r"^[A-Za-z0-9_.-]+(/[A-Za-z0-9_.-]+)*$") & ~key.rlike(r"(^|/)\.+(/|$)") & ~key.rlike("(^|/)__")
