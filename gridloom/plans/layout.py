"""Array specifications and the integer plan of their chunks, shards and pyramid levels. Plain Python, no Spark."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from math import prod

#: Bytes of each pixel type.
DTYPES = {"uint8": 1, "uint16": 2, "uint32": 4, "uint64": 8, "int8": 1, "int16": 2, "int32": 4, "int64": 8, "float32": 4, "float64": 8}
METHODS = ("decimate", "mean", "min", "max")
#: Codecs with their largest level and shuffle.
CODECS = {"none": (0, 0), "zstd": (22, 0), "blosc-lz4": (9, 2), "blosc-zstd": (9, 2)}
RESERVED_FILES = (".zarray", ".zattrs", ".zgroup", "zarr.json")
QUEUE_BYTES, QUEUE_FRAMES = 256 << 20, (16, 512)  # target of buffered frames and its bounds


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


@dataclass(frozen=True)
class Dimension:
    """One axis: size 0 means unbounded (first axis only); shard counts chunks."""

    name: str
    kind: str
    size: int
    chunk: int
    shard: int
    unit: str | None = None
    scale: float = 1.0

    @property
    def chunks(self) -> int:
        return ceil_div(self.size, self.chunk)

    @property
    def shards(self) -> int:
        return ceil_div(self.chunks, self.shard) if self.shard else 0


@dataclass(frozen=True)
class ArraySpec:
    key: str
    dtype: str
    dims: tuple[Dimension, ...]
    order: tuple[int, ...] | None = None  # storage order of the acquisition's axes
    method: str | None = None
    max_levels: int = 0
    compressor: str = "none"
    level: int = 1
    shuffle: int = 0
    attributes: dict = field(default_factory=dict)

    @property
    def flat(self) -> bool:
        return len(self.dims) == 2

    @property
    def axes(self) -> tuple[Dimension, ...]:
        """Storage axes; a 2-d array gets a leading axis of one."""
        dims = tuple(self.dims[i] for i in self.order) if self.order else self.dims
        return (Dimension("_singleton", "other", 1, 1, 1), *dims) if self.flat else dims


def validate(spec: ArraySpec) -> list[str]:
    """What is wrong with ``spec``; an empty list if nothing."""
    bad = []
    if spec.dtype not in DTYPES:
        bad.append(f"unknown type {spec.dtype}")
    if len(spec.dims) < 2:
        bad.append("an array has two axes or more")
    elif any(d.kind != "space" for d in spec.dims[-2:]):
        bad.append("the last two axes are spatial")
    for i, d in enumerate(spec.dims):
        if not d.name:
            bad.append("an axis needs a name")
        if d.size < 0 or d.size == 0 and i > 0:
            bad.append(f"{d.name}: only the first axis is unbounded")
        if d.chunk <= 0 or d.shard <= 0:
            bad.append(f"{d.name}: chunk and shard are positive")
        if d.scale < 0:
            bad.append(f"{d.name}: scale is not negative")
    if spec.order is not None:
        n = len(spec.dims)
        if sorted(spec.order) != list(range(n)) or spec.order[0] != 0 or set(spec.order[-2:]) != {n - 2, n - 1}:
            bad.append("the storage order keeps the first axis first and the last two last")
    if spec.method is not None and spec.method not in METHODS:
        bad.append(f"unknown method {spec.method}")
    if spec.compressor not in CODECS:
        bad.append(f"unknown compressor {spec.compressor}")
    elif spec.compressor != "none":
        level, shuffle = CODECS[spec.compressor]
        if not 0 <= spec.level <= level:
            bad.append(f"the level of {spec.compressor} is 0 to {level}")
        if not 0 <= spec.shuffle <= shuffle:
            bad.append(f"the shuffle of {spec.compressor} is 0 to {shuffle}")
    if spec.max_levels < 0:
        bad.append("the number of levels is not negative")
    if "ome" in spec.attributes:
        bad.append("the attribute ome is reserved")
    return bad


def key_problem(key: str) -> str | None:
    """Why ``key`` is not a valid array key, or None."""
    if not key:
        return "empty"
    if key.endswith("/"):
        return "trailing slash"
    for part in key.split("/"):
        if not part.strip("."):
            return "dots only"
        if part.startswith("__"):
            return "reserved prefix"
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", part):
            return "characters"
    return None


class Layout:
    """Where frames, chunks and shards of an array lie. Axis 0 is appended to; the last two are rows and columns."""

    def __init__(self, spec: ArraySpec):
        self.spec, self.axes = spec, spec.axes
        self.inner = self.axes[1:-2]
        self.bytes = DTYPES[spec.dtype]

    @property
    def height(self) -> int:
        return self.axes[-2].size

    @property
    def width(self) -> int:
        return self.axes[-1].size

    @property
    def frame_bytes(self) -> int:
        return self.height * self.width * self.bytes

    @property
    def most_bytes(self) -> int:
        """Bytes that a bounded array holds; 0 if unbounded."""
        return prod(d.size for d in self.axes) * self.bytes

    @property
    def chunk_layer_frames(self) -> int:
        return self.axes[0].chunk * prod(d.size for d in self.inner)

    @property
    def shard_layer_frames(self) -> int:
        return self.chunk_layer_frames * self.axes[0].shard

    @property
    def layer_chunks(self) -> int:
        """Chunks of one step of the append axis."""
        return prod(d.chunks for d in self.axes[1:])

    @property
    def banded(self) -> bool:
        """Whether inner bands can be flushed before their layer is full."""
        return self.axes[0].chunk == 1 and len(self.axes) >= 4 and self.spec.order is None

    @property
    def band_frames(self) -> int:
        return self.axes[1].chunk * prod(d.size for d in self.axes[2:-2])

    @property
    def bands(self) -> int:
        """Bands of one step of the append axis; one where there is no banding."""
        return self.axes[1].chunks if self.banded else 1

    @property
    def band_chunks(self) -> int:
        return prod(d.chunks for d in self.axes[2:])

    @property
    def slots(self) -> int:
        """Chunks of a full shard."""
        return prod(d.shard for d in self.axes)

    def transposed(self, frame: int) -> int:
        """Storage frame id of an acquisition frame id."""
        spec = self.spec
        if spec.order is None or spec.flat:
            return frame
        dims, n = spec.dims, len(spec.dims) - 2
        at = []
        for size in reversed([d.size for d in dims[1:n]]):
            frame, x = divmod(frame, size)
            at.insert(0, x)
        at.insert(0, frame)
        out = 0
        for i in spec.order[:n]:
            out = out * dims[i].size + at[i] if i else at[0]
        return out

    @property
    def swapped(self) -> bool:
        """Whether rows and columns change places in storage."""
        return self.spec.order is not None and self.spec.order[-1] < self.spec.order[-2]

    @property
    def stored(self) -> ArraySpec:
        """The array whose acquisition order is the storage order."""
        return self.spec if self.spec.order is None else replace(self.spec, dims=tuple(self.spec.dims[i] for i in self.spec.order), order=None)

    def shard_layer_chunks(self, shard: int, layer: int) -> list[int]:
        """Chunks of a shard (index within its append shard) that one chunk layer of the append axis fills, ascending."""
        first = self.layer_chunks * layer
        return [c for c in range(first, first + self.layer_chunks) if self.shard_of(c) == shard]

    def empty_slots(self, shard: int, layer: int) -> list[int]:
        """Slots of that layer of the shard that no chunk fills, as the shard reaches over the array's edge."""
        per = self.slots // self.axes[0].shard
        start = layer % self.axes[0].shard * per
        have = {self.slot_of(c) for c in self.shard_layer_chunks(shard, layer)}
        return [k for k in range(start, start + per) if k not in have]

    def frame_strides(self) -> list[int]:
        """Frames between neighbours of each non-spatial axis."""
        return [prod(d.size for d in self.axes[i + 1 : -2]) for i in range(len(self.axes) - 2)]

    def lattice(self, frame: int, axis: int) -> int:
        at = frame // self.frame_strides()[axis]
        return (at if axis == 0 else at % self.axes[axis].size) // self.axes[axis].chunk

    def tile_offset(self, frame: int) -> int:
        return sum(self.lattice(frame, i) * prod(d.chunks for d in self.axes[i + 1 :]) for i in range(1, len(self.axes) - 2))

    def internal_offset(self, frame: int) -> int:
        total = 0
        for i, stride in enumerate(self.frame_strides()):
            at = frame // stride if i == 0 else frame // stride % self.axes[i].size
            total += at % self.axes[i].chunk * prod(d.chunk for d in self.axes[i + 1 : -2])
        return total * self.axes[-2].chunk * self.axes[-1].chunk * self.bytes

    def chunk_lattice(self, chunk: int) -> list[int]:
        out = []
        for i in range(len(self.axes)):
            stride = prod(d.chunks for d in self.axes[i + 1 :])
            out.append(chunk // stride if i == 0 else chunk // stride % self.axes[i].chunks)
        return out

    def shard_of(self, chunk: int) -> int:
        at = self.chunk_lattice(chunk)
        return sum(at[i] // self.axes[i].shard * prod(d.shards for d in self.axes[i + 1 :]) for i in range(1, len(self.axes)))

    def slot_of(self, chunk: int) -> int:
        at = self.chunk_lattice(chunk)
        return sum(at[i] % self.axes[i].shard * prod(d.shard for d in self.axes[i + 1 :]) for i in range(len(self.axes)))

    def shape_after(self, frames: int) -> list[int]:
        """Array shape when ``frames`` have been written."""
        for d in reversed(self.inner):
            frames = ceil_div(frames, d.size)
        shape = [frames, *(d.size for d in self.axes[1:])]
        return shape[1:] if self.spec.flat else shape


def levels(spec: ArraySpec) -> list[ArraySpec]:
    """The array and its coarser levels, finest first."""
    axes = spec.axes
    bits = lambda n: max(n - 1, 0).bit_length()
    most = min(bits(d.chunks) for d in axes[-2:])
    if len(axes) > 2 and axes[-3].kind == "space":
        most = max(most, bits(axes[-3].chunks))
    if spec.max_levels:
        most = min(most, spec.max_levels)

    def half(d: Dimension) -> Dimension:
        size = ceil_div(d.size, 2)
        return replace(d, size=size, shard=min(ceil_div(size, d.chunk), d.shard), scale=d.scale * 2)

    out = [spec]
    for _ in range(most if spec.method else 0):
        dims = list(out[-1].dims if out[-1].order is None else out[-1].axes)
        y, x = dims[-2:]
        deep = len(dims) > 2 and dims[-3].kind == "space" and dims[-3].size > dims[-3].chunk
        flat = min(y.size, x.size) > max(y.chunk, x.chunk)
        if not deep and not flat:
            break
        if deep:
            dims[-3] = half(dims[-3])
        if flat:
            dims[-2:] = [half(y), half(x)]
        out.append(replace(out[-1], dims=tuple(dims), order=None))
    return out


def memory_estimate(specs: list[ArraySpec]) -> int:
    """Bytes that streaming the arrays may hold: buffered frames, a frame, and the chunk layers of each array."""
    frame = max(Layout(s).frame_bytes for s in specs)
    lo, hi = QUEUE_FRAMES
    total = frame * max(lo, min(hi, QUEUE_BYTES // frame))
    for s in specs:
        own = Layout(s)
        sizes = [d.chunk * d.chunks for d in own.axes[1:]]
        if own.banded:
            sizes[0] = own.axes[1].chunk
        layer = own.axes[0].chunk * prod(sizes) * own.bytes
        total += own.frame_bytes + layer * (1 + (s.compressor != "none")) * (1 + (s.method is not None))
    return total
