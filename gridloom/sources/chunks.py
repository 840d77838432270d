"""A Spark data source over stored arrays: one row a chunk, one partition a shard, and filters on chunk places prune both.

    register(spark)
    spark.read.format("gridloom").option("path", "/store/array").load().filter("t = 3")

The columns are the place of the chunk on each axis (named as the axis) and ``data``. Whole-number comparisons with a place reach the reader;
``spark.sql.python.filterPushdown.enabled`` must be true for that, which ``register`` sets. A shard is read index first, then only the chunks
asked for.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import BinaryType, LongType, StructType

from gridloom.plans.layout import ArraySpec, Dimension
from gridloom.sources.store import decoder, filesystem, read_index


def stored_spec(path: str) -> tuple[ArraySpec, list[int]]:
    """(specification, shape) of the array at ``path``, from its metadata."""
    fs, at = filesystem(path.rstrip("/"))
    with fs.open_input_stream(f"{at}/zarr.json") as f:
        doc = json.loads(f.read())
    inner = doc["codecs"][0]["configuration"]
    outer = doc["chunk_grid"]["configuration"]["chunk_shape"]
    codecs = {c["name"]: c.get("configuration", {}) for c in inner["codecs"]}
    compressor = "zstd" if "zstd" in codecs else f"blosc-{codecs['blosc']['cname']}" if "blosc" in codecs else "none"
    dims = tuple(Dimension(name, "space" if k >= len(outer) - 2 else "other", size, chunk, whole // chunk) for k, (name, size, chunk, whole) in enumerate(zip(doc["dimension_names"], doc["shape"], inner["chunk_shape"], outer, strict=True)))
    return ArraySpec("", doc["data_type"], dims, compressor=compressor), doc["shape"]


class ChunkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gridloom"

    def schema(self) -> StructType:
        out = StructType()
        for d in stored_spec(self.options["path"])[0].dims:
            out = out.add(d.name, LongType())
        return out.add("data", BinaryType())

    def reader(self, schema: StructType) -> ChunkReader:
        return ChunkReader(self.options["path"])


class Shard(InputPartition):
    def __init__(self, at: tuple[int, ...]):
        self.at = at


class ChunkReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.spec, self.shape = stored_spec(path)
        self.low = [0] * len(self.shape)
        self.high = [-(-n // d.chunk) - 1 for n, d in zip(self.shape, self.spec.dims, strict=True)]  # last place on each axis
        self.only: list[set[int] | None] = [None] * len(self.shape)

    def pushFilters(self, filters):
        names = [d.name for d in self.spec.dims]
        for f in filters:
            axis = names.index(f.attribute[0]) if getattr(f, "attribute", None) and len(f.attribute) == 1 and f.attribute[0] in names else None
            value = getattr(f, "value", None)
            if axis is not None and isinstance(f, In):
                some = set(value)
                self.only[axis] = some if self.only[axis] is None else self.only[axis] & some
            elif axis is not None and isinstance(value, int) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low[axis] = max(self.low[axis], value + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.high[axis] = min(self.high[axis], value - isinstance(f, LessThan))
            else:
                yield f

    def wanted(self, axis: int, place: int) -> bool:
        return self.low[axis] <= place <= self.high[axis] and (self.only[axis] is None or place in self.only[axis])

    def partitions(self) -> list[InputPartition]:
        """The shards that hold a chunk asked for."""
        from itertools import product

        axes = [sorted({p // d.shard for p in range(self.low[k], self.high[k] + 1) if self.wanted(k, p)}) for k, d in enumerate(self.spec.dims)]
        return [Shard(at) for at in product(*axes)]

    def read(self, partition: Shard):
        from itertools import product
        from math import prod

        dims, decode = self.spec.dims, decoder(self.spec)
        slots = prod(d.shard for d in dims)
        fs, base = filesystem(self.path)
        at = "/".join([base, "c", *map(str, partition.at)])
        if fs.get_file_info(at).size is None:
            return
        with fs.open_input_file(at) as f:
            f.seek(f.size() - 16 * slots - 4)
            index = read_index(f.read(), slots)
            places = [[p for p in range(s * d.shard, (s + 1) * d.shard) if self.wanted(k, p)] for k, (s, d) in enumerate(zip(partition.at, dims, strict=True))]
            for place in product(*places):
                slot = 0
                for p, d in zip(place, dims, strict=True):
                    slot = slot * d.shard + p % d.shard
                if slot in index:
                    f.seek(index[slot][0])
                    yield (*place, decode(f.read(index[slot][1])))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ChunkSource)
