"""Connected components of edge tables, in DataFrame expressions only."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._shared import leaving_no_shuffles, materialise, release

#: Up to so many edges (16 bytes each) the driver joins the nodes itself: a round of shuffles costs more than they do.
DRIVER_EDGES = 1 << 17


def _mark(edges: DataFrame) -> tuple:
    with leaving_no_shuffles(edges.sparkSession):
        return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _joined(edges: DataFrame) -> DataFrame:
    """``components`` of a few edges (u, v), on the driver."""
    got = edges.toArrow()
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for u, v in zip(got["u"].to_pylist(), got["v"].to_pylist(), strict=True):
        a, b = root(u), root(v)
        up[max(a, b)] = min(a, b)
    nodes = list(up)
    return edges.sparkSession.createDataFrame(pa.table({"node": pa.array(nodes, pa.int64()), "root": pa.array([root(x) for x in nodes], pa.int64())}))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``: ``root`` is the smallest node of its component.

    Alternating large-star and small-star steps (Kiveris et al. 2014): the number of rounds grows with the
    logarithm of the number of nodes, no step makes more rows than there are edges, minima are combined before the shuffle, and a node with
    very many edges is dealt out by adaptive skew joins. Each round is written to the checkpoint folder, so a lost executor
    costs one round at most, and goes when the next one is. No more than DRIVER_EDGES edges are joined by the driver instead.
    """
    now = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = materialise(now)
    mark = _mark(now)
    if mark[0] <= DRIVER_EDGES:
        groups = _joined(now)
        release(now)
        return groups
    while mark[0]:
        # large star: links each larger neighbour of a node to the smallest of the node and its neighbours
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")).select("k", F.least("k", "m").alias("m"))
        large = now.select(F.col("v").alias("x"), F.col("u").alias("y")).join(low, F.col("x") == F.col("k")).select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        # small star: links a node and its smaller neighbours to the smallest of these
        low = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("k")).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        old, now = now, materialise(small.filter(F.col("u") != F.col("v")).distinct())
        release(old)
        last, mark = mark, _mark(now)
        if mark == last:
            break
    roots = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct().join(roots.select("node"), "node", "left_anti"))
