"""Pooling of arrays in long form (one row a pixel) and the pyramid of levels.

Whole numbers are pooled by grouped aggregation with partial sums before the one shuffle a level needs; decimation is a filter
and needs none. An odd last row or column counts twice, as if the edge were repeated. Means of whole numbers truncate toward zero at every
level. Floats are pooled corner by corner in a fixed order and in their own type; a NaN in the first corner stays, others are passed over by
minimum and maximum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType, DecimalType, DoubleType, FloatType

from gridloom.checkpoints import materialise
from gridloom.functions.lattice import div
from gridloom.plans.layout import METHODS, ArraySpec, levels


def _check(method: str) -> None:
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")


def _is_float(df: DataFrame, value: str) -> bool:
    return isinstance(df.schema[value].dataType, (FloatType, DoubleType))


def _quotient(total: Column, n: Column, kind: DataType) -> Column:
    """Whole quotient toward zero, in the pixel's own type; unsigned 64-bit pixels are decimals."""
    return F.floor(total / n).cast(kind) if isinstance(kind, DecimalType) else F.call_function("div", total, n).cast("long")


def pool_xy(df: DataFrame, group: list[str], height: int, width: int, method: str, value: str = "v") -> DataFrame:
    """Halves ``y`` and ``x`` of rows (*group, y, x, value)."""
    _check(method)
    keys = [*group, div(F.col("y"), 2).alias("y"), div(F.col("x"), 2).alias("x")]
    if method == "decimate":
        return df.filter((F.col("y") % 2 == 0) & (F.col("x") % 2 == 0)).select(*keys, value)
    if _is_float(df, value):
        return pool_floats(df, group, method, value)
    if method in ("min", "max"):
        return df.groupBy(*keys).agg(getattr(F, method)(value).alias(value))
    weight = F.lit(1)
    for axis, size in (("y", height), ("x", width)):
        if size % 2:
            weight = weight * F.when(F.col(axis) == size - 1, 2).otherwise(1)
    return df.groupBy(*keys).agg(_quotient(F.sum(F.col(value) * weight), F.lit(4), df.schema[value].dataType).alias(value))


def pool_z(df: DataFrame, group: list[str], depth: int, method: str, value: str = "v") -> DataFrame:
    """Halves ``z``: pairs of planes are pooled, an odd last plane stays, a plane whose partner never came is dropped."""
    _check(method)
    keys = [*group, div(F.col("z"), 2).alias("z"), "y", "x"]
    kind = df.schema[value].dataType
    plane = lambda k: F.max(F.when(F.col("z") % 2 == k, F.col(value)))
    if method == "decimate":
        how = plane(0)
    elif _is_float(df, value):
        how = F.coalesce(fold([plane(0), plane(1)], method, kind), plane(0))
    else:
        how = {"mean": _quotient(F.sum(value), F.count(F.lit(1)), kind), "min": F.min(value), "max": F.max(value)}[method]
    out = df.groupBy(*keys).agg(how.alias(value), F.count(F.lit(1)).alias("_n"))
    alone = (F.col("z") == depth // 2) if depth % 2 else F.lit(False)
    return out.filter((F.col("_n") == 2) | alone).drop("_n")


def fold(corners: list[Column], method: str, kind: DataType) -> Column:
    """Float corners taken together in their order."""
    out = corners[0]
    if method == "decimate":
        return out
    if method == "mean":
        for c in corners[1:]:
            out = (out + c).cast(kind)
        return (out / len(corners)).cast(kind)
    for c in corners[1:]:
        beats = ~F.isnan(out) & ~F.isnan(c) & ((c < out) if method == "min" else (c > out))
        out = F.when(beats, c).otherwise(out)
    return out


def pool_floats(df: DataFrame, group: list[str], method: str, value: str = "v") -> DataFrame:
    """Halves ``y`` and ``x`` of floats; a missing corner repeats the edge."""
    _check(method)
    corner = lambda r, c: F.max(F.when((F.col("y") % 2 == r) & (F.col("x") % 2 == c), F.col(value)))
    kind = df.schema[value].dataType
    df = df.groupBy(*group, div(F.col("y"), 2).alias("y"), div(F.col("x"), 2).alias("x")).agg(corner(0, 0).alias("a"), corner(0, 1).alias("b"), corner(1, 0).alias("c"), corner(1, 1).alias("d"))
    corners = [F.col("a"), F.coalesce("b", "a"), F.coalesce("c", "a"), F.coalesce("d", "c", "b", "a")]
    return df.select(*group, "y", "x", fold(corners, method, kind).alias(value))


def pyramid(df: DataFrame, spec: ArraySpec, outer: list[str], value: str = "v") -> DataFrame:
    """Rows (level, *outer, z, y, x, value) of all levels of ``spec``; each level is made of the one before it, which is written first."""
    plans = levels(spec)
    out = df.select(F.lit(0).alias("level"), *outer, "z", "y", "x", value)
    now = df.select(*outer, "z", "y", "x", value)
    for k, (fine, coarse) in enumerate(zip(plans, plans[1:], strict=False), 1):
        (z, y, x), (cz, cy, _) = fine.axes[-3:], coarse.axes[-3:]
        if cy.size != y.size:
            now = pool_xy(now, [*outer, "z"], y.size, x.size, spec.method, value)
        if cz.size != z.size:
            now = pool_z(now, outer, z.size, spec.method, value)
        now = materialise(now.select(*outer, "z", "y", "x", value))
        out = out.unionByName(now.withColumn("level", F.lit(k)))
    return out
