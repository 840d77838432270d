"""Checks, routing and re-framing of appended bytes and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.functions.lattice import div

#: Ids that one task numbers at a time; an array of any length is spread over many such runs.
RUN = 4096


def numbered(df: DataFrame, key: str, order: str, name: str = "place") -> DataFrame:
    """``df`` with the place (from 0) of each row among those of its key, by the whole number ``order``.

    Rows are numbered in runs of RUN ids; a small table of the runs' counts gives each its offset, so no task holds a whole key.
    """
    run = div(F.col(order) - F.pmod(F.col(order), F.lit(RUN)), RUN)
    rows = df.withColumn("_run", run)
    counts = rows.groupBy(key, "_run").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(key).alias("_key"), F.col("_run").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy(key, "_run").orderBy(order)) - 1
    rows = rows.withColumn("_within", place)
    rows = rows.join(starts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_run") == F.col("_at")))
    return rows.withColumn(name, (F.col("_start") + F.col("_within")).cast("long")).drop("_run", "_key", "_at", "_start", "_within")


def order_faults(frames: DataFrame, key: str = "array_key", frame: str = "frame_id") -> DataFrame:
    """Frames whose id is not the number of frames of their array before them."""
    return numbered(frames.select(key, frame), key, frame, "expected").filter(F.col(frame) != F.col("expected"))


def size_faults(frames: DataFrame, frame_bytes: int) -> DataFrame:
    """Frames whose data has not the size of a frame; frames without data too."""
    return frames.filter(F.coalesce(F.octet_length("data"), F.lit(-1)) != frame_bytes)


def within_bounds(frames: DataFrame, most_bytes: int, frame_bytes: int, frame: str = "frame_id") -> DataFrame:
    """The frames that a bounded array has room for; all of an unbounded one."""
    return frames.filter((F.col(frame) + 1) * frame_bytes <= most_bytes) if most_bytes else frames


def overflows(appends: DataFrame, most_bytes: int, key: str = "array_key", seq: str = "seq", size: str = "n_bytes") -> DataFrame:
    """``appends`` (key, seq, n_bytes) with ``accepted``: an append that would go beyond the array's room is rejected whole.

    Sizes are taken in the order of ``seq``; a rejected append and all later ones of its array count as not accepted, as the first
    error ends the stream.
    """
    if not most_bytes:
        return appends.withColumn("accepted", F.lit(True))
    so_far = F.sum(size).over(Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0))
    return appends.withColumn("accepted", so_far <= most_bytes)


def zero_filled(frames: DataFrame, n: int, frame: str, value: str) -> DataFrame:
    """All of frames 0..n-1; skipped ones have zeros."""
    ids = frames.sparkSession.range(n).withColumnRenamed("id", frame)
    return ids.join(frames, frame, "left").select(frame, F.coalesce(value, F.lit(0)).alias(value))


def reframed(total: Column, frame_bytes: int) -> tuple[Column, Column]:
    """(whole frames, bytes left over) of appended bytes."""
    return div(total, frame_bytes), total % frame_bytes


def routed(frames: DataFrame, specs: DataFrame, key: str = "array_key") -> DataFrame:
    """``frames`` with the columns of their array in ``specs``; frames of unknown arrays are left out (``unknown_keys`` has them).

    Without a key in a row, a store of one array takes it.
    """
    keys = specs.select(key).limit(2).collect()
    rows = frames.withColumn(key, F.coalesce(F.col(key), F.lit(keys[0][0]))) if len(keys) == 1 else frames
    return rows.join(specs, key)


def unknown_keys(frames: DataFrame, specs: DataFrame, key: str = "array_key") -> DataFrame:
    return frames.join(specs.select(key), key, "left_anti")
