"""Chunks and shards as tables: which chunks a shard has, and which of its slots stay empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridloom.functions import lattice as la
from gridloom.plans.layout import Layout


def placed(chunks: DataFrame, layout: Layout) -> DataFrame:
    """``chunks`` (chunk) with layer, shard (index within its append shard), slot and path."""
    c = F.col("chunk")
    return chunks.select("chunk", la.div(c, layout.layer_chunks).alias("layer"), la.shard_of(layout, c).alias("shard"), la.slot_of(layout, c).alias("slot"), la.shard_path(layout, c).alias("path"))


def chunks_by_shard(chunks: DataFrame, layout: Layout) -> DataFrame:
    """(layer, shard, chunks): the chunks of each shard that a chunk layer fills, ascending; as many as a shard has slots at most."""
    return placed(chunks, layout).groupBy("layer", "shard").agg(F.sort_array(F.collect_list("chunk")).alias("chunks"))


def empty_slots(chunks: DataFrame, layout: Layout) -> DataFrame:
    """(path, slot): slots of the shards of ``chunks`` that no chunk fills, as the shard reaches over the array's edge or is not full yet."""
    have = placed(chunks, layout)
    slots = have.select("path").distinct().select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(layout.slots - 1).cast("long"))).alias("slot"))
    return slots.join(have.select("path", "slot"), ["path", "slot"], "left_anti")
