"""Small helpers that several training-data operators use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridloom.checkpoints import folder as shared_folder, leaving_no_shuffles, materialise, release

__all__ = ["SPACES", "leaving_no_shuffles", "let", "make_room", "materialise", "partitions_for", "read_table", "release", "shared_folder", "words"]

#: Split pattern of the word definition that the operators share: runs without space, tab, \n, \v, \f, \r.
SPACES = "[ \\t-\\r]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once.

    Catalyst may inline a column that a lambda refers to into the lambda's body and so evaluate it for
    every element; binding it as the variable of an outer lambda rules that out.
    """
    return F.transform(F.array(value), use).getItem(0)


def words(text: Column) -> Column:
    """Array of the words of ``text``; empty for null."""
    return F.coalesce(F.array_remove(F.split(text, SPACES, -1), ""), F.array().cast("array<string>"))


def make_room(df: DataFrame, *made: str) -> DataFrame:
    """``df`` without columns named like those that an operator is about to add: the operator's win."""
    taken = {m.lower() for m in made}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def partitions_for(df: DataFrame, least: int = 0) -> int:
    """Partitions to deal rows into: the session's setting, which the cluster sizes to its input."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), least, 1)
