"""What the operators leave on disk while they run."""

import os
import random
import time

from gridloom.checkpoints import materialise, release
from gridloom.llm import fuzzy_lines as fl
from pyspark.sql import functions as F


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def left_over(spark, before):
    """Shuffle files made since ``before``; Spark deletes them in the background."""
    for _ in range(50):
        if not (now := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    return now


def checkpoints(spark):
    at = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    return {x for x in os.listdir(at) if x.startswith("rdd-")} if os.path.isdir(at) else set()


def test_a_written_table_keeps_no_shuffles(spark):
    before, files = shuffle_files(spark), checkpoints(spark)
    counts = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    made = materialise(counts)
    assert not left_over(spark, before) and len(checkpoints(spark) - files) == 1
    assert {tuple(r) for r in made.collect()} == {(k, 100) for k in range(10)} == {tuple(r) for r in counts.collect()}
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None
    release(made)
    assert checkpoints(spark) == files


def test_rounds_of_fuzzy_lines_leave_one_table(spark):
    r = random.Random(3)
    lines = ["".join(r.choice("abcdefgh ijkl") for _ in range(80)) for _ in range(20)]
    texts = [(i, "\n".join(x[:i] + "7" + x[i + 1 :] for x in lines)) for i in range(12)]
    before, files = shuffle_files(spark), checkpoints(spark)
    groups = fl.line_components(spark.createDataFrame(texts, "doc_id long, text string"))
    assert not left_over(spark, before) and len(checkpoints(spark) - files) <= 1  # what the groups are read from
    assert groups.select("root").distinct().count() == 20 and groups.count() == 240


def test_few_edges_take_no_rounds(spark, monkeypatch):
    from gridloom.llm import _graph

    r = random.Random(5)
    edges = spark.createDataFrame([(r.randrange(-400, 400), r.randrange(-400, 400)) for _ in range(300)] + [(2**62, -(2**62))], "a long, b long")
    files = checkpoints(spark)
    small = {tuple(x) for x in _graph.components(edges).collect()}
    assert checkpoints(spark) == files  # the driver's own join writes no rounds
    monkeypatch.setattr(_graph, "DRIVER_EDGES", 0)
    assert small == {tuple(x) for x in _graph.components(edges).collect()}
    assert _graph.components(edges.limit(0)).count() == 0
