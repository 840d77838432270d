"""Reliable checkpoints: tables written to the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names.

    Only a local master (tests) may go without the setting; a cluster's executors do not share a temporary folder.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named and (given := sc._jsc.sc().getCheckpointDir()).isDefined():
        named = given.get()
    if not named and sc.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir names no shared folder")
    return named or os.path.join(tempfile.gettempdir(), "gridloom-checkpoints")


@contextmanager
def leaving_no_shuffles(spark: SparkSession) -> Iterator[None]:
    """What a DataFrame made and run in this context shuffles is deleted when its action ends, not when the driver happens to collect its garbage.

    Adaptive execution may leave jobs behind whose result it found it can do without (the other side of an empty join). They
    are cancelled, as they would look for deleted files until they time out.
    """
    sc, tag = spark.sparkContext, f"gridloom-{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    sc.addJobTag(tag)
    try:
        yield
    finally:
        sc.removeJobTag(tag)
        sc.cancelJobsWithTag(tag)
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def materialise(df: DataFrame) -> DataFrame:
    """``df`` written to the session's checkpoint folder and read back, so that lineage ends here and its shuffles can go."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder(df.sparkSession))
    with leaving_no_shuffles(df.sparkSession):
        # a plan of its own, as ``df`` keeps the setting it was made with
        return df.select("*").checkpoint(eager=True)


def release(*made: DataFrame) -> None:
    """Deletes the files of tables that ``materialise`` returned; nothing that reads them may run after that."""
    for df in made:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(df._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get())
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
