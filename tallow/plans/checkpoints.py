"""Checkpoints in the shared folder of ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """Where Spark keeps checkpoints, below ``spark.checkpoint.dir``."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tallow-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` kept where every executor can read it; its lineage ends there."""
    folder(df.sparkSession)
    return df.checkpoint()


@contextmanager
def kept(*parts: DataFrame) -> Iterator[DataFrame]:
    """``parts`` as one table, for the time of the block.

    They are written one after the other, and the shuffle files of each go when it is written.
    """
    spark = parts[0].sparkSession
    path = f"{folder(spark)}/kept-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP)
    try:
        spark.conf.set(CLEAN_UP, "true")
        try:
            for part in parts:
                part.write.mode("append").parquet(path)
        finally:
            spark.conf.set(CLEAN_UP, before)
        yield spark.read.schema(parts[0].schema).parquet(path)
    finally:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
