"""Helpers shared by the corpus operators: scratch tables, table access, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OPEN: list["Scratch"] = []
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only where it is unset, in one JVM."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tallow-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of Spark for what is executed here."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shuffles_dropped(spark: SparkSession):
    """Spark drops the shuffle files of what is executed here as soon as it has ended."""
    return setting(spark, CLEAN_UP, "true")


class Scratch:
    """Tables written to the shared checkpoint folder to cut lineage.

    A written table survives the loss of any executor, is computed once, and (unlike a
    cache) leaves executor memory alone.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/tallow-{name}-{uuid.uuid4().hex}"
        _OPEN.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        with shuffles_dropped(self.spark):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def detach(self) -> None:
        """Leave this folder out of ``release_scratch``."""
        _OPEN.remove(self)

    def close(self) -> None:
        self.drop()
        if self in _OPEN:
            _OPEN.remove(self)


def release_scratch(spark: SparkSession) -> None:
    """Drop every scratch table; call it once the results that read them have been written."""
    for scratch in list(_OPEN):
        if scratch.spark.sparkContext is spark.sparkContext:
            scratch.close()
        else:
            _OPEN.remove(scratch)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, like the given ones."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times inside one expression."""
    return F.transform(F.array(value), body).getItem(0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows: the check before a broadcast."""
    return df.limit(rows + 1).count() <= rows
