"""Finding files by Hadoop's file systems: globs in order, look-alikes of a missing file, what a data set lacks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = "*?[{"


class NoSuchFiles(FileNotFoundError):
    pass


def globbed(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that a glob, or a plain path, matches, sorted; none is no error."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().toString() for f in found or [])


def resolved(spark: SparkSession, spec: str) -> list[str]:
    """A glob's matches, a path that exists, or files beside a missing one whose names begin with its first word."""
    if found := globbed(spark, spec):
        return found
    if not any(c in spec for c in MAGIC):
        folder, _, name = spec.rpartition("/")
        stem = name.rsplit(".", 1)[0]
        head = stem.split("-", 1)[0]
        for suffix in ("json", "jsonl", "parquet"):
            if found := globbed(spark, f"{folder or '.'}/{head}*.{suffix}"):
                return found
    raise NoSuchFiles(spec)


def split_files(spark: SparkSession, folder: str, split: str) -> list[str]:
    """Parquet files of a split (``train-*``), else all of the folder."""
    for pattern in (f"{split}-*.parquet", f"{split}.parquet", f"{split}*.parquet", "*.parquet"):
        if found := globbed(spark, f"{folder}/{pattern}"):
            return found
    raise NoSuchFiles(f"{folder}: no Parquet files")


def lacking(spark: SparkSession, folder: str, needs: list[str]) -> list[str]:
    """The needs that nothing in the folder meets; ``a|b`` is met by either."""
    return [need for need in needs if not any(globbed(spark, f"{folder}/{one}") for one in need.split("|"))]


def one_of_many(spark: SparkSession, folder: str, needs: list[str], least: int = 3) -> bool:
    """Whether so many folders beside it meet the same needs: then it is a subset, not the data set."""
    parent, _, own = folder.rstrip("/").rpartition("/")
    beside = [p for p in globbed(spark, f"{parent}/*") if p.rsplit("/", 1)[1] != own]
    return sum(not lacking(spark, p, needs) for p in beside) >= least


def suggestions(spark: SparkSession, root: str, needs: list[str], depth: int = 4) -> list[str]:
    """Folders below ``root`` that meet all needs, the nearest first."""
    found = []
    for level in range(depth + 1):
        first = needs[0].split("|")[0]
        for path in globbed(spark, "/".join([root.rstrip("/"), *["*"] * level, first])):
            folder = path[: -len("/".join(path.rsplit("/", first.count("/") + 1)[1:])) - 1]
            if folder not in found and not lacking(spark, folder, needs):
                found.append(folder)
    return found


def bad_lines(spark: SparkSession, path: str, limit: int = 10) -> DataFrame:
    """line (from 1, of the file's one partition) and beginning of the first lines that are no JSON; blank lines are passed."""
    lines = spark.read.option("wholetext", False).text(path).coalesce(1).withColumn("line", F.monotonically_increasing_id() + 1)
    return lines.filter((F.trim("value") != "") & F.expr("try_parse_json(value) IS NULL")).orderBy("line").limit(limit).select("line", F.left("value", F.lit(80)).alias("text"))


def inspected(rows: DataFrame, width: int = 60) -> DataFrame:
    """column, type, sample: a row a column of a table."""
    first = rows.limit(1).select(F.to_json(F.struct("*")).alias("j")).collect()
    values = json.loads(first[0]["j"]) if first else {}
    shown = [(n, t, str(values.get(n, ""))[:width]) for n, t in rows.dtypes]
    return rows.sparkSession.createDataFrame(shown, "column string, type string, sample string")
