"""Folders of runs: which exist, which are sealed, and the accuracies they hold. Files are listed and read by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallow.functions.schemas import recovered_seed
from tallow.operators.results import IntegrityError, require_agreement

SUMMARY = "benchmark string, accuracy double, limit int, summaries array<struct<benchmark:string,accuracy:double>>"
CONFIG = "seed int, git_sha string"


def listed(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, run (the folder), name, modified of the files below ``root``; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).drop("content")
    return rows.select("path", *placed(F.col("path")), F.col("modificationTime").alias("modified"))


def placed(path: Column) -> list[Column]:
    return [F.regexp_extract(path, r"^(.*)/[^/]*$", 1).alias("run"), F.element_at(F.split(path, "/"), -1).alias("name")]


def sealed(spark: SparkSession, root: str) -> DataFrame:
    """run: folders that hold the seal ``_complete``."""
    # Spark's readers pass over names that begin with _, so the seal is looked for by the file system
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    files, found = top.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(top, True), []
    while files.hasNext():
        path = files.next().getPath()
        if path.getName() == "_complete":
            found.append((path.getParent().toString(),))
    return spark.createDataFrame(found, "run string").select(same_folder(F.col("run")).alias("run"))


def same_folder(path: Column) -> Column:
    return F.regexp_replace(path, r"^file:/+", "/")


def readings(spark: SparkSession, root: str) -> DataFrame:
    """run, benchmark, accuracy, limit of every payload: files of one benchmark and summaries alike."""
    rows = spark.read.schema(SUMMARY).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(root)
    rows = rows.select("*", F.col("_metadata.file_path").alias("path")).select("*", *placed(F.col("path")))
    one = F.array(F.struct("benchmark", "accuracy"))
    each = F.explode(F.filter(F.coalesce("summaries", one), lambda s: s["benchmark"].isNotNull() & s["accuracy"].isNotNull()))
    rows = rows.select(same_folder(F.col("run")).alias("run"), "limit", each.alias("s"))
    return rows.select("run", "limit", "s.benchmark", "s.accuracy")


def configured(spark: SparkSession, root: str) -> DataFrame:
    """run, seed: from cfg.json, else from the path."""
    rows = spark.read.schema(CONFIG).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "cfg.json").json(root)
    rows = rows.select("seed", F.col("_metadata.file_path").alias("path")).select("seed", *placed(F.col("path")))
    return rows.select(same_folder(F.col("run")).alias("run"), "seed")


def accuracies(spark: SparkSession, root: str, runs: DataFrame | None = None, tolerance: float = 1e-9) -> DataFrame:
    """run, seed, benchmark, accuracy of the sealed runs (of ``runs``: run, or all below ``root``).

    A run that is named but not sealed, that saw a limited number of examples, or that holds
    two values of one benchmark is an error.
    """
    seals = sealed(spark, root)
    wanted = seals if runs is None else runs.select(same_folder(F.col("run")).alias("run")).distinct()
    if not wanted.join(seals, "run", "left_anti").isEmpty():
        raise IntegrityError("a run is not sealed")
    found = readings(spark, root).join(wanted, "run", "left_semi")
    if not found.filter("limit IS NOT NULL").isEmpty():
        raise IntegrityError("a run saw a limited number of examples")
    require_agreement(found, ["run", "benchmark"], "accuracy", tolerance)
    values = found.groupBy("run", "benchmark").agg(F.max("accuracy").alias("accuracy"))
    seeds = wanted.join(configured(spark, root), "run", "left").select("run", recovered_seed(F.col("seed"), F.col("run")).alias("seed"))
    return values.join(seeds, "run")


def pinned(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """The accuracies of a manifest's runs (set, model, method, seed, run_dir); a seed that the run contradicts is an error."""
    keyed = manifest.withColumn("run", same_folder(F.when(F.startswith("run_dir", F.lit("/")), F.col("run_dir")).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), "run_dir"))))
    rows = accuracies(spark, root, keyed).withColumnRenamed("seed", "run_seed").join(keyed, "run")
    if not rows.filter("run_seed <> seed").isEmpty():
        raise IntegrityError("a manifest names another seed than the run")
    return rows.drop("run_seed", "run_dir")


def latest(runs: DataFrame, by: list[str], tag: str = "tag", target: str | None = None) -> DataFrame:
    """The newest run of each group: that which ``target`` points to, else the largest tag."""
    pointed = F.coalesce((F.col(tag) == F.col(target)).cast("int"), F.lit(0)) if target else F.lit(0)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(pointed.desc(), F.desc(tag)))
    return runs.withColumn("_place", place).filter("_place = 1").drop("_place")


def sealed_epoch(checkpoints: DataFrame, by: list[str], name: str = "name") -> DataFrame:
    """The checkpoint to evaluate: epoch_last, else the largest sealed epoch_N."""
    number = F.regexp_extract(name, r"^epoch_([0-9]+)$", 1).try_cast("int")
    rank = F.when(F.col(name) == "epoch_last", F.lit(1 << 30)).otherwise(number)
    return checkpoints.filter("sealed").withColumn("_rank", rank).filter("_rank IS NOT NULL").groupBy(*by).agg(F.max_by(name, "_rank").alias(name))


def states(trained: DataFrame, evaluated: DataFrame, by: list[str]) -> DataFrame:
    """State of each cell: NEED-TRAIN, NEED-EVAL (also where the checkpoint is newer), LEGACY (no checkpoint) or DONE."""
    both = trained.select(*by, F.col("modified").alias("trained_at"), "sealed").join(evaluated.select(*by, F.col("modified").alias("evaluated_at")), by, "full")
    done = F.coalesce("sealed", F.lit(False))
    state = F.when(F.col("trained_at").isNull() & F.col("evaluated_at").isNotNull(), "LEGACY").when(~done, "NEED-TRAIN")
    return both.withColumn("state", state.when(F.col("evaluated_at").isNull() | (F.col("evaluated_at") < F.col("trained_at")), "NEED-EVAL").otherwise("DONE"))


def merged(shards: list[DataFrame], n: int, config: str = "config", key: str = "pool_id") -> DataFrame:
    """Shards as one table of n records; gaps, overlaps and shards of another configuration are errors."""
    rows = shards[0]
    for shard in shards[1:]:
        rows = rows.unionByName(shard)
    found = rows.agg(F.count_distinct(key).alias("keys"), F.count("*").alias("n"), F.count_distinct(config).alias("configs"), F.min(key).alias("low"), F.max(key).alias("high")).first()
    if found["configs"] != 1 or (found["keys"], found["n"], found["low"], found["high"]) != (n, n, 0, n - 1):
        raise IntegrityError(f"the shards do not cover {n} records once under one configuration")
    return rows


def preview(rows: DataFrame, width: int = 60) -> list[tuple[str, str, str]]:
    """Column, type and the first value, clipped."""
    first = rows.limit(1).collect()
    return [(n, t, "" if not first else str(first[0][n])[:width]) for n, t in rows.dtypes]
