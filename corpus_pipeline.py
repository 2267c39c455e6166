"""The corpus pipeline: each stage works on all that the one before it kept.

language ID -> line dedup -> near duplicates -> decontamination -> packing. ``run`` writes
each stage's rows to the shared checkpoint folder and rereads them as the next one's input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallow.llm import decontaminate, language, lines, packing, simhash
from tallow.llm.common import Scratch, read_table, release_scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are rejected by distance, or have no letter, go."""
    return language.keep_identified(spark, docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each group of near-equal lines stays; emptied documents go."""
    release_scratch(spark)
    return lines.dedup_lines(spark, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, Jaccard 0.8) stays."""
    release_scratch(spark)
    return simhash.keep_one(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    release_scratch(spark)
    return decontaminate.decontaminate(spark, docs, read_table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece, with its sequence and place."""
    release_scratch(spark)
    return packing.pack_documents(spark, docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: No stage is expressible in SQL as a whole (hashed centroids, MinHash, a tokenizer).
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        rows = stage(spark, docs, sf_dir)
        if name == STAGES[-1][0]:
            return rows
        scratch = Scratch(spark, f"stage-{name}")
        path = scratch.path("rows")
        rows.write.parquet(path)
        docs = spark.read.schema(rows.schema).parquet(path)
        scratch.detach()
        if last:
            last.drop()
        last = scratch
    return docs
