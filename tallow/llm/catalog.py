"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallow.llm import decontaminate, html, language, lines, packing, quality, sharding, simhash, token_files, warc
from tallow.llm.common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_centroid_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(spark, read_table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, read_table(spark, sf_dir, "documents"))


def op3_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_classes(spark, read_table(spark, sf_dir, "documents"))


def op4_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(spark, read_table(spark, sf_dir, "documents"))


def op5_line_frequency_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(spark, read_table(spark, sf_dir, "documents"))


def op6_block_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read_table(spark, sf_dir, "pages"))


def op7_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, read_table(spark, sf_dir, "pages"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(spark, read_table(spark, sf_dir, "documents"))


def op10_simhash_gray_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_digest(spark, read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_centroid_language_id,
        op2_best_fit_packing,
        op3_fuzzy_line_dedup,
        op4_ring_sharding,
        op5_line_frequency_quality,
        op6_block_html_extraction,
        op7_winnowing_decontamination,
        op8_warc_salvage,
        op9_token_files,
        op10_simhash_gray_index,
    )
}

ORACLE_SQL: dict[str, str] = {}
