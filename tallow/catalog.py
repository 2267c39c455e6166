"""The registered queries of the library: name -> DataFrame function, name -> SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallow.queries import diagnosing, evaluating, gating, plans, signalling, texts

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (gating, diagnosing, texts, plans, evaluating, signalling)


def queries() -> dict[str, Query]:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reliability gate, best records first."""
    return gating.gate_lineitem(spark, sf_dir).orderBy(F.desc("gate"), "pool_id")
