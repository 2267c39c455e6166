"""Budgeted selection with a total order: score descending, key ascending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallow.functions.hashing import seeded
from tallow.operators.ranks import numbered
from tallow.operators.scoring import rank01


def budget(n: int, ratio: float) -> int:
    return max(1, int(n * ratio))


def guard(rows: DataFrame, column: str) -> Column:
    """The column, raising on null, NaN or infinity: a ranking must not order what is not a number."""
    bad = F.col(column).isNull() | F.isnan(column) | (F.abs(column) == float("inf"))
    return F.when(bad, F.raise_error(F.lit(f"{column} holds a null, NaN or infinity")).cast("double")).otherwise(F.col(column))


def top(rows: DataFrame, score: str, k: int, key: str = "pool_id", exact: bool = False) -> DataFrame:
    """The best k; a budget of none, or (``exact``) beyond the table, is an error."""
    if k <= 0:
        raise ValueError("the budget must be positive")
    if exact and rows.limit(k).count() < k:
        raise ValueError("the budget is larger than the table")
    return rows.withColumn(score, guard(rows, score)).orderBy(F.desc(score), key).limit(k)


def gated_key(rows: DataFrame, score: str, fallback: str, gate: str) -> DataFrame:
    """select_key: 2 + rank of the score where the gate is open, else the rank of the fallback."""
    rows = rows.withColumns({c: guard(rows, c) for c in (score, fallback, gate)})
    ranked = rank01(rank01(rows, score, "_rs"), fallback, "_rf")
    return ranked.withColumn("select_key", F.when(F.col(gate) > 0, 2 + F.col("_rs")).otherwise(F.col("_rf"))).drop("_rs", "_rf")


def constrained_top(rows: DataFrame, score: str, cluster: str, k: int, key: str = "pool_id") -> DataFrame:
    """At most one a cluster (negative: none), refilled from the best left over when clusters run out."""
    first = F.row_number().over(Window.partitionBy(cluster, F.when(F.col(cluster) < 0, F.col(key))).orderBy(F.desc(score), key)) == 1
    return rows.withColumn("is_extra", ~first).orderBy("is_extra", F.desc(score), key).limit(k)


def random_subset(rows: DataFrame, k: int, seed: int, op: str, key: str = "pool_id") -> DataFrame:
    return rows.orderBy(seeded(seed, op, F.col(key)), key).limit(k)


def range_top(rows: DataFrame, column: str, low: float, high: float, k: int, key: str = "pool_id") -> DataFrame:
    """The best k inside [low, high]; of all valid rows where fewer than k lie inside."""
    ok = rows.filter(F.col(column).isNotNull() & ~F.isnan(column)).withColumn("inside", F.col(column).between(low, high))
    enough = ok.agg((F.count_if("inside") >= k).alias("_enough"))
    return ok.crossJoin(F.broadcast(enough)).filter("inside OR NOT _enough").drop("_enough").orderBy(F.desc(column), key).limit(k)


def length_batches(rows: DataFrame, length: str, size: int, key: str = "pool_id") -> DataFrame:
    """Batches of equal size, longest rows first."""
    return numbered(rows, [F.desc(length), F.col(key)], "batch").withColumn("batch", F.floor(F.col("batch") / size))
