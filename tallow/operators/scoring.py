"""Scores over a pool: rewards, normalisations, ranks in [0, 1], fused scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallow.operators.ranks import numbered, running
from tallow.plans.checkpoints import cut

EPS = 1e-8


def with_row(rows: DataFrame, one: DataFrame) -> DataFrame:
    """Adds the columns of a one-row table."""
    return rows.crossJoin(F.broadcast(one))


def pool_reward(rows: DataFrame, loss: str = "loss", entropy: str = "entropy") -> DataFrame:
    """w = Var(L) / (Var(L) + Var(H)) and reward = w L + (1 - w) H; w = 0.5 below two rows."""
    vl, vh = F.var_samp(loss), F.var_samp(entropy)
    w = rows.agg(F.when(F.count("*") < 2, 0.5).otherwise(vl / (vl + vh + EPS)).alias("w"))
    return with_row(rows, w).withColumn("reward", F.col("w") * F.col(loss) + (1 - F.col("w")) * F.col(entropy))


def min_max(rows: DataFrame, column: str, out: str) -> DataFrame:
    """Scaled to [0, 1]; 0.5 where all are alike."""
    ends = rows.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    return with_row(rows, ends).withColumn(out, F.when(span < EPS, 0.5).otherwise((F.col(column) - F.col("_lo")) / span)).drop("_lo", "_hi")


def z_score(rows: DataFrame, column: str, out: str, floor: float = 1e-4) -> DataFrame:
    stats = rows.agg(F.avg(column).alias("_mean"), F.stddev_pop(column).alias("_sd"))
    return with_row(rows, stats).withColumn(out, (F.col(column) - F.col("_mean")) / F.greatest("_sd", F.lit(floor))).drop("_mean", "_sd")


def rank01(rows: DataFrame, column: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Mid-ranks scaled to [0, 1]; 0.5 for one row.

    Ranks are summed over the distinct values of each group, not over its rows: rows meet by
    value, and ties cost nothing. A null has no rank (null) and counts for no other's. The rows
    are evaluated once: a sum in another order may differ by a bit, and would not meet its rank.
    """
    by, rows = by or [], cut(rows)
    counts = rows.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_n"))
    if by:
        groups = Window.partitionBy(*by)
        ranked = counts.withColumns({"_upto": F.sum("_n").over(groups.orderBy(column)), "_all": F.sum("_n").over(groups)})
    else:
        ranked = with_row(running(counts, [column], {"_upto": F.col("_n")}), counts.agg(F.sum("_n").alias("_all")))
    ranked = ranked.select(*by, F.col(column).alias("_v"), "_n", "_upto", "_all")
    mid = ranked.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)],
        "_v",
        F.when(F.col("_all") == 1, 0.5).otherwise((F.col("_upto") - F.col("_n") + (F.col("_n") - 1).cast("double") / 2) / (F.col("_all") - 1)).alias(out),
    )
    on = rows[column] == mid["_v"]
    for i, c in enumerate(by):
        on = on & rows[c].eqNullSafe(mid[f"_k{i}"])
    return rows.join(mid, on, "left").drop("_v", *[f"_k{i}" for i in range(len(by))])


def rank01_positional(rows: DataFrame, column: str, key: str, out: str) -> DataFrame:
    """Ranks by (value, key) scaled to [0, 1]."""
    n = rows.agg(F.count("*").alias("_all"))
    placed = with_row(numbered(rows, [column, key], "_at"), n)
    return placed.withColumn(out, F.when(F.col("_all") == 1, 0.5).otherwise(F.col("_at") / (F.col("_all") - 1))).drop("_all", "_at")


def legacy_score(reward: Column, align: Column, lam: float) -> Column:
    return reward * (1 + lam * align)


def gated_score(gate: Column, reward: Column, align: Column, lam: float) -> Column:
    return gate * legacy_score(reward, align, lam)


def mvf_score(quality: Column, difficulty: Column, align: Column, gamma: float = 1.0, lam: float = 0.5, floor: float = 0.1, eps: float = 1e-3) -> Column:
    return F.pow(quality + eps, F.lit(gamma)) * (floor + (1 - floor) * difficulty + eps) * (1 + lam * align)


def progress(history: DataFrame, key: str = "pool_id", epoch: str = "epoch", loss: str = "loss") -> DataFrame:
    """max(L[t-1] - L[t], 0); null in the first epoch."""
    before = F.lag(loss).over(Window.partitionBy(key).orderBy(epoch))
    return history.withColumn("progress", F.greatest(before - F.col(loss), F.lit(0.0)))


def ifd(cond: Column, uncond: Column) -> Column:
    return F.exp(F.greatest(F.lit(-15.0), F.least(F.lit(15.0), cond - uncond)))


def ifd_ratio(cond: Column, uncond: Column) -> Column:
    ratio = F.try_divide(cond, uncond)
    return F.when(ratio > 1, 0.0).otherwise(ratio)


def learnable_difficulty(history: DataFrame, selected: str = "selected_prev") -> DataFrame:
    """Rank of progress inside the previous selection, rank of loss outside."""
    rows = progress(history).withColumn("_x", F.when(F.col(selected), F.col("progress")).otherwise(F.col("loss")))
    return rank01(rows.filter("_x IS NOT NULL"), "_x", "difficulty", [selected]).drop("_x")
