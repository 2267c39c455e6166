"""The epoch loop: each epoch selects with the state that the one before it left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallow.operators import scoring, selection
from tallow.plans.checkpoints import cut

Method = Callable[[DataFrame, int, int], DataFrame]


def full(pool: DataFrame, k: int, epoch: int) -> DataFrame:
    return pool.select("pool_id")


def random(pool: DataFrame, k: int, epoch: int) -> DataFrame:
    return selection.random_subset(pool, k, 42 + 100 * epoch, "random").select("pool_id")


def legacy(pool: DataFrame, k: int, epoch: int) -> DataFrame:
    scored = scoring.min_max(scoring.pool_reward(pool), "align_raw", "align")
    scored = scored.withColumn("score", scoring.legacy_score(F.col("reward"), F.col("align"), 0.5))
    return selection.top(scored, "score", k).select("pool_id")


def difficulty(pool: DataFrame, k: int, epoch: int) -> DataFrame:
    """Progress since the last epoch inside the last selection, loss outside; needs loss_prev and selected_prev."""
    x = F.when(F.col("selected_prev"), F.greatest(F.col("loss_prev") - F.col("loss"), F.lit(0.0))).otherwise(F.col("loss"))
    return selection.top(scoring.rank01(pool.withColumn("_x", x), "_x", "score", ["selected_prev"]), "score", k).select("pool_id")


METHODS: dict[str, Method] = {"full": full, "random": random, "legacy": legacy, "difficulty": difficulty}


def run(signals: DataFrame, method: str, epochs: int, k: int, static: bool = False) -> DataFrame:
    """(epoch, pool_id) of every epoch; ``signals`` has a row per (epoch, pool_id). A static arm keeps its first choice."""
    out, before, chosen = None, None, None
    for epoch in range(1, epochs + 1):
        pool = signals.filter(F.col("epoch") == epoch).drop("epoch")
        if before is None:
            state = pool.withColumn("loss_prev", F.col("loss")).withColumn("selected_prev", F.lit(False))
        else:
            last = before.select("pool_id", F.col("loss").alias("loss_prev"))
            marks = chosen.select("pool_id", F.lit(True).alias("selected_prev"))
            state = pool.join(last, "pool_id", "left").join(marks, "pool_id", "left").na.fill({"selected_prev": False}).withColumn("loss_prev", F.coalesce("loss_prev", "loss"))
        if chosen is None or not static:
            chosen = cut(METHODS[method](state, k, epoch))
        rows = chosen.select(F.lit(epoch).alias("epoch"), "pool_id")
        out, before = rows if out is None else out.unionByName(rows), pool
    return out
