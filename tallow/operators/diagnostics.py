"""Detection and selection diagnostics: average precision, dirty share, length bias, overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallow.operators.ranks import numbered, running
from tallow.operators.scoring import rank01


def average_precision(rows: DataFrame, score: str, label: str, key: str, by: list[str] | None = None) -> DataFrame:
    """Precision averaged over the positives in order of score; null without a positive."""
    by = by or []
    if by:
        order = Window.partitionBy(*by).orderBy(F.desc(score), key)
        placed = rows.withColumns({"_upto": F.sum(label).over(order.rowsBetween(Window.unboundedPreceding, 0)), "_at": F.row_number().over(order)})
    else:
        placed = running(rows.select(score, label, key), [F.desc(score), F.col(key)], {"_upto": F.col(label), "_at": F.lit(1)})
    ranked = placed.select(*by, label, (F.col("_upto") / F.col("_at")).alias("p"))
    found = ranked.groupBy(*by) if by else ranked.groupBy()
    return found.agg(F.avg(F.when(F.col(label) == 1, F.col("p"))).alias("ap"), F.sum(label).alias("positives"))


def top_share(rows: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """Marks the best k rows: in_top."""
    best = rows.orderBy(F.desc(score), key).limit(k).select(F.col(key).alias("_k"))
    return rows.join(best, rows[key] == best["_k"], "left").withColumn("in_top", F.col("_k").isNotNull()).drop("_k")


def dirty_at(rows: DataFrame, score: str, label: str, key: str, k: int) -> DataFrame:
    return rows.orderBy(F.desc(score), key).limit(k).agg(F.avg(label).alias("dirty_share"), F.count("*").alias("k"))


def reject_rate(rows: DataFrame, score: str, key: str, k: int, by: str) -> DataFrame:
    return top_share(rows, score, key, k).groupBy(by).agg(F.count("*").alias("n"), (1 - F.avg(F.col("in_top").cast("double"))).alias("reject_rate"))


def cluster_fraction(rows: DataFrame, cluster: str) -> DataFrame:
    """Distinct clusters, each row without one counting for itself, over rows."""
    alone, apart = F.count_if(F.col(cluster) < 0), F.count_distinct(F.when(F.col(cluster) >= 0, F.col(cluster)))
    return rows.agg(((alone + apart) / F.count("*")).alias("fraction"), F.count("*").alias("n"))


def length_bias(rows: DataFrame, length: str, score: str, label: str, key: str, bins: int = 5) -> DataFrame:
    # the first n mod bins bins hold one row more
    placed = numbered(rows, [length, key], "_at").crossJoin(F.broadcast(rows.agg(F.count("*").alias("_n"))))
    each, more = F.floor(F.col("_n") / bins), F.col("_n") % bins
    large = more * (each + 1)
    b = F.when(F.col("_at") < large, F.floor(F.col("_at") / (each + 1))).otherwise(more + F.floor(F.try_divide(F.col("_at") - large, each))) + 1
    return placed.withColumn("bin", b.cast("int")).groupBy("bin").agg(
        F.count("*").alias("n"), F.min(length).alias("min_len"), F.max(length).alias("max_len"), F.avg(length).alias("mean_len"),
        F.avg(score).alias("mean_score"), F.avg((F.col(score) <= 0).cast("double")).alias("zero_rate"), F.avg(label).alias("dirty_rate"),
    )


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of mid-ranks; 0 where one is constant."""
    return rank01(rank01(rows, a, "_ra"), b, "_rb").agg(F.coalesce(F.nanvl(F.corr("_ra", "_rb"), F.lit(0.0)), F.lit(0.0)).alias("spearman"))


def purity(selected: DataFrame, by: list[str], kind: str, clean: str = "clean") -> DataFrame:
    return selected.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col(kind) != clean).cast("double")).alias("dirty_share"))


def overlap(selected: DataFrame, arm: str, epoch: str, key: str) -> DataFrame:
    """For each epoch and pair of arms: both, either, Jaccard, share of the smaller."""
    sizes = selected.groupBy(epoch, arm).agg(F.count("*").alias("n"))
    a = selected.select(epoch, key, F.col(arm).alias("arm_a"))
    b = selected.select(epoch, key, F.col(arm).alias("arm_b"))
    both = a.join(b, [epoch, key]).filter("arm_a < arm_b").groupBy(epoch, "arm_a", "arm_b").agg(F.count("*").alias("both"))
    sa = sizes.select(epoch, F.col(arm).alias("arm_a"), F.col("n").alias("na"))
    sb = sizes.select(epoch, F.col(arm).alias("arm_b"), F.col("n").alias("nb"))
    pairs = sa.join(sb, epoch).filter("arm_a < arm_b").join(both, [epoch, "arm_a", "arm_b"], "left")
    n = F.coalesce("both", F.lit(0))
    return pairs.select(epoch, "arm_a", "arm_b", n.alias("both"), (F.col("na") + F.col("nb") - n).alias("either"), (n / (F.col("na") + F.col("nb") - n)).alias("jaccard"), (n / F.least("na", "nb")).alias("of_smaller"))


def shift(rows: DataFrame, value: str, group: str) -> DataFrame:
    """Quartiles by group, and each group's median shift from all in units of the overall quartile range."""
    overall = rows.agg(F.percentile(value, 0.5).alias("_m"), (F.percentile(value, 0.75) - F.percentile(value, 0.25)).alias("_iqr"))
    q = rows.groupBy(group).agg(*[F.percentile(value, p).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    s = (F.col("median") - F.col("_m")) / F.col("_iqr")
    return q.crossJoin(F.broadcast(overall)).select(group, "q1", "median", "q3", s.alias("shift"), (F.abs(s) > 0.25).alias("flagged"))


def floor_block(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Rows at exactly zero: how many, how dirty, against the base rate, and the share of dirt they catch."""
    zero = F.col(score) <= 0
    dirty = F.avg(F.when(zero, F.col(label)))
    return rows.agg(F.count_if(zero).alias("n_floor"), dirty.alias("purity"), (dirty / F.avg(label)).alias("enrichment"), (F.sum(F.when(zero, F.col(label))) / F.sum(label)).alias("recall"))


def nearest_rank(rows: DataFrame, value: str, key: str, shares: list[float]) -> DataFrame:
    """Percentiles by nearest rank: the value at position floor(q n)."""
    ranked = numbered(rows.select(F.col(value).alias("value"), F.col(key).alias("_key")), ["value", "_key"], "_at").crossJoin(F.broadcast(rows.agg(F.count("*").alias("_n"))))
    wanted = F.explode(F.array(*map(F.lit, shares))).alias("share")
    return ranked.select("*", wanted).filter(F.col("_at") == F.least(F.floor(F.col("share") * F.col("_n")), F.col("_n") - 1)).select("share", "value")
