"""Results tables: macros, cells with intervals, paired tests, integrity checks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class IntegrityError(ValueError):
    pass


def macros(runs: DataFrame, by: list[str], benches: int, allow_partial: bool = False) -> DataFrame:
    """Mean accuracy over a run's benches; null where one is missing, unless partial runs are allowed."""
    each = runs.groupBy(*by, "bench").agg(F.avg("accuracy").alias("accuracy"))
    mean = F.avg("accuracy")
    return each.groupBy(*by).agg(F.count("*").alias("n_benches"), (mean if allow_partial else F.when(F.count("*") == benches, mean)).alias("macro"))


def micro_macro(rows: DataFrame, group: str, correct: str) -> DataFrame:
    inner = rows.groupBy(group).agg(F.avg(correct).alias("a"), F.sum(correct).alias("s"), F.count("*").alias("n"))
    return inner.agg(F.avg("a").alias("macro"), (F.sum("s") / F.sum("n")).alias("micro"))


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    value, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        term = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + term * d or 1e-300)
        c = 1 + term / c or 1e-300
        value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * (value - 1)


def t_cdf(t: float, df: float) -> float:
    half = beta_inc(df / 2, 0.5, df / (df + t * t)) / 2
    return 1 - half if t > 0 else half


def t_quantile(p: float, df: float) -> float:
    low, high = -1e6, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


def cells(values: DataFrame, by: list[str], value: str = "macro", level: float = 0.95, most: int = 200) -> DataFrame:
    """Mean, sample sd, half-width of the t interval (null below two seeds) and the seeds of each cell."""
    table = values.sparkSession.createDataFrame([(n, t_quantile((1 + level) / 2, n - 1)) for n in range(2, most + 1)], "_n long, _t double")
    agg = values.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n_seeds"), F.array_sort(F.collect_set("seed")).alias("seeds"))
    joined = agg.join(F.broadcast(table), F.least(agg["n_seeds"], F.lit(most)) == table["_n"], "left")
    return joined.withColumn("half_width", F.col("_t") * F.col("sd") / F.sqrt("n_seeds")).drop("_n", "_t")


def paired(values: DataFrame, method: str, a: str, b: str, on: list[str], value: str = "macro") -> DataFrame:
    left = values.filter(F.col(method) == a).select(*on, F.col(value).alias("_a"))
    right = values.filter(F.col(method) == b).select(*on, F.col(value).alias("_b"))
    return left.join(right, on).select(*on, (F.col("_a") - F.col("_b")).alias("diff"))


def sign_flip(diffs: DataFrame, by: list[str], most: int = 12, draws: int = 20_000, seed: int = 42) -> DataFrame:
    """Two-sided sign-flip p of each group's mean difference (a pair a seed: groups are small).

    Over all 2^n sign masks up to ``most`` pairs; beyond, (1 + hits) / (1 + draws) of seeded draws.
    """
    groups = diffs.groupBy(*by).agg(F.array_sort(F.collect_list("diff")).alias("d")).withColumn("k", F.size("d"))
    last = F.when(F.col("k") <= most, F.pow(F.lit(2), F.least("k", F.lit(most))).cast("int")).otherwise(draws) - 1
    masks = groups.withColumn("mask", F.explode(F.sequence(F.lit(0), last)))

    def flipped(i: Column) -> Column:
        drawn = F.pmod(F.xxhash64(F.lit(seed), "mask", i), F.lit(2)) == 1
        return F.when(F.col("k") <= most, F.getbit("mask", F.least(i, F.lit(30))) == 1).otherwise(drawn)

    total = F.aggregate(F.transform("d", lambda x, i: F.when(flipped(i), -x).otherwise(x)), F.lit(0.0), lambda s, x: s + x)
    seen = F.aggregate("d", F.lit(0.0), lambda s, x: s + x)
    hits, k = F.count_if(F.abs(total) >= F.abs(seen) - 1e-9), F.first("k")
    p = F.when(k <= most, hits / F.count("*")).otherwise((1 + hits) / (1 + F.count("*")))
    return masks.groupBy(*by).agg(k.alias("n"), F.first(seen / F.col("k")).alias("mean_diff"), p.alias("p"))


def holm(tests: DataFrame, p: str = "p", key: list[str] | None = None) -> DataFrame:
    order = Window.partitionBy(F.lit(0)).orderBy(p, *(key or []))
    m = F.count("*").over(Window.partitionBy(F.lit(0)))
    step = tests.withColumn("_x", (m - F.row_number().over(order) + 1) * F.col(p))
    return step.withColumn("p_holm", F.least(F.lit(1.0), F.max("_x").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("_x")


def duplicate_cells(runs: DataFrame, by: list[str]) -> DataFrame:
    return runs.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1")


def require_unique(runs: DataFrame, by: list[str]) -> DataFrame:
    if not duplicate_cells(runs, by).isEmpty():
        raise IntegrityError(f"more than one row for one {', '.join(by)}")
    return runs


def require_distinct_seeds(runs: DataFrame, cell: list[str], seed: str = "seed") -> DataFrame:
    """At most one run a cell and seed; a run without a seed stands alone in its cell."""
    counts = runs.groupBy(*cell).agg(F.count("*").alias("n"), F.count_distinct(seed).alias("seeds"), F.count_if(F.col(seed).isNull()).alias("unknown"))
    if not counts.filter("(unknown > 0 AND n > 1) OR (unknown = 0 AND n > seeds)").isEmpty():
        raise IntegrityError(f"runs of one {', '.join(cell)} cannot be told apart by {seed}")
    return runs


def require_agreement(runs: DataFrame, by: list[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    off = runs.groupBy(*by).agg((F.max(value) - F.min(value)).alias("_d")).filter(F.col("_d") > tolerance)
    if not off.isEmpty():
        raise IntegrityError(f"conflicting {value}")
    return runs


def require_unit(rows: DataFrame, column: str) -> DataFrame:
    """Every value lies in [0, 1] and is a number."""
    bad = F.col(column).isNull() | F.isnan(column) | ~F.col(column).between(0, 1)
    if not rows.filter(bad).isEmpty():
        raise IntegrityError(f"{column} leaves [0, 1]")
    return rows


def config_diff(a: DataFrame, b: DataFrame, allowed: tuple[str, ...] = ()) -> DataFrame:
    """Keys (key, value) whose values differ or that one side lacks, but for allowed prefixes."""
    x, y = a.select("key", F.col("value").alias("value_a")), b.select("key", F.col("value").alias("value_b"))
    rows = x.join(y, "key", "full").filter(~F.col("value_a").eqNullSafe(F.col("value_b")))
    for prefix in allowed:
        rows = rows.filter(~F.col("key").startswith(prefix))
    return rows


def timing(events: DataFrame) -> DataFrame:
    """Seconds by phase and category, by category, and in all."""
    return events.cube("phase", "category").agg(F.sum("seconds").alias("total"), F.count("*").alias("n"), F.avg("seconds").alias("mean"), F.grouping_id().alias("level")).filter("level IN (0, 2, 3)").drop("level")


def pass_at(n: Column, c: Column, k: int) -> Column:
    """Unbiased pass@k of c passes among n samples."""
    product = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda a, i: a * (1 - F.lit(float(k)) / i))
    return F.when(c == 0, 0.0).when(n - c < k, 1.0).otherwise(1 - product)


def newest(runs: DataFrame, by: list[str], name: str, value: str) -> DataFrame:
    return runs.groupBy(*by).agg(F.max(name).alias(name), F.max_by(value, name).alias(value))


def gap_recovery(method: Column, random: Column, oracle: Column) -> Column:
    return F.try_divide(method - random, oracle - random)
