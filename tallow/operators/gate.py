"""The reliability gate: spans of token losses, gains, null curve, scale, gate.

Token losses are a table (pool_id, pos, tr, cf): the loss of each response token under the true
and under a counterfactual prompt. Everything is an aggregation by record and then expressions;
the curve and the scale are at most a few rows, joined back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallow.operators.ranks import percentiles
from tallow.plans.checkpoints import cut, kept

EPS = 1e-8


@dataclass(frozen=True)
class GateConfig:
    span_tokens: int = 16
    min_span_tokens: int = 1
    tau: float = 0.5
    tau_per_token: bool = True
    alpha: float = 0.05
    target_pct: float = 0.10
    target_gate: float = 0.6
    tail_quantile: float | None = None
    undefined: str = "neutral"

    def __post_init__(self):
        if not 0 < self.alpha < self.target_pct < 1:
            raise ValueError("alpha must lie below target_pct")
        if self.undefined not in ("neutral", "pass", "zero"):
            raise ValueError(f"unknown policy: {self.undefined}")


def gain(tr: Column, cf: Column) -> Column:
    return 1 - tr / F.greatest(cf, F.lit(EPS))


def spans(tokens: DataFrame, width: int) -> DataFrame:
    m = F.floor(F.col("pos") / width)
    return tokens.groupBy("pool_id", m.alias("m")).agg(F.sum("tr").alias("span_true"), F.sum("cf").alias("span_cf"), F.count("*").alias("span_len"))


def valid(min_tokens: int, tau: float, per_token: bool = True) -> Column:
    """Spans long enough whose counterfactual loss, a token or in all, reaches ``tau``."""
    loss = F.col("span_cf") / F.col("span_len") if per_token else F.col("span_cf")
    return (F.col("span_len") >= min_tokens) & (loss >= tau)


def components(tokens: DataFrame, cfg: GateConfig) -> DataFrame:
    """By record: delta_bar, delta_min (tail gain over valid spans, else delta_bar), delta_raw, spans."""
    g = gain(F.col("span_true"), F.col("span_cf"))
    ok = valid(cfg.min_span_tokens, cfg.tau, cfg.tau_per_token)
    tail = F.min(F.when(ok, g)) if cfg.tail_quantile is None else F.percentile(F.when(ok, g), cfg.tail_quantile)
    rows = spans(tokens, cfg.span_tokens).groupBy("pool_id").agg(
        gain(F.sum("span_true"), F.sum("span_cf")).alias("delta_bar"),
        tail.alias("tail"),
        F.count("*").alias("n_spans"),
        F.count_if(ok).alias("n_valid_spans"),
        F.sum("span_len").alias("n_common"),
    )
    rows = rows.withColumn("delta_min", F.coalesce("tail", "delta_bar")).withColumn("empty_c", F.col("tail").isNull()).drop("tail")
    return rows.withColumn("delta_raw", F.least("delta_bar", "delta_min"))


def sweep(tokens: DataFrame, widths: tuple[int, ...], taus: tuple[float, ...]) -> DataFrame:
    """By record and width: delta_raw_i and n_valid_spans_i of ``components`` at the i-th tau; one pass over the tokens for all."""
    wide = tokens.withColumn("w", F.explode(F.array(*map(F.lit, widths))))
    parts = wide.groupBy("pool_id", "w", F.floor(F.col("pos") / F.col("w")).alias("m")).agg(F.sum("tr").alias("span_true"), F.sum("cf").alias("span_cf"), F.count("*").alias("span_len"))
    g = gain(F.col("span_true"), F.col("span_cf"))
    tails = [F.min(F.when(valid(1, tau), g)).alias(f"tail_{i}") for i, tau in enumerate(taus)]
    counts = [F.count_if(valid(1, tau)).cast("int").alias(f"n_valid_spans_{i}") for i, tau in enumerate(taus)]
    rows = parts.groupBy("pool_id", "w").agg(gain(F.sum("span_true"), F.sum("span_cf")).alias("delta_bar"), *tails, *counts)
    raws = [F.least("delta_bar", F.coalesce(f"tail_{i}", "delta_bar")).alias(f"delta_raw_{i}") for i in range(len(taus))]
    return rows.select("pool_id", "w", *raws, *[f"n_valid_spans_{i}" for i in range(len(taus))])


def prefix_gain(tokens: DataFrame, n: int) -> DataFrame:
    early = F.col("pos") < n
    return tokens.groupBy("pool_id").agg(gain(F.sum(F.when(early, F.col("tr"))), F.sum(F.when(early, F.col("cf")))).alias("prefix_gain"))


def null_bins(sizes: list[tuple[int, int]], min_count: int, max_bins: int) -> list[tuple[int, int]]:
    """(low, high] edges over the distinct span counts: a bin closes once it holds enough records.

    ``sizes``: (span count, records), one pair a distinct count. The last bin takes the rest.
    """
    if not sizes:
        return []
    per_bin = max(min_count, -(-sum(n for _, n in sizes) // max_bins))
    edges, held = [], 0
    for m, n in sorted(sizes):
        held += n
        if held >= per_bin:
            edges.append(m)
            held = 0
    top = max(m for m, _ in sizes)
    if not edges:
        edges = [top]
    edges[-1] = max(edges[-1], top)
    return list(zip([0, *edges[:-1]], edges))


def pava_nonincreasing(values: list[float], weights: list[float]) -> list[float]:
    """Weighted least-squares fit that never rises: neighbours that rise are pooled."""
    pools: list[list[float]] = []
    for v, w in zip(values, weights):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] < pools[-1][0]:
            v2, w2, n2 = pools.pop()
            v1, w1, n1 = pools[-1]
            pools[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return [v for v, _, n in pools for _ in range(int(n))]


def null_curve(rows: DataFrame, alpha: float, min_count: int = 200, max_bins: int = 24, monotone: bool = True) -> DataFrame:
    """(low, high, mu, n): the alpha quantile of delta_raw by span count."""
    spark = rows.sparkSession
    with kept(rows.select("n_spans", "delta_raw")) as few:
        sizes = [(r["n_spans"], r["n"]) for r in few.groupBy("n_spans").agg(F.count("*").alias("n")).collect()]  # a row a span count
        edges = null_bins(sizes, min_count, max_bins)
        bins = spark.createDataFrame(edges, "low long, high long")
        hit = (few["n_spans"] > bins["low"]) & (few["n_spans"] <= bins["high"])
        mus = {r["low"]: r["value"] for r in percentiles(few.join(F.broadcast(bins), hit), "delta_raw", [alpha], ("low", "high")).collect()}  # a row a bin
    found = [(lo, hi, mus.get(lo), n) for lo, hi in edges if (n := sum(n for m, n in sizes if lo < m <= hi))]
    if monotone:
        fitted = pava_nonincreasing([r[2] for r in found], [float(r[3]) for r in found])
        found = [(lo, hi, mu, n) for (lo, hi, _, n), mu in zip(found, fitted)]
    return spark.createDataFrame(found, "low long, high long, mu double, n long")


def centre(rows: DataFrame, curve: DataFrame) -> DataFrame:
    """delta_hat = delta_raw - mu of the record's bin; beyond the last bin the last holds."""
    last = curve.agg(F.max("high").alias("_top"))
    keyed = rows.crossJoin(F.broadcast(last)).withColumn("_m", F.least("n_spans", "_top"))
    hit = (F.col("_m") > F.col("low")) & (F.col("_m") <= F.col("high"))
    return keyed.join(F.broadcast(curve.select("low", "high", "mu")), hit).withColumn("delta_hat", F.col("delta_raw") - F.col("mu")).drop("_top", "_m", "low", "high")


def scale(rows: DataFrame, pct: float, target: float) -> DataFrame:
    """One row s: the pct quantile of delta_hat over logit((1 + target) / 2) = ln((1+q)/(1-q)); falls back to the lower median of the positive, then 1."""
    import math

    logit = math.log((1 + target) / (1 - target))
    spark = rows.sparkSession
    with kept(rows.select("delta_hat")) as few:
        q = next((r["value"] for r in percentiles(few, "delta_hat", [pct]).collect()), None)
        falls_back = q is None or not q > 0
        med = next((r["lower"] for r in percentiles(few.filter("delta_hat > 0"), "delta_hat", [0.5]).collect()), None) if falls_back else None
    found = spark.createDataFrame([(q, med)], "q double, med double")
    return found.select(F.when(F.col("q") > 0, F.col("q") / logit).when(F.col("med") > 0, F.col("med") / logit).otherwise(F.lit(1.0)).alias("s"))


def sigmoid_gate(delta_hat: Column, s: Column) -> Column:
    """2 sigma(x/s) - 1 clipped to [0, 1]; exactly 0 from 0 down."""
    return F.when(delta_hat <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 / (1 + F.exp(-delta_hat / s)) - 1)))


def apply_undefined(gate: Column, undefined: Column, policy: str) -> Column:
    return F.when(undefined, F.lit({"neutral": 0.6, "pass": 1.0, "zero": 0.0}[policy])).otherwise(gate)


def gate(tokens: DataFrame, cfg: GateConfig, min_count: int = 200, max_bins: int = 24, monotone: bool = True) -> DataFrame:
    rows = cut(components(tokens, cfg))  # a row a record, read by the curve, the scale and the gate
    centred = centre(rows, null_curve(rows, cfg.alpha, min_count, max_bins, monotone))
    scored = centred.crossJoin(F.broadcast(scale(centred, cfg.target_pct, cfg.target_gate)))
    return scored.withColumn("gate", sigmoid_gate(F.col("delta_hat"), F.col("s")))


def zero_rates(rows: DataFrame) -> DataFrame:
    return rows.groupBy("n_spans").agg(F.count("*").alias("n"), F.avg((F.col("delta_hat") <= 0).cast("double")).alias("zero_rate"))


def combine(rows: DataFrame, penalty: float = 2.0) -> DataFrame:
    """Several counterfactuals: mean gate, discounted by the spread (1 - penalty * population sd)+."""
    return rows.groupBy("pool_id").agg(F.avg("gate").alias("gate_mean"), F.stddev_pop("gate").alias("dispersion")).withColumn(
        "gate", F.col("gate_mean") * F.greatest(F.lit(0.0), 1 - penalty * F.col("dispersion"))
    )


def span_profile(tokens: DataFrame, width: int, last: int) -> DataFrame:
    """By span index (the tail pooled): mean losses a token, gap, mean gain, 5 % quantile."""
    s = spans(tokens, width).withColumn("m", F.least("m", F.lit(last)))
    t, c = F.col("span_true") / F.col("span_len"), F.col("span_cf") / F.col("span_len")
    g = gain(F.col("span_true"), F.col("span_cf"))
    return s.groupBy("m").agg(F.count("*").alias("n"), F.avg(t).alias("true_loss"), F.avg(c).alias("cf_loss"), F.avg(c - t).alias("gap"), F.avg(g).alias("gain"), F.percentile(g, 0.05).alias("p05"))


def argmin_profile(tokens: DataFrame, width: int) -> DataFrame:
    """Where the least span gain falls, over how many records have that span."""
    s = spans(tokens, width).withColumn("g", gain(F.col("span_true"), F.col("span_cf")))
    low = s.groupBy("pool_id").agg(F.min(F.struct("g", "m")).alias("x")).groupBy(F.col("x.m").alias("m")).agg(F.count("*").alias("hits"))
    return s.groupBy("m").agg(F.count("*").alias("available")).join(low, "m", "left").select("m", "available", F.coalesce("hits", F.lit(0)).alias("hits"), (F.coalesce("hits", F.lit(0)) / F.col("available")).alias("rate"))


def position_centred(tokens: DataFrame, width: int, alpha: float, least: int = 20) -> DataFrame:
    """Least span gain after subtracting each position's own null quantile (0 where too few)."""
    s = spans(tokens, width).withColumn("g", gain(F.col("span_true"), F.col("span_cf")))
    mu = s.groupBy("m").agg(F.when(F.count("*") > least, F.percentile("g", alpha)).otherwise(0.0).alias("mu"))
    return s.join(F.broadcast(mu), "m").groupBy("pool_id").agg(F.min(F.col("g") - F.col("mu")).alias("centred_min"))


def positions(rows: DataFrame, key: str, order: list[str]) -> Column:
    return F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
