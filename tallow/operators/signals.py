"""Per-record signals: completeness, joined token losses, quality, ratings, and tables of how well each detects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallow.functions import text as X
from tallow.operators import scoring as S
from tallow.operators.results import IntegrityError

C_TRUNC = 0.2


def completeness(complete: Column, ends_with_eos: Column, has_response: Column, c_trunc: float = C_TRUNC) -> Column:
    """1 where the last label is the end token and the text reads as finished, else ``c_trunc``.

    A null ``complete`` leaves the text out of account; a record without a response is cut off.
    """
    return F.when(has_response & ends_with_eos & F.coalesce(complete, F.lit(True)), 1.0).otherwise(F.lit(c_trunc))


def text_completeness(rows: DataFrame, text: str, c_trunc: float = C_TRUNC) -> DataFrame:
    done = completeness(X.is_complete(F.col(text)), F.lit(True), X.strip(F.col(text)) != "", c_trunc)
    return rows.withColumn("c", done)


def with_completeness(gated: DataFrame, flags: DataFrame) -> DataFrame:
    """G = c x gate; records without a flag keep their gate. ``sigma_part`` is the gate alone."""
    rows = gated.join(flags.select("pool_id", "c"), "pool_id", "left").withColumn("c", F.coalesce("c", F.lit(1.0)))
    return rows.withColumn("sigma_part", F.col("gate")).withColumn("gate", F.col("c") * F.col("gate"))


def require_same_records(true: DataFrame, other: DataFrame, key: str = "pool_id") -> None:
    """Both tables hold each key once, and the same keys."""
    sides = true.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(other.select(key, F.lit(0), F.lit(1)))
    if not sides.groupBy(key).agg(F.sum("a").alias("a"), F.sum("b").alias("b")).filter("a <> 1 OR b <> 1").isEmpty():
        raise IntegrityError(f"the two tables do not hold the same {key} once each")


def aligned(true: DataFrame, other: DataFrame, key: str = "pool_id") -> DataFrame:
    """true and counterfactual records side by side (``cf_`` before the latter's columns)."""
    require_same_records(true, other, key)
    return true.join(other.select(key, *[F.col(c).alias(f"cf_{c}") for c in other.columns if c != key]), key)


def common_prefix(true: DataFrame, other: DataFrame) -> DataFrame:
    """(pool_id, pos, tr, cf) of the positions that both ragged tables (pool_id, pos, nll) have."""
    return true.select("pool_id", "pos", F.col("nll").alias("tr")).join(other.select("pool_id", "pos", F.col("nll").alias("cf")), ["pool_id", "pos"])


def mean_loss(tokens: DataFrame, column: str = "tr") -> DataFrame:
    return tokens.groupBy("pool_id").agg(F.avg(column).alias("loss"), F.count("*").alias("n_tokens"))


def type_table(rows: DataFrame, by: str = "type") -> DataFrame:
    """By type: n, mean gate, share at zero, mean completeness, mean gate over completeness."""
    part = F.when(F.col("c") > 0, F.col("gate") / F.greatest("c", F.lit(1e-6))).otherwise(F.col("gate"))
    return rows.groupBy(by).agg(
        F.count("*").alias("n"), F.avg("gate").alias("mean_gate"), F.avg((F.col("gate") == 0).cast("double")).alias("zero_rate"),
        F.avg("c").alias("mean_c"), F.avg(part).alias("mean_sigma"),
    )


def completeness_audit(rows: DataFrame, text: str, kind: str, truncated: str = "truncated") -> DataFrame:
    """By variant of the rule: flagged, recall on cut texts, clean ones flagged, precision, clean flagged a catch."""
    x = F.col(text)
    t = F.regexp_replace(x, rf"{X.BLANK}+$", "")
    ended = F.when((t == "") | (F.regexp_count(t, F.lit("```")) % 2 == 1), False).when(t.endswith("```"), True)
    ended = ended.otherwise(F.regexp_replace(t, f"[{X.WRAPPERS}]+$", "").rlike(rf"[{X.ENDS}0-9]$"))
    variants = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), (~c).alias("flagged")) for n, c in (("shipped", X.is_complete(x)), ("punctuation only", ended))]))
    flags = rows.select(F.col(kind).alias("kind"), variants.alias("v")).select("kind", "v.*")
    hit = F.count_if(F.col("flagged") & (F.col("kind") == truncated))
    clean = F.count_if(F.col("flagged") & (F.col("kind") == "clean"))
    return flags.groupBy("variant").agg(
        F.count_if("flagged").alias("flagged"), F.try_divide(hit, F.count_if(F.col("kind") == truncated)).alias("recall"),
        F.try_divide(clean, F.count_if(F.col("kind") == "clean")).alias("clean_rate"), F.try_divide(hit, F.count_if("flagged")).alias("precision"),
        (clean / F.greatest(hit, F.lit(1))).alias("clean_a_catch"),
    )


def type_precision(rows: DataFrame, score: str, kind: str, key: str, by: list[str] | None = None) -> DataFrame:
    """Average precision of each dirty type against the clean rows alone, best score first.

    A row of a type comes at its place among the rows of that type and the clean ones: two counts
    over (score, key), so the clean rows are not copied a type.
    """
    by = by or []
    order = Window.partitionBy(*by).orderBy(F.desc(score), key) if by else Window.orderBy(F.desc(score), key)
    upto = F.count_if(F.col(kind) == "clean").over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.select(*by, kind, score, key, upto.alias("clean_before")).filter(F.col(kind) != "clean")
    own = F.row_number().over(Window.partitionBy(*by, kind).orderBy(F.desc(score), key))
    return placed.withColumn("own", own).groupBy(*by, kind).agg(F.avg(F.col("own") / (F.col("own") + F.col("clean_before"))).alias("ap"), F.count("*").alias("positives"))


def unpivoted(rows: DataFrame, keep: list[str], signals: list[str]) -> DataFrame:
    """(keep..., signal, value): a row a record and signal."""
    return rows.unpivot(keep, signals, "signal", "value")


def signal_table(rows: DataFrame, signals: list[str], label: str, kind: str, k: int, key: str = "pool_id") -> DataFrame:
    """By signal: average precision for dirt (low values first) and dirty share of the best k."""
    flat = unpivoted(rows, [key, label, kind], signals)
    low = Window.partitionBy("signal").orderBy("value", key)
    high = F.row_number().over(Window.partitionBy("signal").orderBy(F.desc("value"), key))
    ranked = flat.select("signal", label, (F.sum(label).over(low.rowsBetween(Window.unboundedPreceding, 0)) / F.row_number().over(low)).alias("p"), (high <= k).alias("best"))
    return ranked.groupBy("signal").agg(F.avg(F.when(F.col(label) == 1, F.col("p"))).alias("ap"), F.avg(F.when(F.col("best"), F.col(label))).alias("dirty_at_k"))


def reliability(losses: DataFrame, scale: float | None = None, rezero: bool = True) -> DataFrame:
    """pool_id, quality: mean over counterfactuals (pool_id, k, orig, cf) of the sigmoid gate of cf - orig.

    Several counterfactuals are discounted by twice the spread of their gates. Without a scale that
    of the pool is taken: the lower median of the positive mean gains over ln 4, else 1.
    """
    rows = losses.withColumn("delta", F.col("cf") - F.col("orig"))
    if scale is None:
        means = rows.groupBy("pool_id").agg(F.avg("delta").alias("m"))
        own = means.agg((F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY m) FILTER (WHERE m > 0)") / F.log(F.lit(4.0))).alias("s")).select(F.coalesce("s", F.lit(1.0)).alias("s"))
    else:
        own = losses.sparkSession.createDataFrame([(scale,)], "s double")
    q = 1 / (1 + F.exp(-F.col("delta") / F.col("s")))
    gates = S.with_row(rows, own).withColumn("g", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * (q - 0.5))) if rezero else q)
    found = gates.groupBy("pool_id").agg(F.avg("g").alias("m"), F.count("*").alias("n"), F.stddev_pop("g").alias("d"))
    return found.select("pool_id", (F.col("m") * F.when(F.col("n") > 1, F.greatest(F.lit(0.0), 1 - 2 * F.col("d"))).otherwise(1.0)).alias("quality"))


def rating_score(probabilities: Column) -> Column:
    """Rating times confidence of five rating probabilities, after a second normalisation."""

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def scored(p: Column) -> Column:
        base = F.array_max(p)
        return F.array_position(p, base) * (F.size(p) * base - total(p)) / (F.size(p) - 1)

    doubles = F.transform(probabilities, lambda x: x.cast("double"))
    shares = F.transform(doubles, lambda x: F.when(total(doubles) > 0, F.exp(x / total(doubles))).otherwise(1.0))
    return F.transform(F.array(shares), lambda e: scored(F.transform(e, lambda x: x / total(e)))).getItem(0)


def sentence_score(rows: DataFrame, key: str, score: str, alpha: float = 0.2) -> DataFrame:
    """Mean over templates, discounted by their spread."""
    return rows.groupBy(key).agg((F.avg(score) / (1 + alpha * F.stddev_pop(score))).alias("score"))


def agent_reward(rows: DataFrame, loss: str = "loss", entropy: str = "entropy") -> DataFrame:
    """reward = w D + (1 - w) H / max H with D the loss scaled to [0, 1] and w the share of its variance."""
    scaled = S.with_row(S.min_max(rows, loss, "difficulty"), rows.agg(F.greatest(F.max(entropy), F.lit(1e-8)).alias("_top")))
    scaled = scaled.withColumn("confidence", F.col(entropy) / F.col("_top"))
    vd, vc = F.coalesce(F.var_samp("difficulty"), F.lit(0.0)), F.coalesce(F.var_samp("confidence"), F.lit(0.0))
    w = scaled.agg((vd / (vd + vc + 1e-8)).alias("w"))
    return S.with_row(scaled, w).withColumn("reward", F.col("w") * F.col("difficulty") + (1 - F.col("w")) * F.col("confidence")).drop("_top")


def advantages(rewards: Column, values: Column, gamma: float = 0.99, lam: float = 0.95) -> Column:
    """Generalised advantages of one episode's rewards and values, by the reverse recurrence."""
    step = F.zip_with(F.arrays_zip(rewards.alias("r"), values.alias("v")), F.concat(F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), F.array(F.lit(0.0))), lambda x, after: x["r"] + gamma * after - x["v"])
    back = F.aggregate(F.reverse(step), F.array().cast("array<double>"), lambda done, d: F.concat(done, F.array(d + gamma * lam * F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0.0)))))
    return F.reverse(back)


def extremes(rows: DataFrame, column: str, k: int, draw: Column, key: str = "pool_id") -> DataFrame:
    """The k lowest, k drawn and k highest rows, told apart by ``which``."""
    parts = [("lowest", [F.asc(column), F.asc(key)]), ("random", [draw, F.asc(key)]), ("highest", [F.desc(column), F.asc(key)])]
    found = [rows.orderBy(*order).limit(k).select(F.lit(which).alias("which"), key, column) for which, order in parts]
    return found[0].unionAll(found[1]).unionAll(found[2])


def counterfactual_sanity(pairs: DataFrame) -> DataFrame:
    """Rates of unchanged outputs and instructions of ``aligned`` pools, and what chance would leave unchanged."""
    n = F.count("*")
    held = pairs.groupBy("instruction").agg(F.count("*").alias("n"))
    chance = held.agg((F.sum(F.col("n") * (F.col("n") - 1)) / F.sum("n") / F.greatest(F.sum("n") - 1, F.lit(1))).alias("expected"))
    rates = pairs.agg(F.avg((F.col("output") == F.col("cf_output")).cast("double")).alias("same_output"), F.avg((F.col("instruction") == F.col("cf_instruction")).cast("double")).alias("unchanged"), n.alias("n"))
    return S.with_row(rates, chance).withColumn("within_budget", F.col("unchanged") <= F.greatest(F.lit(0.10), 3 * F.col("expected")))
