"""Pool construction: seeded corruption with a manifest, counterfactual pools, duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallow.functions import text as X
from tallow.functions.hashing import seeded, uniform
from tallow.operators.ranks import numbered


def length_bucket(rows: DataFrame, length: str, buckets: int, key: str = "pool_id") -> DataFrame:
    """Quantile bucket floor(place * B / n), places by (length, key)."""
    n = rows.agg(F.count("*").alias("_n"))
    placed = numbered(rows, [length, key], "_at").crossJoin(F.broadcast(n))
    return placed.withColumn("bucket", F.least(F.floor(F.col("_at") * buckets / F.col("_n")), F.lit(buckets - 1)).cast("int")).drop("_n", "_at")


def derange(rows: DataFrame, bucket: str, seed: int, key: str = "pool_id") -> DataFrame:
    """partner_id: another row of the bucket, each row once: the next in md5 order, the last takes the first."""
    order = Window.partitionBy(bucket).orderBy(seeded(seed, "derange", F.col(key)), key)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn("partner_id", F.coalesce(F.lead(key).over(order), F.first(key).over(whole)))


def counterfactual(pool: DataFrame, k: int, seed: int, buckets: int = 4) -> DataFrame:
    """k pools of the same outputs under another row's instruction and input."""
    sized = length_bucket(pool.withColumn("_len", X.word_count(F.col("output"))), "_len", buckets)
    other = pool.select(F.col("pool_id").alias("partner_id"), "instruction", "input")
    out = None
    for i in range(1, k + 1):
        turned = derange(sized, "bucket", seed + 1000 * i).select("pool_id", F.lit(i).alias("k"), "partner_id", "output").join(other, "partner_id")
        out = turned if out is None else out.unionByName(turned)
    return out


def assign(pool: DataFrame, fractions: dict[str, float], seed: int) -> DataFrame:
    """type: disjoint draws of exact counts; wrong answers come first and only where there is a number."""
    if any(f < 0 for f in fractions.values()) or sum(fractions.values()) > 1:
        raise ValueError("fractions must not be negative nor exceed 1 in sum")
    draw = seeded(seed, "assign", F.col("pool_id"))
    numeric = X.has_number(F.col("output"))
    n = pool.agg(F.count("*").alias("_n"), F.count_if(numeric).alias("_num"))
    rows = pool.crossJoin(F.broadcast(n)).withColumn("_numeric", numeric)
    wrong = F.least(F.bround(F.col("_n") * fractions.get("wrong_answer", 0.0)), F.col("_num"))
    first = F.row_number().over(Window.partitionBy("_numeric").orderBy(draw, "pool_id"))
    rows = rows.withColumn("_wrong", F.col("_numeric") & (first <= wrong))
    place = F.row_number().over(Window.partitionBy("_wrong").orderBy(draw, "pool_id"))
    rows = rows.withColumn("_place", place)
    kind, at = F.when(F.col("_wrong"), "wrong_answer"), F.lit(0)
    for name in ("mismatch", "noisy", "truncated"):
        at = at + F.bround(F.col("_n") * fractions.get(name, 0.0))
        kind = kind.when(F.col("_place") <= at, name)
    return rows.withColumn("type", kind.otherwise("clean")).drop("_n", "_num", "_numeric", "_wrong", "_place")


def drop_words(x: Column, seed: int, key: Column, p: float = 0.15) -> Column:
    """Drops each word with probability p (two words at least stay), texts under four words stay."""
    w = X.words(x)
    kept = F.filter(w, lambda v, i: uniform(seed, "drop", key, i) >= p)
    return F.when(F.size(w) < 4, w).when(F.size(kept) >= 2, kept).otherwise(w)


def swap_neighbours(w: Column, seed: int, key: Column, p: float = 0.10) -> Column:
    """Swaps a word with the next with probability p; a swapped pair is passed over.

    A word begins a swap if it is drawn and, of the run of drawn words that it ends, its place is odd.
    """

    def step(state: Column, i: Column) -> Column:
        begins = (state["skip"] == 0) & (i < F.size(w) - 1) & (uniform(seed, "swap", key, i) < p)
        out = F.when(state["skip"] == 1, F.concat(state["out"], F.array(F.get(w, i - 1)))).when(begins, F.concat(state["out"], F.array(F.get(w, i + 1)))).otherwise(F.concat(state["out"], F.array(F.get(w, i))))
        return F.struct(out.alias("out"), F.when(begins, 1).otherwise(0).alias("skip"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("skip"))
    return F.when(F.size(w) < 2, w).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(w), F.lit(1)) - 1), start, step)["out"])


def noisy(x: Column, seed: int, key: Column, foreign: Column | None = None, inject_p: float = 0.30) -> Column:
    """Words dropped and neighbours swapped; with probability ``inject_p`` a sentence of ``foreign`` before or after."""
    words = F.transform(F.array(drop_words(x, seed, key)), lambda w: F.when(F.size(X.words(x)) >= 4, swap_neighbours(w, seed, key)).otherwise(w)).getItem(0)
    out = F.array_join(words, " ")
    if foreign is None:
        return out
    sentences = F.filter(F.split(foreign, r"(?<=[.!?])\s+"), lambda s: X.strip(s) != "")
    drawn = F.get(sentences, F.floor(uniform(seed, "sentence", key) * F.size(sentences)).cast("int"))
    with_it = F.when(uniform(seed, "side", key) < 0.5, F.concat_ws(" ", drawn, out)).otherwise(F.concat_ws(" ", out, drawn))
    return F.when((uniform(seed, "inject", key) < inject_p) & drawn.isNotNull(), with_it).otherwise(out)


def eda(x: Column, seed: int, key: Column, alpha: float = 0.1) -> Column:
    """Each word dropped with probability alpha, one at least dropped and one kept, then max(1, round(alpha n)) swaps of any two."""
    w = X.words(x)
    drawn = F.transform(w, lambda v, i: F.struct(uniform(seed, "delete", key, i).alias("u"), i.alias("i"), v.alias("v")))
    least, most = F.array_min(drawn)["i"], F.array_max(drawn)["i"]
    kept = F.filter(drawn, lambda d: ((d["u"] >= alpha) | (d["i"] == most)) & ~((d["i"] == least) & ~F.exists(drawn, lambda e: (e["u"] < alpha) & (e["i"] != most))))
    words = F.transform(kept, lambda d: d["v"])

    def swap(state: Column, k: Column) -> Column:
        n = F.size(state)
        a = F.floor(uniform(seed, "a", key, k) * n).cast("int")
        b = F.pmod(a + 1 + F.floor(uniform(seed, "b", key, k) * (n - 1)).cast("int"), n)
        return F.when(n < 2, state).otherwise(F.transform(state, lambda v, i: F.when(i == a, F.get(state, b)).when(i == b, F.get(state, a)).otherwise(v)))

    def swapped(y: Column) -> Column:
        rounds = F.greatest(F.lit(1), F.bround(F.size(y) * alpha).cast("int"))
        return F.aggregate(F.sequence(F.lit(1), rounds), y, swap)

    return F.when(F.size(w) < 2, x).otherwise(F.array_join(F.transform(F.array(words), swapped).getItem(0), " "))


def cross_source(targets: DataFrame, donors: DataFrame, seed: int, buckets: int = 10) -> DataFrame:
    """targets (pool_id, output) with donor_id and the donor's output, by length bucket.

    A target takes the donor of its bucket at its own place in a seeded order; places beyond the
    bucket's donors go round again, and a bucket without donors takes the nearest one's.
    """
    sized = [length_bucket(rows.withColumn("_len", X.word_count(F.col("output"))), "_len", buckets) for rows in (targets, donors)]
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(seeded(seed, "donor", F.col("pool_id")), "pool_id")) - 1
    mine, theirs = (rows.withColumn("_at", place) for rows in sized)
    filled = theirs.groupBy("bucket").agg(F.count("*").alias("_n"))  # a row a bucket
    wanted = mine.select("bucket").distinct().crossJoin(F.broadcast(filled.withColumnRenamed("bucket", "_from")))
    nearest = wanted.groupBy("bucket").agg(F.min(F.struct(F.abs(F.col("bucket") - F.col("_from")).alias("far"), "_from", "_n")).alias("x"))
    mine = mine.join(F.broadcast(nearest.select("bucket", F.col("x._from").alias("_from"), F.col("x._n").alias("_n"))), "bucket")
    mine = mine.withColumn("_turn", F.pmod(F.col("_at"), F.col("_n")))
    donor = theirs.select(F.col("bucket").alias("_from"), F.col("_at").alias("_turn"), F.col("pool_id").alias("donor_id"), F.col("output").alias("donor_output"))
    return mine.join(donor, ["_from", "_turn"]).select("pool_id", "bucket", "donor_id", "donor_output")


def replaced(pool: DataFrame, replacements: DataFrame, targets: DataFrame) -> DataFrame:
    """The outputs of ``targets`` by ``replacements`` (pool_id, text); a target without one is an error."""
    wanted = targets.select("pool_id").join(replacements.select("pool_id", F.col("text").alias("_text")), "pool_id", "left")
    checked = F.coalesce("_text", F.raise_error(F.concat(F.lit("no replacement for "), F.col("pool_id").cast("string"))).cast("string"))
    wanted = wanted.select("pool_id", checked.alias("_text"))
    return pool.join(wanted, "pool_id", "left").withColumn("output", F.coalesce("_text", "output")).drop("_text")


def united(sources: dict[str, DataFrame], scales: dict[str, float] | None = None, seed: int = 42) -> DataFrame:
    """Pools one after the other, ids moved behind those before (source_id keeps the old); a scale below 1 draws a part."""
    parts = []
    for rank, (name, rows) in enumerate(sources.items()):
        share = min(1.0, (scales or {}).get(name, 1.0))
        part = rows if share >= 1 else rows.filter(uniform(seed, "source", name, F.col("pool_id")) < share)
        parts.append(part.withColumns({"source": F.lit(name), "_rank": F.lit(rank)}))
    out = reduce(DataFrame.unionByName, parts)
    tops = out.groupBy("_rank").agg((F.max("pool_id") + 1).alias("_size"))  # a row a source
    before = tops.select("_rank", (F.sum("_size").over(Window.orderBy("_rank")) - F.col("_size")).alias("_before"))
    return out.join(F.broadcast(before), "_rank").withColumn("source_id", F.col("pool_id")).withColumn("pool_id", F.col("pool_id") + F.col("_before")).drop("_rank", "_before")


def manifest(corrupted: DataFrame) -> DataFrame:
    """pool_id, type, partner_id of the rows that are not clean."""
    return corrupted.filter("type <> 'clean'").select("pool_id", "type", "partner_id")


def typed(pool: DataFrame, entries: DataFrame) -> DataFrame:
    """The pool with each row's type; rows that the manifest does not name are clean."""
    return pool.join(entries.select("pool_id", "type"), "pool_id", "left").withColumn("type", F.coalesce("type", F.lit("clean")))


def corrupt(pool: DataFrame, fractions: dict[str, float], seed: int) -> DataFrame:
    """The pool with type, partner_id and changed outputs; clean rows are unchanged."""
    typed = derange(assign(pool, fractions, seed).withColumn("_b", F.lit(0)), "_b", seed).drop("_b")
    donors = pool.select(F.col("pool_id").alias("partner_id"), F.col("output").alias("_donor"))
    rows = typed.join(donors, "partner_id", "left")
    share = 0.3 + 0.4 * uniform(seed, "cut", F.col("pool_id"))
    out = (
        F.when(F.col("type") == "wrong_answer", X.perturbed_number(F.col("output"), 0.1 + 0.4 * uniform(seed, "share", F.col("pool_id")), uniform(seed, "up", F.col("pool_id")) < 0.5))
        .when(F.col("type") == "mismatch", F.col("_donor"))
        .when(F.col("type") == "noisy", noisy(F.col("output"), seed, F.col("pool_id"), F.col("_donor")))
        .when(F.col("type") == "truncated", X.truncated(F.col("output"), share))
        .otherwise(F.col("output"))
    )
    return rows.withColumn("output", out).withColumn("partner_id", F.when(F.col("type") == "mismatch", F.col("partner_id"))).drop("_donor")


def jittered(x: Column, draw: Column) -> Column:
    """A blank before or after, the first letter's case turned, or the first blank doubled."""
    first = F.substring(x, 1, 1)
    turned = F.concat(F.when(first == F.upper(first), F.lower(first)).otherwise(F.upper(first)), F.substring(x, F.lit(2), F.length(x)))
    return F.when(draw < 0.25, F.concat(F.lit(" "), x)).when(draw < 0.5, F.concat(x, F.lit(" "))).when((draw < 0.75) & (x != ""), turned).otherwise(F.regexp_replace(x, "^([^ ]*) ", "$1  "))


def append_duplicates(pool: DataFrame, share: float, seed: int, low: int = 2, high: int = 4, jitter_p: float = 0.5) -> DataFrame:
    """``low`` to ``high`` more rows for each of max(1, floor(n share)) seed rows, new ids after the largest.

    cluster_id links them; with probability ``jitter_p`` a copy's instruction is jittered.
    """
    stats = pool.agg(F.count("*").alias("_n"), F.max("pool_id").alias("_max"))
    order = seeded(seed, "dup", F.col("pool_id"))
    wanted = max(1, int(pool.count() * share))
    picked = pool.orderBy(order, "pool_id").limit(wanted).withColumn("_place", F.row_number().over(Window.orderBy(order, "pool_id"))).crossJoin(F.broadcast(stats))
    copies = low + F.floor((high - low + 1) * uniform(seed, "copies", F.col("pool_id"))).cast("int")
    more = picked.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies)))
    changed = F.when(uniform(seed, "jitter", F.col("pool_id"), F.col("_copy")) < jitter_p, jittered(F.col("instruction"), uniform(seed, "kind", F.col("pool_id"), F.col("_copy")))).otherwise(F.col("instruction"))
    new = F.col("_max") + F.row_number().over(Window.orderBy("_place", "_copy"))  # the share's rows
    more = more.select(new.alias("pool_id"), changed.alias("instruction"), "input", "output", F.col("pool_id").alias("cluster_id"))
    seeds = picked.select(F.col("pool_id").alias("_s"))
    base = pool.join(seeds, pool["pool_id"] == seeds["_s"], "left").select("pool_id", "instruction", "input", "output", F.col("_s").alias("cluster_id"))
    return base.unionByName(more)


def oracle_pool(pool: DataFrame, manifest: DataFrame) -> DataFrame:
    """The rows that the manifest does not list, renumbered in order."""
    kept = pool.join(manifest.select("pool_id"), "pool_id", "left_anti")
    return numbered(kept, ["pool_id"], "new_id").withColumn("new_id", F.col("new_id").cast("int"))
