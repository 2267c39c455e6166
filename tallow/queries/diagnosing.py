"""Queries of the diagnostics and the results tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallow.operators import diagnostics as D
from tallow.operators import results as T
from tallow.operators.scoring import rank01
from tallow.queries.gating import mid, rounded
from tallow.queries.inputs import LABELLED, RUNS, SIGNALS, view

L = f"lab AS ({LABELLED})"


def _lab(spark, d):
    return view(spark, d, LABELLED)


def avg_precision(spark, d):
    return rounded(D.average_precision(_lab(spark, d), "score", "dirty", "pool_id"))


def ap_per_lang(spark, d):
    return rounded(D.average_precision(_lab(spark, d), "score", "dirty", "pool_id", ["lang"]))


def dirty_at_k(spark, d):
    return rounded(D.dirty_at(_lab(spark, d), "score", "dirty", "pool_id", 100))


def reject_by_type(spark, d):
    return rounded(D.reject_rate(_lab(spark, d), "score", "pool_id", 100, "type"))


def cluster_fraction(spark, d):
    rows = _lab(spark, d).withColumn("c", F.when(F.col("n_chars") % 3 == 0, -1).otherwise(F.col("n_chars") % 50))
    return rounded(D.cluster_fraction(rows, "c"))


def length_bias(spark, d):
    return rounded(D.length_bias(_lab(spark, d), "n_chars", "score", "dirty", "pool_id"))


def spearman_len(spark, d):
    return rounded(D.spearman(_lab(spark, d), "n_chars", "score"))


def purity_by_source(spark, d):
    return rounded(D.purity(_lab(spark, d), ["source"], "type"))


def purity_pivot(spark, d):
    return _lab(spark, d).groupBy("lang").pivot("type", ["clean", "noisy", "toxic"]).agg(F.count(F.lit(1))).na.fill(0)


def floor_block(spark, d):
    return rounded(D.floor_block(_lab(spark, d).withColumn("g", F.when(F.col("n_chars") < 800, 0.0).otherwise(0.5)), "g", "dirty"))


def clean_shift_iqr(spark, d):
    return rounded(D.shift(_lab(spark, d), "n_chars", "type"))


def truncation_percentiles(spark, d):
    return D.nearest_rank(_lab(spark, d), "n_chars", "pool_id", [0.5, 0.9, 0.99])


ARMS = """SELECT doc_id AS pool_id, 'a' AS arm, doc_id % 3 AS epoch FROM documents WHERE substr(md5('1:' || doc_id), 1, 1) < '8'
UNION ALL SELECT doc_id, 'b', doc_id % 3 FROM documents WHERE substr(md5('2:' || doc_id), 1, 1) < '6'
UNION ALL SELECT doc_id, 'c', doc_id % 3 FROM documents WHERE substr(md5('3:' || doc_id), 1, 1) < '4'"""


def arm_overlap_jaccard(spark, d):
    return rounded(D.overlap(view(spark, d, ARMS), "arm", "epoch", "pool_id"))


def _runs(spark, d):
    return view(spark, d, RUNS)


BY = ["set_key", "model", "method", "seed"]


def run_macros(spark, d):
    return rounded(T.macros(_runs(spark, d), BY, 7))


def run_macros_partial(spark, d):
    return rounded(T.macros(_runs(spark, d), BY, 7, allow_partial=True))


def _values(spark, d):
    return T.macros(_runs(spark, d), BY, 7, allow_partial=True)


def cell_aggregate(spark, d):
    c = T.cells(_values(spark, d), ["set_key", "model", "method"]).withColumn("seeds", F.array_join("seeds", ","))
    return rounded(c.drop("half_width"))


def t_interval_cells(spark, d):
    return rounded(T.cells(_values(spark, d), ["set_key", "method"]).select("set_key", "method", "n_seeds", "half_width"))


def paired_diff(spark, d):
    return rounded(T.paired(_values(spark, d), "method", "BUILDING", "MACHINERY", ["set_key", "model", "seed"]))


def signflip_perm(spark, d):
    diffs = T.paired(_values(spark, d), "method", "BUILDING", "MACHINERY", ["set_key", "model", "seed"])
    return rounded(T.sign_flip(diffs, ["set_key", "model"]))


def holm_adjust(spark, d):
    diffs = T.paired(_values(spark, d), "method", "BUILDING", "MACHINERY", ["set_key", "model", "seed"])
    return rounded(T.holm(T.sign_flip(diffs, ["set_key", "model"]), key=["set_key", "model"]).select("set_key", "model", "p", "p_holm"))


def duplicate_cell_check(spark, d):
    return T.duplicate_cells(_runs(spark, d), BY + ["bench"])


def macro_micro_accuracy(spark, d):
    rows = view(spark, d, SIGNALS).withColumn("ok", (F.col("loss") > 2.5).cast("int"))
    return rounded(T.micro_macro(rows, "bench", "ok"))


def pass_at_k(spark, d):
    rows = view(spark, d, "SELECT o_custkey AS task, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS c FROM orders GROUP BY o_custkey")
    return rounded(rows.filter("n >= 2").select("task", "n", "c", T.pass_at(F.col("n"), F.col("c"), 2).alias("pass_at_2")))


TIMING = "SELECT event_type AS phase, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS category, value AS seconds FROM events"


def timing_rollup(spark, d):
    return rounded(T.timing(view(spark, d, TIMING)))


def hang_detect(spark, d):
    """Users by how long before the last event they were last seen."""
    e = view(spark, d, "SELECT user_id, ts FROM events")
    last = e.groupBy("user_id").agg(F.max("ts").alias("last"))
    idle = F.unix_timestamp("_now") - F.unix_timestamp("last")
    rows = last.crossJoin(F.broadcast(e.agg(F.max("ts").alias("_now")))).withColumn("idle", idle)
    return rows.select("user_id", "idle", F.when(F.col("idle") >= 1_800_000, "hang").when(F.col("idle") >= 300_000, "slow").otherwise("ok").alias("state"))


CONFIG_A = "SELECT 'k' || n_nationkey AS key, cast(n_regionkey AS VARCHAR(9)) AS value FROM nation WHERE n_nationkey % 5 <> 0"
CONFIG_B = "SELECT 'k' || n_nationkey AS key, cast(CASE WHEN n_nationkey % 4 = 0 THEN 9 ELSE n_regionkey END AS VARCHAR(9)) AS value FROM nation WHERE n_nationkey % 7 <> 0"


def config_diff_full_outer(spark, d):
    return T.config_diff(view(spark, d, CONFIG_A), view(spark, d, CONFIG_B), ("k1",))


NEWEST = "SELECT c_mktsegment AS method, c_custkey % 5 AS seed, c_name AS run, c_acctbal AS accuracy FROM customer"


def latest_run_max_by(spark, d):
    return T.newest(view(spark, d, NEWEST), ["method", "seed"], "run", "accuracy")


def oracle_gap_recovery(spark, d):
    v = T.macros(_runs(spark, d), BY, 7, allow_partial=True).groupBy("model").pivot("method", ["BUILDING", "MACHINERY", "FURNITURE"]).agg(F.avg("macro"))
    return rounded(v.select("model", T.gap_recovery(F.col("BUILDING"), F.col("MACHINERY"), F.col("FURNITURE")).alias("recovery")))


V = f"runs AS ({RUNS}), each_ AS (SELECT set_key, model, method, seed, bench, avg(accuracy) AS a FROM runs GROUP BY ALL), val AS (SELECT set_key, model, method, seed, count(*) AS n_benches, avg(a) AS macro FROM each_ GROUP BY ALL)"
DIFF = f"{V}, diff AS (SELECT x.set_key, x.model, x.seed, x.macro - y.macro AS diff FROM val x JOIN val y ON x.set_key = y.set_key AND x.model = y.model AND x.seed = y.seed WHERE x.method = 'BUILDING' AND y.method = 'MACHINERY')"
FLIP = f"""{DIFF}, num AS (SELECT *, row_number() OVER (PARTITION BY set_key, model ORDER BY diff) - 1 AS i, count(*) OVER (PARTITION BY set_key, model) AS n FROM diff),
masks AS (SELECT set_key, model, n, unnest(range(cast(power(2, n) AS BIGINT))) AS mask FROM (SELECT DISTINCT set_key, model, n FROM num)),
flips AS (SELECT set_key, model, num.n, mask, sum(CASE WHEN (mask >> i) & 1 = 1 THEN -diff ELSE diff END) AS s, sum(diff) AS o FROM num JOIN masks USING (set_key, model) GROUP BY ALL),
perm AS (SELECT set_key, model, n, any_value(o) / n AS mean_diff, avg(CASE WHEN abs(s) >= abs(o) - 1e-9 THEN 1.0 ELSE 0.0 END) AS p FROM flips GROUP BY set_key, model, n)"""
AP = "SELECT {g}*, sum(dirty) OVER (PARTITION BY {p} ORDER BY score DESC, pool_id ROWS UNBOUNDED PRECEDING) / row_number() OVER (PARTITION BY {p} ORDER BY score DESC, pool_id) AS p FROM lab"

T_TABLE = ", ".join(f"({n}, {T.t_quantile(0.975, n - 1)!r}::DOUBLE)" for n in range(2, 201))

QUERIES = {
    f.__name__: f
    for f in (
        avg_precision, ap_per_lang, dirty_at_k, reject_by_type, cluster_fraction, length_bias, spearman_len, purity_by_source, purity_pivot, floor_block, clean_shift_iqr, truncation_percentiles,
        arm_overlap_jaccard, run_macros, run_macros_partial, cell_aggregate, t_interval_cells, paired_diff, signflip_perm, holm_adjust, duplicate_cell_check, macro_micro_accuracy, pass_at_k,
        timing_rollup, hang_detect, config_diff_full_outer, latest_run_max_by, oracle_gap_recovery,
    )
}

ORACLE_SQL = {
    "avg_precision": f"WITH {L}, r AS ({AP.format(g='', p='1')}) SELECT round(avg(p) FILTER (WHERE dirty = 1), 6) AS ap, cast(sum(dirty) AS BIGINT) AS positives FROM r",
    "ap_per_lang": f"WITH {L}, r AS ({AP.format(g='', p='lang')}) SELECT lang, round(avg(p) FILTER (WHERE dirty = 1), 6) AS ap, cast(sum(dirty) AS BIGINT) AS positives FROM r GROUP BY lang",
    "dirty_at_k": f"WITH {L}, t AS (SELECT * FROM lab ORDER BY score DESC, pool_id LIMIT 100) SELECT round(avg(dirty), 6) AS dirty_share, count(*) AS k FROM t",
    "reject_by_type": f"WITH {L}, t AS (SELECT *, row_number() OVER (ORDER BY score DESC, pool_id) <= 100 AS t FROM lab) SELECT type, count(*) AS n, round(1 - avg(CASE WHEN t THEN 1.0 ELSE 0.0 END), 6) AS reject_rate FROM t GROUP BY type",
    "cluster_fraction": f"WITH {L}, c AS (SELECT CASE WHEN n_chars % 3 = 0 THEN -1 ELSE n_chars % 50 END AS c FROM lab) SELECT round((count(*) FILTER (WHERE c < 0) + count(DISTINCT c) FILTER (WHERE c >= 0)) / count(*), 6) AS fraction, count(*) AS n FROM c",
    "length_bias": f"WITH {L}, b AS (SELECT *, ntile(5) OVER (ORDER BY n_chars, pool_id) AS bin FROM lab) SELECT bin, count(*) AS n, min(n_chars) AS min_len, max(n_chars) AS max_len, round(avg(n_chars), 6) AS mean_len, round(avg(score), 6) AS mean_score, round(avg(CASE WHEN score <= 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_rate, round(avg(dirty), 6) AS dirty_rate FROM b GROUP BY bin",
    "spearman_len": f"WITH {L}, r AS (SELECT {mid('n_chars')} AS a, {mid('score')} AS b FROM lab) SELECT round(coalesce(corr(a, b), 0), 6) AS spearman FROM r",
    "purity_by_source": f"WITH {L} SELECT source, count(*) AS n, round(avg(CASE WHEN type <> 'clean' THEN 1.0 ELSE 0.0 END), 6) AS dirty_share FROM lab GROUP BY source",
    "purity_pivot": f"WITH {L} SELECT lang, count(*) FILTER (WHERE type = 'clean') AS clean, count(*) FILTER (WHERE type = 'noisy') AS noisy, count(*) FILTER (WHERE type = 'toxic') AS toxic FROM lab GROUP BY lang",
    "floor_block": f"WITH {L}, g AS (SELECT dirty, n_chars < 800 AS z FROM lab) SELECT count(*) FILTER (WHERE z) AS n_floor, round(avg(dirty) FILTER (WHERE z), 6) AS purity, round(avg(dirty) FILTER (WHERE z) / avg(dirty), 6) AS enrichment, round(sum(dirty) FILTER (WHERE z) / sum(dirty), 6) AS recall FROM g",
    "clean_shift_iqr": f"WITH {L}, o AS (SELECT quantile_cont(n_chars, 0.5) AS m, quantile_cont(n_chars, 0.75) - quantile_cont(n_chars, 0.25) AS iqr FROM lab), q AS (SELECT type, quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.5) AS median, quantile_cont(n_chars, 0.75) AS q3 FROM lab GROUP BY type) SELECT type, q1, median, q3, round((median - m) / iqr, 6) AS shift, abs((median - m) / iqr) > 0.25 AS flagged FROM q, o",
    "truncation_percentiles": f"WITH {L}, r AS (SELECT n_chars AS value, row_number() OVER (ORDER BY n_chars, pool_id) - 1 AS place, count(*) OVER () AS n FROM lab) SELECT share, value FROM r, (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (0.99::DOUBLE)) s(share) WHERE place = least(floor(share * n), n - 1)",
    "arm_overlap_jaccard": f"WITH sel AS ({ARMS}), sz AS (SELECT epoch, arm, count(*) AS n FROM sel GROUP BY ALL), bo AS (SELECT a.epoch, a.arm AS arm_a, b.arm AS arm_b, count(*) AS both_ FROM sel a JOIN sel b ON a.epoch = b.epoch AND a.pool_id = b.pool_id AND a.arm < b.arm GROUP BY ALL), p AS (SELECT x.epoch, x.arm AS arm_a, y.arm AS arm_b, x.n AS na, y.n AS nb, coalesce(both_, 0) AS b FROM sz x JOIN sz y ON x.epoch = y.epoch AND x.arm < y.arm LEFT JOIN bo ON bo.epoch = x.epoch AND bo.arm_a = x.arm AND bo.arm_b = y.arm) SELECT epoch, arm_a, arm_b, b AS \"both\", na + nb - b AS either, round(b / (na + nb - b), 6) AS jaccard, round(b / least(na, nb), 6) AS of_smaller FROM p",
    "run_macros": f"WITH {V} SELECT set_key, model, method, seed, n_benches, CASE WHEN n_benches = 7 THEN round(macro, 6) END AS macro FROM val",
    "run_macros_partial": f"WITH {V} SELECT set_key, model, method, seed, n_benches, round(macro, 6) AS macro FROM val",
    "cell_aggregate": f"WITH {V} SELECT set_key, model, method, round(avg(macro), 6) AS mean, round(stddev_samp(macro), 6) AS sd, count(macro) AS n_seeds, string_agg(DISTINCT cast(seed AS VARCHAR), ',' ORDER BY cast(seed AS VARCHAR)) AS seeds FROM val GROUP BY set_key, model, method",
    "paired_diff": f"WITH {DIFF} SELECT set_key, model, seed, round(diff, 6) AS diff FROM diff",
    "signflip_perm": f"WITH {FLIP} SELECT set_key, model, n, round(mean_diff, 6) AS mean_diff, round(p, 6) AS p FROM perm",
    "holm_adjust": f"WITH {FLIP}, h AS (SELECT set_key, model, p, (count(*) OVER () - row_number() OVER (ORDER BY p, set_key, model) + 1) * p AS x FROM perm) SELECT set_key, model, round(p, 6) AS p, round(least(1.0, max(x) OVER (ORDER BY p, set_key, model ROWS UNBOUNDED PRECEDING)), 6) AS p_holm FROM h",
    "duplicate_cell_check": f"WITH runs AS ({RUNS}) SELECT set_key, model, method, seed, bench, count(*) AS n FROM runs GROUP BY ALL HAVING count(*) > 1",
    "macro_micro_accuracy": f"WITH sig AS ({SIGNALS}), g AS (SELECT bench, avg(CASE WHEN loss > 2.5 THEN 1.0 ELSE 0.0 END) AS a, sum(CASE WHEN loss > 2.5 THEN 1 ELSE 0 END) AS s, count(*) AS n FROM sig GROUP BY bench) SELECT round(avg(a), 6) AS macro, round(sum(s) / sum(n), 6) AS micro FROM g",
    "pass_at_k": "WITH t AS (SELECT o_custkey AS task, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS c FROM orders GROUP BY o_custkey) SELECT task, n, c, round(CASE WHEN c = 0 THEN 0 WHEN n - c < 2 THEN 1 ELSE 1 - (n - c) * (n - c - 1) / (n * (n - 1)) END, 6) AS pass_at_2 FROM t WHERE n >= 2",
    "timing_rollup": f"WITH t AS ({TIMING}) SELECT phase, category, round(sum(seconds), 6) AS total, count(*) AS n, round(avg(seconds), 6) AS mean FROM t GROUP BY GROUPING SETS ((phase, category), (category), ())",
    "hang_detect": "WITH l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY user_id), i AS (SELECT user_id, cast(floor(epoch((SELECT max(ts) FROM events))) - floor(epoch(last)) AS BIGINT) AS idle FROM l) SELECT user_id, idle, CASE WHEN idle >= 1800000 THEN 'hang' WHEN idle >= 300000 THEN 'slow' ELSE 'ok' END AS state FROM i",
    "config_diff_full_outer": f"SELECT coalesce(a.key, b.key) AS key, a.value AS value_a, b.value AS value_b FROM ({CONFIG_A}) a FULL JOIN ({CONFIG_B}) b ON a.key = b.key WHERE a.value IS DISTINCT FROM b.value AND NOT starts_with(coalesce(a.key, b.key), 'k1')",
    "latest_run_max_by": f"SELECT method, seed, max(run) AS run, max_by(accuracy, run) AS accuracy FROM ({NEWEST}) GROUP BY method, seed",
    "oracle_gap_recovery": f"WITH {V}, m AS (SELECT model, avg(macro) FILTER (WHERE method = 'BUILDING') AS a, avg(macro) FILTER (WHERE method = 'MACHINERY') AS r, avg(macro) FILTER (WHERE method = 'FURNITURE') AS o FROM val GROUP BY model) SELECT model, round((a - r) / nullif(o - r, 0), 6) AS recovery FROM m",
    "t_interval_cells": f"WITH {V}, c AS (SELECT set_key, method, count(macro) AS n_seeds, stddev_samp(macro) AS sd FROM val GROUP BY set_key, method) SELECT set_key, method, n_seeds, round(t * sd / sqrt(n_seeds), 6) AS half_width FROM c LEFT JOIN (VALUES {T_TABLE}) q(n, t) ON least(n_seeds, 200) = q.n",
}
