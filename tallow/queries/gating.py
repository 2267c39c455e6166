"""Queries of the gate, the scores and the selections."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tallow.operators import gate as G
from tallow.operators import scoring as S
from tallow.operators import selection as K
from tallow.operators.ranks import percentiles
from tallow.plans.checkpoints import kept
from tallow.queries.inputs import SIGNALS, TOKENS, token_shares, view

CFG = G.GateConfig(span_tokens=2, tau=0.5)
LOGIT = math.log(1.6 / 0.4)
R = "round({}, 6)"


def rounded(df, *exact):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" and c not in exact else F.col(c) for c, t in df.dtypes])


SPANS = f"""tokens AS ({TOKENS}),
spans AS (SELECT pool_id, cast(floor(pos / 2.0) AS BIGINT) AS m, sum(tr) AS st, sum(cf) AS sc, count(*) AS n FROM tokens GROUP BY ALL)"""
COMPONENTS = f"""{SPANS}, comp AS (SELECT pool_id, 1 - sum(st) / greatest(sum(sc), 1e-8) AS delta_bar, min(1 - st / greatest(sc, 1e-8)) FILTER (WHERE sc / n >= 0.5) AS tail,
  count(*) AS n_spans, count(*) FILTER (WHERE sc / n >= 0.5) AS n_valid_spans, sum(n) AS n_common FROM spans GROUP BY pool_id),
rows_ AS (SELECT pool_id, delta_bar, coalesce(tail, delta_bar) AS delta_min, tail IS NULL AS empty_c, n_spans, n_valid_spans, n_common, least(delta_bar, coalesce(tail, delta_bar)) AS delta_raw FROM comp)"""
#: Span counts are few here, so every one with at least 1 record in 24 bins' share closes a bin: a recursion over them.
CURVE = f"""{COMPONENTS}, sizes AS (SELECT n_spans, count(*) AS n, row_number() OVER (ORDER BY n_spans) AS i FROM rows_ GROUP BY n_spans),
need AS (SELECT greatest(200, ceil(sum(n) / 24.0)) AS per_bin, max(n_spans) AS top FROM sizes),
walk AS (SELECT i, n_spans, CASE WHEN n >= per_bin THEN 0 ELSE n END AS held, n >= per_bin AS closes FROM sizes, need WHERE i = 1
  UNION ALL SELECT s.i, s.n_spans, CASE WHEN w.held + s.n >= per_bin THEN 0 ELSE w.held + s.n END, w.held + s.n >= per_bin FROM walk w JOIN sizes s ON s.i = w.i + 1, need),
closed AS (SELECT n_spans AS high, row_number() OVER (ORDER BY n_spans) AS b, count(*) OVER () AS k FROM walk WHERE closes),
edges AS (SELECT coalesce(lag(high) OVER (ORDER BY b), 0) AS low, CASE WHEN b = k THEN greatest(high, top) ELSE high END AS high FROM closed, need),
raw_curve AS (SELECT low, high, quantile_cont(delta_raw, 0.05) AS mu, count(*) AS n FROM rows_ JOIN edges ON n_spans > low AND n_spans <= high GROUP BY low, high)"""
#: A fit that never rises: mu_k = min over i <= k of max over j >= k of the weighted mean of i..j.
FITTED = f"""{CURVE}, num AS (SELECT *, row_number() OVER (ORDER BY low) AS k FROM raw_curve),
means AS (SELECT a.k AS i, b.k AS j, sum(c.mu * c.n) / sum(c.n) AS v FROM num a JOIN num b ON a.k <= b.k JOIN num c ON c.k BETWEEN a.k AND b.k GROUP BY a.k, b.k),
best AS (SELECT k.k, m.i, max(m.v) AS v FROM num k JOIN means m ON m.i <= k.k AND m.j >= k.k GROUP BY k.k, m.i),
curve AS (SELECT low, high, min(v) AS mu, any_value(n) AS n FROM num JOIN best USING (k) GROUP BY low, high)"""
CENTRED = f"""{FITTED}, centred AS (SELECT r.*, mu, delta_raw - mu AS delta_hat FROM rows_ r JOIN curve ON least(n_spans, (SELECT max(high) FROM curve)) > low AND least(n_spans, (SELECT max(high) FROM curve)) <= high)"""
SCALED = f"""{CENTRED}, sc_ AS (SELECT quantile_cont(delta_hat, 0.10) AS q, quantile_disc(delta_hat, 0.5) FILTER (WHERE delta_hat > 0) AS med FROM centred),
s_ AS (SELECT CASE WHEN q > 0 THEN q / {LOGIT} WHEN med > 0 THEN med / {LOGIT} ELSE 1.0 END AS s FROM sc_),
gated AS (SELECT c.*, s, CASE WHEN delta_hat <= 0 THEN 0.0 ELSE least(1.0, greatest(0.0, 2 / (1 + exp(-delta_hat / s)) - 1)) END AS gate FROM centred c, s_)"""
W = "WITH RECURSIVE "


def _tokens(spark, d):
    return view(spark, d, TOKENS)


def gate_lineitem(spark, d):
    g = G.gate(_tokens(spark, d), CFG)
    return rounded(g.select("pool_id", "delta_bar", "delta_min", "delta_raw", "mu", "delta_hat", "s", "gate", "n_spans", "n_valid_spans", "n_common", "empty_c"))


def span_sums(spark, d):
    return rounded(G.spans(_tokens(spark, d), 2))


def gate_components(spark, d):
    return rounded(G.components(_tokens(spark, d), CFG))


def tail_quantile(spark, d):
    return rounded(G.components(_tokens(spark, d), G.GateConfig(span_tokens=2, tau=0.5, tail_quantile=0.25)).select("pool_id", "delta_min"))


def prefix_gain(spark, d):
    return rounded(G.prefix_gain(_tokens(spark, d), 3))


def null_curve_bins(spark, d):
    return rounded(G.null_curve(G.components(_tokens(spark, d), CFG), 0.05, monotone=False))


def null_curve_pava(spark, d):
    return rounded(G.null_curve(G.components(_tokens(spark, d), CFG), 0.05))


def zero_rate_report(spark, d):
    return rounded(G.zero_rates(G.gate(_tokens(spark, d), CFG)))


def calibrate_scale(spark, d):
    with kept(*[G.components(t, CFG).select("n_spans", "delta_raw") for t in token_shares(spark, d)]) as rows:
        return rounded(G.scale(G.centre(rows, G.null_curve(rows, 0.05)), 0.10, 0.6))


def inpool_scale_fallback(spark, d):
    rows = G.components(_tokens(spark, d), CFG).withColumn("delta_hat", F.col("delta_raw") - 0.3)
    return rounded(G.scale(rows, 0.10, 0.6))


def gate_k2_dispersion(spark, d):
    t = _tokens(spark, d)
    one = G.components(t, CFG).select("pool_id", G.sigmoid_gate(F.col("delta_raw"), F.lit(0.2)).alias("gate"))
    two = G.components(t.withColumn("tr", F.col("tr2")), CFG).select("pool_id", G.sigmoid_gate(F.col("delta_raw"), F.lit(0.2)).alias("gate"))
    return rounded(G.combine(one.unionByName(two)))


def undefined_policy(spark, d):
    rows = G.components(_tokens(spark, d), CFG).select("pool_id", (F.col("n_common") < 3).alias("undefined"), G.sigmoid_gate(F.col("delta_raw"), F.lit(0.2)).alias("g"))
    return rounded(rows.select("pool_id", *[G.apply_undefined(F.col("g"), F.col("undefined"), p).alias(p) for p in ("neutral", "pass", "zero")]))


def span_profile(spark, d):
    return rounded(G.span_profile(_tokens(spark, d), 2, 3))


def argmin_profile(spark, d):
    return rounded(G.argmin_profile(_tokens(spark, d), 2))


def pos_null_centering(spark, d):
    return rounded(G.position_centred(_tokens(spark, d), 2, 0.05))


def gate_distribution(spark, d):
    q = F.percentile("gate", F.array(*map(F.lit, (0.05, 0.25, 0.5, 0.75, 0.95))))
    g = G.gate(_tokens(spark, d), CFG).agg(q.alias("q"), F.count_if(F.col("gate") == 0).alias("n_zero"), F.count_if((F.col("gate") > 0) & (F.col("gate") < 0.99)).alias("n_graded"), F.count_if(F.col("gate") >= 0.99).alias("n_open"))
    return rounded(g.select(*[F.col("q")[i].alias(f"p{p:02d}") for i, p in enumerate((5, 25, 50, 75, 95))], "n_zero", "n_graded", "n_open"))


def gate_config_sweep(spark, d):
    widths, taus = (1, 2, 4), (0.5, 2.0)
    with kept(*[G.sweep(t, widths, taus).drop("pool_id") for t in token_shares(spark, d)]) as records:
        at = F.explode(F.array(*[F.struct(F.lit(tau).alias("tau"), F.col(f"delta_raw_{i}").alias("delta_raw"), F.col(f"n_valid_spans_{i}").alias("n")) for i, tau in enumerate(taus)]))
        rows = records.select("w", at.alias("x")).select("w", "x.*")
        means = rows.groupBy("w", "tau").agg(F.avg(F.when(F.col("delta_raw") > 0, 1.0).otherwise(0.0)).alias("raw_positive"), F.avg("n").alias("valid_spans"))
        mean = {(r["w"], r["tau"]): r for r in means.collect()}
        median = {(r["w"], r["tau"]): r["value"] for r in percentiles(rows, "delta_raw", [0.5], ("w", "tau")).collect()}
    out = [(w, tau, r and r["raw_positive"], median.get((w, tau)), r and r["valid_spans"]) for w in widths for tau in taus for r in [mean.get((w, tau))]]
    return rounded(spark.createDataFrame(out, "w int, tau double, raw_positive double, median double, valid_spans double"))


def _sweep_sql():
    parts = []
    for w in (1, 2, 4):
        for tau in (0.5, 2.0):
            parts.append(f"""SELECT {w} AS w, {tau} AS tau, round(avg(CASE WHEN delta_raw > 0 THEN 1.0 ELSE 0.0 END), 6) AS raw_positive, round(quantile_cont(delta_raw, 0.5), 6) AS median, round(avg(nv), 6) AS valid_spans FROM (
              SELECT pool_id, least(1 - sum(st) / greatest(sum(sc), 1e-8), coalesce(min(1 - st / greatest(sc, 1e-8)) FILTER (WHERE sc / n >= {tau}), 1 - sum(st) / greatest(sum(sc), 1e-8))) AS delta_raw, count(*) FILTER (WHERE sc / n >= {tau}) AS nv
              FROM (SELECT pool_id, floor(pos / {w}.0) AS m, sum(tr) AS st, sum(cf) AS sc, count(*) AS n FROM ({TOKENS}) GROUP BY ALL) GROUP BY pool_id)""")
    return " UNION ALL ".join(parts)


def _signals(spark, d):
    return view(spark, d, SIGNALS)


def pool_reward(spark, d):
    return rounded(S.pool_reward(_signals(spark, d)).select("pool_id", "w", "reward"))


def minmax_align(spark, d):
    return rounded(S.min_max(_signals(spark, d), "align_raw", "align").select("pool_id", "align"))


def zscore_utility(spark, d):
    return rounded(S.z_score(_signals(spark, d), "loss", "z").select("pool_id", "z"))


def rank01_midrank(spark, d):
    return rounded(S.rank01(_signals(spark, d), "n_tokens", "r").select("pool_id", "r"))


def rank01_positional(spark, d):
    return rounded(S.rank01_positional(_signals(spark, d), "n_tokens", "pool_id", "r").select("pool_id", "r"))


def rank01_within_type(spark, d):
    return rounded(S.rank01(_signals(spark, d), "loss", "r", ["type"]).select("pool_id", "type", "r"))


def _scored(spark, d):
    s = S.min_max(S.pool_reward(_signals(spark, d)), "align_raw", "align")
    g = G.gate(_tokens(spark, d), CFG).select(F.col("pool_id").alias("_p"), "gate")
    return s.join(g, s["pool_id"] == g["_p"]).drop("_p")


def legacy_score(spark, d):
    s = S.min_max(S.pool_reward(_signals(spark, d)), "align_raw", "align")
    return rounded(s.select("pool_id", S.legacy_score(F.col("reward"), F.col("align"), 0.5).alias("score")))


def gated_score(spark, d):
    return rounded(_scored(spark, d).select("pool_id", S.gated_score(F.col("gate"), F.col("reward"), F.col("align"), 0.5).alias("score")))


def mvf_score(spark, d):
    s = S.rank01(S.rank01(_signals(spark, d), "loss", "q"), "entropy", "dif")
    s = S.rank01(s, "align_raw", "al")
    return rounded(s.select("pool_id", S.mvf_score(F.col("q"), F.col("dif"), F.col("al"), gamma=2.0).alias("score")))


def gated_topk(spark, d):
    s = _scored(spark, d)
    s = s.withColumn("score", F.round(S.gated_score(F.col("gate"), F.col("reward"), F.col("align"), 0.5), 6)).withColumn("fallback", F.round(F.col("reward"), 6))
    return rounded(K.top(K.gated_key(s, "score", "fallback", "gate"), "select_key", 300).select("pool_id", "select_key"))


def topb(spark, d):
    return K.top(_signals(spark, d), "loss", 500).select("pool_id", "loss")


def constrained_topk(spark, d):
    return K.constrained_top(_signals(spark, d), "loss", "cluster_id", 400).select("pool_id", "cluster_id", "loss", "is_extra")


def random_subset_md5(spark, d):
    return K.random_subset(_signals(spark, d), 250, 42, "random").select("pool_id")


def ifd_scores(spark, d):
    return rounded(_signals(spark, d).select("pool_id", S.ifd(F.col("loss"), F.col("entropy")).alias("ifd"), S.ifd_ratio(F.col("loss"), F.when(F.col("entropy") != 0, F.col("entropy"))).alias("ifd_ratio")))


def ifd_range_topk(spark, d):
    s = _signals(spark, d).withColumn("ifd", F.round(S.ifd(F.col("entropy"), F.col("loss")), 6))
    return K.range_top(s, "ifd", 0.3, 0.6, 200).select("pool_id", "ifd")


def length_sorted_batches(spark, d):
    return K.length_batches(_signals(spark, d), "n_tokens", 64).select("pool_id", "batch")


HISTORY = """SELECT user_id AS pool_id, cast(dense_rank() OVER (ORDER BY cast(ts AS DATE)) AS INT) AS epoch, value AS loss, event_id FROM events"""
EPOCHS = f"SELECT pool_id, epoch, round(avg(loss), 6) AS loss FROM ({HISTORY}) GROUP BY pool_id, epoch"


def epoch_progress(spark, d):
    return rounded(S.progress(view(spark, d, EPOCHS)))


def learnable_difficulty_split(spark, d):
    h = view(spark, d, EPOCHS).withColumn("selected_prev", F.col("pool_id") % 2 == 0)
    return rounded(S.learnable_difficulty(h).select("pool_id", "epoch", "difficulty"))


MID = "(rank() OVER ({p} ORDER BY {x}) - 1 + (count(*) OVER (PARTITION BY {q}{x}) - 1) / 2.0) / nullif(count(*) OVER ({p}) - 1, 0)"


def mid(x, by=""):
    return f"coalesce({MID.format(p=f'PARTITION BY {by}' if by else '', q=f'{by}, ' if by else '', x=x)}, 0.5)"


SIG = f"sig AS ({SIGNALS})"
REWARD = f"""{SIG}, w_ AS (SELECT var_samp(loss) / (var_samp(loss) + var_samp(entropy) + 1e-8) AS w, min(align_raw) AS lo, max(align_raw) AS hi FROM sig),
rew AS (SELECT sig.*, w, w * loss + (1 - w) * entropy AS reward, (align_raw - lo) / (hi - lo) AS align FROM sig, w_)"""
GATED = "round(gate * reward * (1 + 0.5 * align), 6)"

QUERIES = {
    f.__name__: f
    for f in (
        gate_lineitem, span_sums, gate_components, tail_quantile, prefix_gain, null_curve_bins, null_curve_pava, zero_rate_report, calibrate_scale, inpool_scale_fallback, gate_k2_dispersion,
        undefined_policy, span_profile, argmin_profile, pos_null_centering, gate_distribution, gate_config_sweep, pool_reward, minmax_align, zscore_utility, rank01_midrank, rank01_positional,
        rank01_within_type, legacy_score, gated_score, mvf_score, gated_topk, topb, constrained_topk, random_subset_md5, ifd_scores, ifd_range_topk, length_sorted_batches, epoch_progress, learnable_difficulty_split,
    )
}

_SIG = "CASE WHEN {x} <= 0 THEN 0.0 ELSE least(1.0, greatest(0.0, 2 / (1 + exp(-({x}) / 0.2)) - 1)) END"
_C2 = """(SELECT pool_id, least(1 - sum(st) / greatest(sum(sc), 1e-8), coalesce(min(1 - st / greatest(sc, 1e-8)) FILTER (WHERE sc / n >= 0.5), 1 - sum(st) / greatest(sum(sc), 1e-8))) AS x
 FROM (SELECT pool_id, floor(pos / 2.0) AS m, sum({t}) AS st, sum(cf) AS sc, count(*) AS n FROM tokens GROUP BY ALL) GROUP BY pool_id)"""

ORACLE_SQL = {
    "gate_lineitem": f"{W}{SCALED} SELECT pool_id, round(delta_bar, 6) AS delta_bar, round(delta_min, 6) AS delta_min, round(delta_raw, 6) AS delta_raw, round(mu, 6) AS mu, round(delta_hat, 6) AS delta_hat, round(s, 6) AS s, round(gate, 6) AS gate, n_spans, n_valid_spans, cast(n_common AS BIGINT) AS n_common, empty_c FROM gated",
    "span_sums": f"{W}{SPANS} SELECT pool_id, m, round(st, 6) AS span_true, round(sc, 6) AS span_cf, n AS span_len FROM spans",
    "gate_components": f"{W}{COMPONENTS} SELECT pool_id, round(delta_bar, 6) AS delta_bar, n_spans, n_valid_spans, cast(n_common AS BIGINT) AS n_common, round(delta_min, 6) AS delta_min, empty_c, round(delta_raw, 6) AS delta_raw FROM rows_",
    "tail_quantile": f"{W}{SPANS} SELECT pool_id, round(coalesce(quantile_cont(1 - st / greatest(sc, 1e-8), 0.25) FILTER (WHERE sc / n >= 0.5), 1 - sum(st) / greatest(sum(sc), 1e-8)), 6) AS delta_min FROM spans GROUP BY pool_id",
    "prefix_gain": f"SELECT pool_id, round(1 - sum(tr) / greatest(sum(cf), 1e-8), 6) AS prefix_gain FROM ({TOKENS}) WHERE pos < 3 GROUP BY pool_id",
    "null_curve_bins": f"{W}{CURVE} SELECT low, high, round(mu, 6) AS mu, n FROM raw_curve",
    "null_curve_pava": f"{W}{FITTED} SELECT low, high, round(mu, 6) AS mu, n FROM curve",
    "zero_rate_report": f"{W}{SCALED} SELECT n_spans, count(*) AS n, round(avg(CASE WHEN delta_hat <= 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_rate FROM gated GROUP BY n_spans",
    "calibrate_scale": f"{W}{SCALED} SELECT round(s, 6) AS s FROM s_",
    "inpool_scale_fallback": f"{W}{COMPONENTS}, x AS (SELECT delta_raw - 0.3 AS v FROM rows_), y AS (SELECT quantile_cont(v, 0.1) AS q, quantile_disc(v, 0.5) FILTER (WHERE v > 0) AS med FROM x) SELECT round(CASE WHEN q > 0 THEN q / {LOGIT} WHEN med > 0 THEN med / {LOGIT} ELSE 1.0 END, 6) AS s FROM y",
    "gate_k2_dispersion": f"WITH tokens AS ({TOKENS}), g AS (SELECT pool_id, {_SIG.format(x='x')} AS gate FROM {_C2.format(t='tr')} UNION ALL SELECT pool_id, {_SIG.format(x='x')} FROM {_C2.format(t='tr2')}) SELECT pool_id, round(avg(gate), 6) AS gate_mean, round(stddev_pop(gate), 6) AS dispersion, round(avg(gate) * greatest(0.0, 1 - 2.0 * stddev_pop(gate)), 6) AS gate FROM g GROUP BY pool_id",
    "undefined_policy": f"{W}{COMPONENTS}, g AS (SELECT pool_id, n_common < 3 AS u, {_SIG.format(x='delta_raw')} AS g FROM rows_) SELECT pool_id, round(CASE WHEN u THEN 0.6 ELSE g END, 6) AS neutral, round(CASE WHEN u THEN 1.0 ELSE g END, 6) AS pass, round(CASE WHEN u THEN 0.0 ELSE g END, 6) AS zero FROM g",
    "span_profile": f"{W}{SPANS} SELECT least(m, 3) AS m, count(*) AS n, round(avg(st / n), 6) AS true_loss, round(avg(sc / n), 6) AS cf_loss, round(avg(sc / n - st / n), 6) AS gap, round(avg(1 - st / greatest(sc, 1e-8)), 6) AS gain, round(quantile_cont(1 - st / greatest(sc, 1e-8), 0.05), 6) AS p05 FROM spans GROUP BY least(m, 3)",
    "argmin_profile": f"{W}{SPANS}, g AS (SELECT *, row_number() OVER (PARTITION BY pool_id ORDER BY 1 - st / greatest(sc, 1e-8), m) AS r FROM spans) SELECT m, count(*) AS available, count(*) FILTER (WHERE r = 1) AS hits, round(count(*) FILTER (WHERE r = 1) / count(*), 6) AS rate FROM g GROUP BY m",
    "pos_null_centering": f"{W}{SPANS}, g AS (SELECT pool_id, m, 1 - st / greatest(sc, 1e-8) AS g FROM spans), mu AS (SELECT m, CASE WHEN count(*) > 20 THEN quantile_cont(g, 0.05) ELSE 0 END AS mu FROM g GROUP BY m) SELECT pool_id, round(min(g - mu), 6) AS centred_min FROM g JOIN mu USING (m) GROUP BY pool_id",
    "gate_distribution": f"{W}{SCALED} SELECT " + ", ".join(f"round(quantile_cont(gate, 0.{p:02d}), 6) AS p{p:02d}" for p in (5, 25, 50, 75, 95)) + ", count(*) FILTER (WHERE gate = 0) AS n_zero, count(*) FILTER (WHERE gate > 0 AND gate < 0.99) AS n_graded, count(*) FILTER (WHERE gate >= 0.99) AS n_open FROM gated",
    "gate_config_sweep": _sweep_sql(),
    "pool_reward": f"WITH {REWARD} SELECT pool_id, round(w, 6) AS w, round(reward, 6) AS reward FROM rew",
    "minmax_align": f"WITH {REWARD} SELECT pool_id, round(align, 6) AS align FROM rew",
    "zscore_utility": f"WITH {SIG} SELECT pool_id, round((loss - avg(loss) OVER ()) / greatest(stddev_pop(loss) OVER (), 1e-4), 6) AS z FROM sig",
    "rank01_midrank": f"WITH {SIG} SELECT pool_id, round({mid('n_tokens')}, 6) AS r FROM sig",
    "rank01_positional": f"WITH {SIG} SELECT pool_id, round((row_number() OVER (ORDER BY n_tokens, pool_id) - 1) / (count(*) OVER () - 1), 6) AS r FROM sig",
    "rank01_within_type": f"WITH {SIG} SELECT pool_id, type, round({mid('loss', 'type')}, 6) AS r FROM sig",
    "legacy_score": f"WITH {REWARD} SELECT pool_id, round(reward * (1 + 0.5 * align), 6) AS score FROM rew",
    "gated_score": f"{W}{SCALED}, {REWARD} SELECT rew.pool_id, {GATED} AS score FROM rew JOIN gated ON rew.pool_id = gated.pool_id",
    "mvf_score": f"WITH {SIG}, r AS (SELECT pool_id, {mid('loss')} AS q, {mid('entropy')} AS dif, {mid('align_raw')} AS al FROM sig) SELECT pool_id, round(power(q + 1e-3, 2) * (0.1 + 0.9 * dif + 1e-3) * (1 + 0.5 * al), 6) AS score FROM r",
    "gated_topk": f"{W}{SCALED}, {REWARD}, x AS (SELECT rew.pool_id, gate, {GATED} AS score, round(reward, 6) AS fb FROM rew JOIN gated ON rew.pool_id = gated.pool_id), y AS (SELECT pool_id, CASE WHEN gate > 0 THEN 2 + {mid('score')} ELSE {mid('fb')} END AS k FROM x) SELECT pool_id, round(k, 6) AS select_key FROM y ORDER BY k DESC, pool_id LIMIT 300",
    "topb": f"WITH {SIG} SELECT pool_id, loss FROM sig ORDER BY loss DESC, pool_id LIMIT 500",
    "constrained_topk": f"WITH {SIG}, x AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY loss DESC, pool_id) > 1 AS is_extra FROM sig) SELECT pool_id, cluster_id, loss, is_extra FROM x ORDER BY is_extra, loss DESC, pool_id LIMIT 400",
    "random_subset_md5": f"WITH {SIG} SELECT pool_id FROM sig ORDER BY md5('42:random:' || pool_id), pool_id LIMIT 250",
    "ifd_scores": f"WITH {SIG} SELECT pool_id, round(exp(greatest(-15, least(15, loss - entropy))), 6) AS ifd, round(CASE WHEN entropy = 0 THEN NULL WHEN loss / entropy > 1 THEN 0 ELSE loss / entropy END, 6) AS ifd_ratio FROM sig",
    "ifd_range_topk": f"WITH {SIG}, x AS (SELECT pool_id, round(exp(greatest(-15, least(15, entropy - loss))), 6) AS ifd FROM sig), n AS (SELECT count(*) FILTER (WHERE ifd BETWEEN 0.3 AND 0.6) >= 200 AS e FROM x) SELECT pool_id, ifd FROM x, n WHERE ifd BETWEEN 0.3 AND 0.6 OR NOT e ORDER BY ifd DESC, pool_id LIMIT 200",
    "length_sorted_batches": f"WITH {SIG} SELECT pool_id, cast(floor((row_number() OVER (ORDER BY n_tokens DESC, pool_id) - 1) / 64.0) AS BIGINT) AS batch FROM sig",
    "epoch_progress": f"WITH h AS ({EPOCHS}) SELECT pool_id, epoch, loss, round(greatest(lag(loss) OVER (PARTITION BY pool_id ORDER BY epoch) - loss, CASE WHEN lag(loss) OVER (PARTITION BY pool_id ORDER BY epoch) IS NULL THEN 0 ELSE 0 END), 6) AS progress FROM h",
    "learnable_difficulty_split": f"WITH h AS ({EPOCHS}), p AS (SELECT pool_id, epoch, loss, pool_id % 2 = 0 AS sel, lag(loss) OVER (PARTITION BY pool_id ORDER BY epoch) AS b FROM h), x AS (SELECT pool_id, epoch, sel, CASE WHEN sel THEN greatest(coalesce(b - loss, 0), 0) ELSE loss END AS x FROM p) SELECT pool_id, epoch, round({mid('x', 'sel')}, 6) AS difficulty FROM x",
}
