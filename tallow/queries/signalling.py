"""Queries of completeness, joined losses, qualities, rewards and detection tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallow.functions import text as X
from tallow.functions.hashing import seeded
from tallow.operators import corruption as C
from tallow.operators import gate as G
from tallow.operators import scoring as S
from tallow.operators import selection as K
from tallow.operators import signals as Z
from tallow.operators import vectors as V
from tallow.plans import schedules
from tallow.queries.gating import CFG, CENTRED, SCALED, W, rounded
from tallow.queries.inputs import LABELLED, PAIRS, SIGNALS, TOKENS, table, view
from tallow.queries.texts import B, COMPLETE, LEN, PAIR, U, WRAP, sq, strip_sql, turned, words_sql
from tallow.sources import runs


def completeness(spark, d):
    rows = view(spark, d, "SELECT conv_id, turn, text, turn % 3 <> 0 AS eos FROM conversations")
    return rows.select("conv_id", "turn", Z.completeness(X.is_complete(F.col("text")), F.col("eos"), X.strip(F.col("text")) != "").alias("c"))


def gate_with_c(spark, d):
    g = G.gate(view(spark, d, TOKENS), CFG)
    flags = view(spark, d, "SELECT o_orderkey AS pool_id, CASE WHEN o_orderkey % 5 = 0 THEN 2e-1 ELSE 1e0 END AS c FROM orders WHERE o_orderkey % 3 <> 0")
    return rounded(Z.with_completeness(g, flags).select("pool_id", "gate", "sigma_part", "c"))


def prefix_join(spark, d):
    t = view(spark, d, TOKENS)
    true, other = t.select("pool_id", "pos", F.col("tr").alias("nll")), t.filter("pos < 1 + pool_id % 4").select("pool_id", "pos", F.col("cf").alias("nll"))
    return rounded(Z.common_prefix(true, other).groupBy("pool_id").agg(F.sum("tr").alias("tr"), F.sum("cf").alias("cf"), F.count("*").alias("n_common")))


def aligned_pools(spark, d):
    p = view(spark, d, PAIRS)
    c = C.counterfactual(p, 1, 7).select("pool_id", "instruction", "output")
    return Z.aligned(p.select("pool_id", "instruction", "output"), c).select("pool_id", F.md5("cf_instruction").alias("h"), (F.col("output") == F.col("cf_output")).alias("same"))


def counterfactual_sanity(spark, d):
    p = view(spark, d, PAIRS)
    c = C.counterfactual(p, 1, 7).select("pool_id", "instruction", "output")
    return rounded(Z.counterfactual_sanity(Z.aligned(p.select("pool_id", "instruction", "output"), c)))


def mean_loss(spark, d):
    return Z.mean_loss(view(spark, d, TOKENS)).withColumn("loss", F.round("loss", 4))


def type_table(spark, d):
    g = G.gate(view(spark, d, TOKENS), CFG).select("pool_id", "gate")
    flags = view(spark, d, "SELECT o_orderkey AS pool_id, o_orderstatus AS type, CASE WHEN o_orderkey % 5 = 0 THEN 2e-1 ELSE 1e0 END AS c FROM orders")
    rows = Z.with_completeness(g, flags).join(flags.select("pool_id", "type"), "pool_id")
    return rounded(Z.type_table(rows))


def completeness_audit(spark, d):
    rows = view(spark, d, "SELECT text, CASE turn % 3 WHEN 0 THEN 'clean' WHEN 1 THEN 'truncated' ELSE 'noisy' END AS kind FROM conversations")
    return rounded(Z.completeness_audit(rows, "text", "kind"))


def type_precision(spark, d):
    return rounded(Z.type_precision(view(spark, d, LABELLED), "score", "type", "pool_id"))


def signal_table(spark, d):
    rows = view(spark, d, SIGNALS).withColumns({"dirty": (F.col("type") == "F").cast("int"), "align_raw": F.col("align_raw").cast("double"), "loss": F.col("loss").cast("double"), "entropy": F.col("entropy").cast("double")})
    return rounded(Z.signal_table(rows, ["loss", "entropy", "align_raw"], "dirty", "type", 100))


#: Statistics of a record that a sweep compares: overall, first span, prefixes, least span.
def statistic_sweep(spark, d):
    t = view(spark, d, TOKENS)
    s = G.spans(t, 2).withColumn("g", G.gain(F.col("span_true"), F.col("span_cf")))
    rows = s.groupBy("pool_id").agg(G.gain(F.sum("span_true"), F.sum("span_cf")).alias("overall"), F.min("g").alias("least"), F.max(F.when(F.col("m") == 0, F.col("g"))).alias("first"))
    rows = rows.withColumn("both", F.least("overall", "least")).join(view(spark, d, "SELECT o_orderkey AS pool_id, CASE o_orderstatus WHEN 'O' THEN 'clean' ELSE o_orderstatus END AS type FROM orders"), "pool_id")
    flat = Z.unpivoted(rows, ["pool_id", "type"], ["overall", "least", "first", "both"]).withColumn("value", F.round(-F.col("value"), 9))
    return rounded(Z.type_precision(flat, "value", "type", "pool_id", ["signal"]))


def reliability_quality(spark, d):
    rows = view(spark, d, f"SELECT pool_id, 1 AS k, avg(tr) AS orig, avg(cf) AS cf FROM ({TOKENS}) GROUP BY pool_id UNION ALL SELECT pool_id, 2, avg(tr), avg(tr2) FROM ({TOKENS}) GROUP BY pool_id")
    return rounded(Z.reliability(rows, 0.5))


def rating_score(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 5), lambda x: F.abs(x.cast("double"))).alias("p"))
    return rounded(e.select("vec_id", Z.rating_score(F.col("p")).alias("score")))


def sentence_score(spark, d):
    e = table(spark, d, "embeddings").select("label", F.get("embedding", F.lit(0)).cast("double").alias("s"))
    return rounded(Z.sentence_score(e, "label", "s"))


def agent_reward(spark, d):
    rows = view(spark, d, SIGNALS).withColumns({"loss": F.col("loss").cast("double"), "entropy": F.col("entropy").cast("double")})
    return rounded(Z.agent_reward(rows).select("pool_id", "w", "reward"))


def gae_advantages(spark, d):
    rows = view(spark, d, "SELECT c_nationkey AS episode, c_custkey, c_acctbal / 1000 AS r FROM customer")
    rows = rows.groupBy("episode").agg(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "r"))), lambda x: x["r"].cast("double")).alias("r"))
    found = rows.select("episode", F.posexplode(Z.advantages(F.col("r"), F.transform("r", lambda x: x / 2))).alias("t", "advantage"))
    return rounded(found)


def cosine_rate(spark, d):
    return rounded(schedules.cosine_rate(spark, 100, 10))


def extreme_examples(spark, d):
    rows = view(spark, d, SIGNALS).select("pool_id", F.col("loss").cast("double").alias("loss"))
    return rounded(Z.extremes(rows, "loss", 5, seeded(3, "mid", F.col("pool_id"))))


def seeded_samples(spark, d):
    rows = view(spark, d, "SELECT o_orderkey AS pool_id FROM orders")
    parts = [K.random_subset(rows, 20, 42 + 100 * epoch + 1, "probe").select(F.lit(epoch).alias("epoch"), "pool_id") for epoch in (1, 2)]
    return parts[0].unionAll(parts[1])


def layer_top(spark, d):
    """The best 25 by the sum of alignments."""
    e = table(spark, d, "embeddings")
    directions = V.as_arrays(V.mean_vectors(e, "label", "embedding"), "label").drop("label")
    scores = V.alignment(e, directions, "vec_id", "embedding", total=True).withColumn("align", F.round("align", 6))
    return rounded(K.top(scores, "align", 25, "vec_id"))


def best_config(spark, d):
    """Of swept settings the one that parts best, then drifts least."""
    rows = view(spark, d, "SELECT o_orderpriority AS config, o_orderstatus AS note, round(avg(o_totalprice), 2) AS sep, round(min(o_totalprice), 2) AS drift FROM orders GROUP BY o_orderpriority, o_orderstatus")
    return rounded(rows.filter("note = 'O'").orderBy(F.desc("sep"), "drift", "config").limit(1))


def cross_source_donors(spark, d):
    targets = view(spark, d, PAIRS).select("pool_id", "output")
    donors = view(spark, d, "SELECT doc_id AS pool_id, text AS output FROM documents WHERE doc_id % 3 = 0")
    return C.cross_source(targets, donors, 42, 4).select("pool_id", "bucket", "donor_id")


def replaced_outputs(spark, d):
    p = view(spark, d, PAIRS)
    targets = p.filter("pool_id % 4 = 0")
    texts = targets.select("pool_id", F.concat(F.lit("wrong "), F.col("pool_id").cast("string")).alias("text"))
    return C.replaced(p, texts, targets).select("pool_id", F.md5("output").alias("h"))


def typed_pool(spark, d):
    entries = view(spark, d, "SELECT doc_id AS pool_id, 'noisy' AS type FROM labels WHERE quality = 0")
    return C.typed(view(spark, d, "SELECT doc_id AS pool_id FROM documents"), entries).groupBy("type").agg(F.count("*").alias("n"))


def united_pools(spark, d):
    a, b = view(spark, d, "SELECT item_id AS pool_id, text AS output FROM benchmark"), view(spark, d, "SELECT doc_id AS pool_id, text AS output FROM documents")
    return C.united({"items": a, "docs": b}).select("pool_id", "source", "source_id")


def cell_states(spark, d):
    trained = view(spark, d, "SELECT o_custkey AS cell, max(o_orderdate) AS modified, max(o_totalprice) > 200000 AS sealed FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey")
    evaluated = view(spark, d, "SELECT o_custkey AS cell, max(o_orderdate) AS modified FROM orders WHERE o_orderpriority < '3' GROUP BY o_custkey")
    return runs.states(trained, evaluated, ["cell"]).select("cell", "state")


def sealed_epochs(spark, d):
    rows = view(spark, d, "SELECT o_custkey AS run, CASE WHEN o_orderkey % 9 = 0 THEN 'epoch_last' WHEN o_orderkey % 7 = 0 THEN 'tmp' ELSE 'epoch_' || (o_orderkey % 12) END AS name, o_orderstatus <> 'P' AS sealed FROM orders")
    return runs.sealed_epoch(rows, ["run"])


def length_scaled(spark, d):
    """Losses of a record as shares of the pool's, with records that have none."""
    rows = view(spark, d, "SELECT o_orderkey AS pool_id, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS x FROM orders").withColumn("x", F.col("x").cast("double"))
    return rounded(S.rank01(rows, "x", "r").select("pool_id", "r"))


def delta_scale(spark, d):
    rows = Z.mean_loss(view(spark, d, TOKENS)).join(Z.mean_loss(view(spark, d, TOKENS), "cf").withColumnRenamed("loss", "cf").drop("n_tokens"), "pool_id")
    return rounded(G.scale(rows.withColumn("delta_hat", F.col("cf") - F.col("loss")), 0.10, 0.6))


QUERIES = {
    f.__name__: f
    for f in (
        completeness, gate_with_c, prefix_join, aligned_pools, counterfactual_sanity, mean_loss, type_table, completeness_audit, type_precision, signal_table, statistic_sweep, reliability_quality,
        rating_score, sentence_score, agent_reward, gae_advantages, cosine_rate, extreme_examples, seeded_samples, layer_top, best_config, cross_source_donors, replaced_outputs, typed_pool, united_pools,
        cell_states, sealed_epochs, length_scaled, delta_scale,
    )
}

DONE = f"WITH c AS (SELECT *, regexp_replace(text, {sq(B + '+$')}, '') AS t FROM {{src}}), d AS (SELECT *, {words_sql('t')} AS w FROM c)"
ONE = f"WITH {LEN}, one AS ({turned(1007)})"
MEANS = "WITH x AS (SELECT vec_id, label, unnest(range(64)) AS idx, embedding FROM embeddings), f AS (SELECT vec_id, label, idx, cast(embedding[idx + 1] AS DOUBLE) AS v FROM x), m AS (SELECT label, idx, avg(v) AS mean FROM f GROUP BY ALL)"
LOGIT4 = "ln(4.0)"
BUCKETED = "least(floor((row_number() OVER (ORDER BY len({w}), pool_id) - 1) * 4 / count(*) OVER ()), 3)::INT"


def ap_sql(rows: str, score: str, by: str = "") -> str:
    part, sel = (f"PARTITION BY {by} ", f"{by}, ") if by else ("", "")
    return f"""WITH r AS ({rows}), p AS (SELECT {sel}type, pool_id, {score} AS s, count(*) FILTER (WHERE type = 'clean') OVER ({part}ORDER BY {score} DESC, pool_id) AS before FROM r),
      o AS (SELECT {sel}type, before, row_number() OVER (PARTITION BY {sel}type ORDER BY s DESC, pool_id) AS own FROM p WHERE type <> 'clean')
      SELECT {sel}type, round(avg(own / (own + before)), 6) AS ap, count(*) AS positives FROM o GROUP BY ALL"""


ORACLE_SQL = {
    "completeness": f"{DONE.format(src='conversations')} SELECT conv_id, turn, CASE WHEN {strip_sql('text')} <> '' AND turn % 3 <> 0 AND {COMPLETE} THEN 1.0 ELSE 0.2 END AS c FROM d",
    "gate_with_c": f"{W}{SCALED}, f AS (SELECT o_orderkey AS pool_id, CASE WHEN o_orderkey % 5 = 0 THEN 0.2 ELSE 1.0 END AS c FROM orders WHERE o_orderkey % 3 <> 0) SELECT pool_id, round(coalesce(c, 1.0) * gate, 6) AS gate, round(gate, 6) AS sigma_part, coalesce(c, 1.0) AS c FROM gated LEFT JOIN f USING (pool_id)",
    "prefix_join": f"WITH t AS ({TOKENS}) SELECT pool_id, round(sum(tr), 6) AS tr, round(sum(cf), 6) AS cf, count(*) AS n_common FROM t WHERE pos < 1 + pool_id % 4 GROUP BY pool_id",
    "aligned_pools": f"{ONE} SELECT one.pool_id, md5(pairs.instruction) AS h, true AS same FROM one JOIN pairs ON pairs.pool_id = partner_id",
    "counterfactual_sanity": f"{ONE}, j AS (SELECT a.instruction = b.instruction AS same FROM one JOIN pairs a ON a.pool_id = one.pool_id JOIN pairs b ON b.pool_id = partner_id), h AS (SELECT instruction, count(*) AS n FROM pairs GROUP BY 1), e AS (SELECT sum(n * (n - 1)) / sum(n) / greatest(sum(n) - 1, 1) AS expected FROM h), r AS (SELECT avg(CASE WHEN same THEN 1.0 ELSE 0.0 END) AS unchanged, count(*) AS n FROM j) SELECT 1.0 AS same_output, round(unchanged, 6) AS unchanged, n, round(expected, 6) AS expected, unchanged <= greatest(0.10, 3 * expected) AS within_budget FROM r, e",
    "mean_loss": f"SELECT pool_id, round(avg(tr), 4) AS loss, count(*) AS n_tokens FROM ({TOKENS}) GROUP BY pool_id",
    "type_table": f"{W}{SCALED}, f AS (SELECT pool_id, o_orderstatus AS type, CASE WHEN o_orderkey % 5 = 0 THEN 0.2 ELSE 1.0 END AS c, gate FROM gated JOIN orders ON o_orderkey = pool_id) SELECT type, count(*) AS n, round(avg(c * gate), 6) AS mean_gate, round(avg(CASE WHEN c * gate = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_rate, round(avg(c), 6) AS mean_c, round(avg(c * gate / c), 6) AS mean_sigma FROM f GROUP BY type",
    "completeness_audit": f"""{DONE.format(src='conversations')}, k AS (SELECT CASE turn % 3 WHEN 0 THEN 'clean' WHEN 1 THEN 'truncated' ELSE 'noisy' END AS kind, NOT ({COMPLETE}) AS a,
      NOT (CASE WHEN t = '' OR ((length(t) - length(replace(t, '```', ''))) // 3) % 2 = 1 THEN false WHEN ends_with(t, '```') THEN true ELSE regexp_matches(regexp_replace(t, {sq(f'[{WRAP}]+$')}, ''), {sq(f'[{X.ENDS}0-9]$')}) END) AS b FROM d),
      u AS (SELECT 'shipped' AS variant, kind, a AS flagged FROM k UNION ALL SELECT 'punctuation only', kind, b FROM k),
      s AS (SELECT variant, count(*) FILTER (WHERE flagged) AS f, count(*) FILTER (WHERE flagged AND kind = 'truncated') AS hit, count(*) FILTER (WHERE flagged AND kind = 'clean') AS cl, count(*) FILTER (WHERE kind = 'truncated') AS nt, count(*) FILTER (WHERE kind = 'clean') AS nc FROM u GROUP BY variant)
      SELECT variant, f AS flagged, round(hit / nullif(nt, 0), 6) AS recall, round(cl / nullif(nc, 0), 6) AS clean_rate, round(hit / nullif(f, 0), 6) AS precision, round(cl / greatest(hit, 1), 6) AS clean_a_catch FROM s""",
    "type_precision": ap_sql(LABELLED, "score"),
    "signal_table": f"""WITH r AS (SELECT pool_id, CASE WHEN type = 'F' THEN 1 ELSE 0 END AS dirty, cast(loss AS DOUBLE) AS loss, cast(entropy AS DOUBLE) AS entropy, cast(align_raw AS DOUBLE) AS align_raw FROM ({SIGNALS})),
      u AS (SELECT pool_id, dirty, 'loss' AS signal, loss AS value FROM r UNION ALL SELECT pool_id, dirty, 'entropy', entropy FROM r UNION ALL SELECT pool_id, dirty, 'align_raw', align_raw FROM r),
      w AS (SELECT signal, dirty, sum(dirty) OVER (PARTITION BY signal ORDER BY value, pool_id ROWS UNBOUNDED PRECEDING) / row_number() OVER (PARTITION BY signal ORDER BY value, pool_id) AS p, row_number() OVER (PARTITION BY signal ORDER BY value DESC, pool_id) <= 100 AS best FROM u)
      SELECT signal, round(avg(p) FILTER (WHERE dirty = 1), 6) AS ap, round(avg(dirty) FILTER (WHERE best), 6) AS dirty_at_k FROM w GROUP BY signal""",
    "statistic_sweep": ap_sql(
        f"""WITH s AS (SELECT pool_id, cast(floor(pos / 2.0) AS BIGINT) AS m, sum(tr) AS st, sum(cf) AS sc FROM ({TOKENS}) GROUP BY ALL), g AS (SELECT pool_id, 1 - sum(st) / greatest(sum(sc), 1e-8) AS overall, min(1 - st / greatest(sc, 1e-8)) AS least_, max(CASE WHEN m = 0 THEN 1 - st / greatest(sc, 1e-8) END) AS first_ FROM s GROUP BY pool_id),
        t AS (SELECT g.*, CASE o_orderstatus WHEN 'O' THEN 'clean' ELSE o_orderstatus END AS type FROM g JOIN orders ON o_orderkey = pool_id)
        SELECT pool_id, type, 'overall' AS signal, round(-overall, 9) AS value FROM t UNION ALL SELECT pool_id, type, 'least', round(-least_, 9) FROM t UNION ALL SELECT pool_id, type, 'first', round(-first_, 9) FROM t UNION ALL SELECT pool_id, type, 'both', round(-least(overall, least_), 9) FROM t""",
        "value", "signal",
    ),
    "reliability_quality": f"WITH l AS (SELECT pool_id, avg(tr) AS o, avg(cf) AS a, avg(tr2) AS b FROM ({TOKENS}) GROUP BY pool_id), g AS (SELECT pool_id, greatest(0.0, least(1.0, 2 * (1 / (1 + exp(-(unnest([a, b]) - o) / 0.5)) - 0.5))) AS g FROM l) SELECT pool_id, round(avg(g) * greatest(0.0, 1 - 2 * stddev_pop(g)), 6) AS quality FROM g GROUP BY pool_id",
    "rating_score": "WITH p AS (SELECT vec_id, list_transform(embedding[1:5], lambda x: abs(cast(x AS DOUBLE))) AS p FROM embeddings), e AS (SELECT vec_id, list_transform(p, lambda x: exp(x / list_sum(p))) AS e FROM p), s AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS s FROM e) SELECT vec_id, round(list_position(s, list_max(s)) * (5 * list_max(s) - list_sum(s)) / 4, 6) AS score FROM s",
    "sentence_score": "SELECT label, round(avg(cast(embedding[1] AS DOUBLE)) / (1 + 0.2 * stddev_pop(cast(embedding[1] AS DOUBLE))), 6) AS score FROM embeddings GROUP BY label",
    "agent_reward": f"WITH r AS (SELECT pool_id, cast(loss AS DOUBLE) AS l, cast(entropy AS DOUBLE) AS h FROM ({SIGNALS})), b AS (SELECT min(l) AS lo, max(l) AS hi, greatest(max(h), 1e-8) AS top FROM r), x AS (SELECT pool_id, CASE WHEN hi - lo < 1e-8 THEN 0.5 ELSE (l - lo) / (hi - lo) END AS d, h / top AS c FROM r, b), w AS (SELECT var_samp(d) / (var_samp(d) + var_samp(c) + 1e-8) AS w FROM x) SELECT pool_id, round(w, 6) AS w, round(w * d + (1 - w) * c, 6) AS reward FROM x, w",
    "gae_advantages": "WITH r AS (SELECT c_nationkey AS episode, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS t, cast(c_acctbal / 1000 AS DOUBLE) AS r FROM customer), s AS (SELECT episode, t, r + 0.99::DOUBLE * coalesce(lead(r) OVER (PARTITION BY episode ORDER BY t), 0) / 2 - r / 2 AS delta FROM r) SELECT a.episode, cast(a.t AS INT) AS t, round(sum(power(0.99::DOUBLE * 0.95::DOUBLE, b.t - a.t) * b.delta), 6) AS advantage FROM s a JOIN s b ON a.episode = b.episode AND b.t >= a.t GROUP BY a.episode, a.t",
    "cosine_rate": "SELECT step, round(CASE WHEN step < 10 THEN step / 10.0 ELSE greatest(0.0, 0.5 * (1 + cos(pi() * (step - 10) / 90.0))) END, 6) AS factor FROM (SELECT unnest(range(101)) AS step)",
    "extreme_examples": f"WITH r AS (SELECT pool_id, cast(loss AS DOUBLE) AS loss FROM ({SIGNALS})) SELECT which, pool_id, round(loss, 6) AS loss FROM (SELECT 'lowest' AS which, * FROM (SELECT * FROM r ORDER BY loss, pool_id LIMIT 5) UNION ALL SELECT 'random', * FROM (SELECT * FROM r ORDER BY md5('3:mid:' || pool_id), pool_id LIMIT 5) UNION ALL SELECT 'highest', * FROM (SELECT * FROM r ORDER BY loss DESC, pool_id LIMIT 5))",
    "seeded_samples": "SELECT * FROM (SELECT 1 AS epoch, o_orderkey AS pool_id FROM orders ORDER BY md5('143:probe:' || o_orderkey), o_orderkey LIMIT 20) UNION ALL SELECT * FROM (SELECT 2, o_orderkey FROM orders ORDER BY md5('243:probe:' || o_orderkey), o_orderkey LIMIT 20)",
    "layer_top": f"{MEANS}, g AS (SELECT idx, sum(mean) AS mean FROM m GROUP BY idx), s AS (SELECT vec_id, round(sum(v * mean), 6) AS align FROM f JOIN g USING (idx) GROUP BY vec_id) SELECT * FROM s ORDER BY align DESC, vec_id LIMIT 25",
    "best_config": "SELECT o_orderpriority AS config, o_orderstatus AS note, round(avg(o_totalprice), 2) AS sep, round(min(o_totalprice), 2) AS drift FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2 ORDER BY sep DESC, drift, config LIMIT 1",
    "cross_source_donors": f"""WITH {PAIR}, t AS (SELECT pool_id, {BUCKETED.format(w=words_sql('output'))} AS bucket FROM pairs), d0 AS (SELECT doc_id AS pool_id, text AS output FROM documents WHERE doc_id % 3 = 0), d AS (SELECT pool_id, {BUCKETED.format(w=words_sql('output'))} AS bucket FROM d0),
      a AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5('42:donor:' || pool_id), pool_id) - 1 AS at FROM t), b AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5('42:donor:' || pool_id), pool_id) - 1 AS at, count(*) OVER (PARTITION BY bucket) AS n FROM d)
      SELECT a.pool_id, a.bucket, b.pool_id AS donor_id FROM a JOIN b ON a.bucket = b.bucket AND a.at % b.n = b.at""",
    "replaced_outputs": f"WITH {PAIR} SELECT pool_id, md5(CASE WHEN pool_id % 4 = 0 THEN 'wrong ' || pool_id ELSE output END) AS h FROM pairs",
    "typed_pool": "SELECT CASE WHEN l.doc_id IS NULL THEN 'clean' ELSE 'noisy' END AS type, count(*) AS n FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 0) l ON d.doc_id = l.doc_id GROUP BY 1",
    "united_pools": "SELECT item_id AS pool_id, 'items' AS source, item_id AS source_id FROM benchmark UNION ALL SELECT doc_id + (SELECT max(item_id) + 1 FROM benchmark), 'docs', doc_id FROM documents",
    "cell_states": "WITH t AS (SELECT o_custkey AS cell, max(o_orderdate) AS a, max(o_totalprice) > 200000 AS sealed FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1), e AS (SELECT o_custkey AS cell, max(o_orderdate) AS b FROM orders WHERE o_orderpriority < '3' GROUP BY 1) SELECT coalesce(t.cell, e.cell) AS cell, CASE WHEN a IS NULL THEN 'LEGACY' WHEN NOT sealed THEN 'NEED-TRAIN' WHEN b IS NULL OR b < a THEN 'NEED-EVAL' ELSE 'DONE' END AS state FROM t FULL JOIN e ON t.cell = e.cell",
    "sealed_epochs": "WITH r AS (SELECT o_custkey AS run, CASE WHEN o_orderkey % 9 = 0 THEN 1073741824 WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 12 END AS k FROM orders WHERE o_orderstatus <> 'P') SELECT run, CASE WHEN max(k) = 1073741824 THEN 'epoch_last' ELSE 'epoch_' || max(k) END AS name FROM r WHERE k IS NOT NULL GROUP BY run",
    "length_scaled": "WITH r AS (SELECT o_orderkey AS pool_id, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS x FROM orders), k AS (SELECT pool_id, (rank() OVER (ORDER BY x) - 1 + (count(*) OVER (PARTITION BY x) - 1) / 2.0) / (count(*) OVER () - 1) AS r FROM r WHERE x IS NOT NULL) SELECT r.pool_id, round(k.r, 6) AS r FROM r LEFT JOIN k ON r.pool_id = k.pool_id",
    "delta_scale": f"WITH m AS (SELECT avg(cf) - avg(tr) AS x FROM ({TOKENS}) GROUP BY pool_id), q AS (SELECT quantile_cont(x, 0.10) AS q, quantile_disc(x, 0.5) FILTER (WHERE x > 0) AS med FROM m) SELECT round(CASE WHEN q > 0 THEN q / {LOGIT4} WHEN med > 0 THEN med / {LOGIT4} ELSE 1.0 END, 6) AS s FROM q",
}
