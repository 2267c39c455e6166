"""Queries of the epoch loop and of the event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallow.plans import epochs
from tallow.queries.gating import rounded
from tallow.queries.inputs import SIGNALS, table, view
from tallow.streaming import events as E


def _signals(spark, d):
    s = view(spark, d, SIGNALS).select("pool_id", "loss", "entropy", "align_raw")
    return s.select(F.lit(1).alias("epoch"), "*").unionByName(s.select(F.lit(2).alias("epoch"), "pool_id", (F.col("loss") * F.when(F.col("pool_id") % 3 == 0, 0.5).otherwise(0.9)).alias("loss"), "entropy", "align_raw"))


def epoch_loop_difficulty(spark, d):
    return epochs.run(_signals(spark, d), "difficulty", 2, 100)


def epoch_loop_static(spark, d):
    return epochs.run(_signals(spark, d), "legacy", 2, 100, static=True)


def event_windows(spark, d):
    return rounded(E.window_counts(table(spark, d, "events")))


def event_sessions(spark, d):
    return E.session_counts(table(spark, d, "events"))


QUERIES = {f.__name__: f for f in (epoch_loop_difficulty, epoch_loop_static, event_windows, event_sessions)}

_X = f"WITH sig AS ({SIGNALS}), one AS (SELECT pool_id, loss FROM sig ORDER BY loss DESC, pool_id LIMIT 100), two AS (SELECT sig.pool_id, sig.loss AS l1, sig.loss * CASE WHEN sig.pool_id % 3 = 0 THEN 0.5::DOUBLE ELSE 0.9::DOUBLE END AS l2, one.pool_id IS NOT NULL AS sel FROM sig LEFT JOIN one ON sig.pool_id = one.pool_id), x AS (SELECT pool_id, sel, CASE WHEN sel THEN greatest(l1 - l2, 0) ELSE l2 END AS x FROM two), r AS (SELECT pool_id, (rank() OVER (PARTITION BY sel ORDER BY x) - 1 + (count(*) OVER (PARTITION BY sel, x) - 1) / 2.0) / (count(*) OVER (PARTITION BY sel) - 1) AS s FROM x)"

ORACLE_SQL = {
    "epoch_loop_difficulty": f"{_X} SELECT 1 AS epoch, pool_id FROM one UNION ALL SELECT 2, pool_id FROM (SELECT pool_id FROM r ORDER BY s DESC, pool_id LIMIT 100)",
    "epoch_loop_static": f"WITH sig AS ({SIGNALS}), w AS (SELECT var_samp(loss) / (var_samp(loss) + var_samp(entropy) + 1e-8) AS w, min(align_raw) AS lo, max(align_raw) AS hi FROM sig), b AS (SELECT pool_id FROM sig, w ORDER BY (w * loss + (1 - w) * entropy) * (1 + 0.5 * (align_raw - lo) / (hi - lo)) DESC, pool_id LIMIT 100) SELECT unnest([1, 2]) AS epoch, pool_id FROM b",
    "event_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL",
    "event_sessions": "WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM s) SELECT min(ts) AS start, user_id, count(*) AS n FROM g GROUP BY user_id, g",
}
