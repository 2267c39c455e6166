"""Queries of text, grading, corruption, dedup and vectors."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallow.functions import text as X
from tallow.functions.hashing import uniform
from tallow.operators import corruption as C
from tallow.operators import dedup as N
from tallow.operators import vectors as V
from tallow.queries.gating import rounded
from tallow.queries.inputs import PAIRS, table, view

B = r"[ \t\n\r\f\x0b]"
DOCS = "SELECT doc_id, text, lang, source, n_chars FROM documents"


def sq(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def words_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {sq(B + '+')}), lambda w: w <> '')"


def norm_sql(x: str) -> str:
    return f"regexp_replace(lower(regexp_replace({x}, {sq(f'^{B}+|{B}+$')}, '', 'g')), {sq(B + '+')}, ' ', 'g')"


def word_counts(spark, d):
    return view(spark, d, DOCS).select("doc_id", X.word_count(F.col("text")).alias("words"), X.has_number(F.col("text")).alias("numeric"))


def dedup_normalise(spark, d):
    return view(spark, d, DOCS).select("doc_id", F.md5(X.normalised(F.col("text"))).alias("h"))


def text_complete(spark, d):
    return view(spark, d, "SELECT conv_id, turn, text FROM conversations").select("conv_id", "turn", X.is_complete(F.col("text")).alias("complete"))


def structured_lines(spark, d):
    lines = view(spark, d, DOCS).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(X.is_structured_line(F.col("line"))).alias("structured"))


def word_count_buckets(spark, d):
    return C.length_bucket(view(spark, d, DOCS), "n_chars", 8, "doc_id").select("doc_id", "bucket")


def conv_pairs(spark, d):
    return view(spark, d, PAIRS)


def alpaca_prompt(spark, d):
    p = view(spark, d, PAIRS)
    given = F.when(F.col("pool_id") % 2 == 0, F.left("output", F.lit(20))).otherwise(F.lit(" "))
    return p.select("pool_id", F.md5(X.alpaca_prompt(F.col("instruction"), given)).alias("h"))


def prompt_styles(spark, d):
    p = view(spark, d, PAIRS)
    given = F.when(F.col("pool_id") % 2 == 0, F.left("output", F.lit(20))).otherwise(F.lit(" "))
    return p.select("pool_id", *[F.md5(X.prompt(style, F.col("instruction"), given)).alias(style) for style in X.CHAT_STYLES])


ANSWERS = """SELECT p_partkey AS id, CASE p_partkey % 12 WHEN 0 THEN p_name || ' The answer is ' || p_size || '.' WHEN 1 THEN 'We get 12 #### $' || p_size || ',000' WHEN 2 THEN p_name || ' ' || p_size || ' or ' || (p_size + 1)
  WHEN 3 THEN 'Answer: so the answer is (' || chr(65 + p_size % 10) || ')' WHEN 4 THEN 'Sure, (B) or (' || chr(65 + p_size % 10) || ') it is' WHEN 5 THEN p_name
  WHEN 6 THEN 'According to the text, it is the answer would be: ' || p_name WHEN 7 THEN 'The answer is true. However, 3 of ' || p_size || chr(10) || 'no'
  WHEN 8 THEN 'Therefore ' || chr(97 + p_size % 10) || chr(10) || 'Question: the answer is (A)' WHEN 9 THEN 'Yes if (C).' || chr(10) || p_size || ' so No.' || chr(10)
  WHEN 10 THEN 'Based on the passage here, the answer is $-' || p_size || '.50, the answer is ' || p_size || '.25.' ELSE p_name || chr(10) || ' answer = ' || p_size || ' or B. C' END AS answer, p_size, p_name FROM part"""


def _answers(spark, d):
    return view(spark, d, ANSWERS)


def number_extract_grade(spark, d):
    n = X.predicted_number(F.col("answer"))
    return _answers(spark, d).select("id", n.alias("number"), X.normalised_number(n).alias("clean"), X.same_number(n, F.col("p_size").cast("string")).alias("correct"))


def choice_letter_extract(spark, d):
    return _answers(spark, d).select("id", X.choice_letter(F.col("answer"), 4 + F.col("id") % 7).alias("letter"))


def task_answer_extract(spark, d):
    return _answers(spark, d).select("id", X.task_answer(F.col("answer")).alias("found"), X.task_normalised(F.col("answer")).alias("plain"))


def preamble_strip(spark, d):
    return _answers(spark, d).select("id", X.strip_preamble(F.col("answer")).alias("rest"), X.cut_at(F.col("answer"), " or ", "####").alias("cut"))


def squad_em_f1(spark, d):
    """Token-bag F1 and exact match of each assistant turn with its user turn."""
    p = view(spark, d, PAIRS).select("pool_id", X.answer_tokens(F.col("output")).alias("a"), X.answer_tokens(F.col("instruction")).alias("b"))
    a = p.select("pool_id", F.explode("a").alias("w")).groupBy("pool_id", "w").agg(F.count("*").alias("na"))
    b = p.select("pool_id", F.explode("b").alias("w")).groupBy("pool_id", "w").agg(F.count("*").alias("nb"))
    common = a.join(b, ["pool_id", "w"]).groupBy("pool_id").agg(F.sum(F.least("na", "nb")).alias("n"))
    rows = p.join(common, "pool_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    f1 = F.when((F.size("a") == 0) | (F.size("b") == 0), (F.size("a") == F.size("b")).cast("double")).otherwise(2 * F.col("n") / (F.size("a") + F.size("b")))
    return rounded(rows.select("pool_id", (F.array_join("a", " ") == F.array_join("b", " ")).alias("em"), f1.alias("f1")))


def argmax_choice(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 4).alias("x"))
    return e.select("vec_id", (F.array_position("x", F.array_max("x")) - 1).alias("choice"))


def display_clip(spark, d):
    return view(spark, d, DOCS).select("doc_id", X.clip(F.col("text"), 40).alias("shown"))


def benchmark_match(spark, d):
    """Benchmark items against documents by normalised text: the first document wins."""
    b = view(spark, d, "SELECT item_id, text FROM benchmark").select("item_id", X.normalised(F.col("text")).alias("k"))
    first = view(spark, d, DOCS).select("doc_id", X.normalised(F.col("text")).alias("k")).groupBy("k").agg(F.min("doc_id").alias("doc_id"))
    return b.join(first, "k", "left").select("item_id", "doc_id")


def length_bucket_derangement(spark, d):
    p = view(spark, d, PAIRS).withColumn("len", X.word_count(F.col("output")))
    return C.derange(C.length_bucket(p, "len", 4), "bucket", 42).select("pool_id", "bucket", "partner_id")


def counterfactual_pool(spark, d):
    c = C.counterfactual(view(spark, d, PAIRS), 2, 7)
    return c.select("pool_id", "k", "partner_id", F.md5("instruction").alias("h"))


FR = {"wrong_answer": 0.1, "mismatch": 0.1, "noisy": 0.1, "truncated": 0.15}


def corrupt_assign(spark, d):
    return C.assign(view(spark, d, PAIRS), FR, 42).select("pool_id", "type")


def truncate_text(spark, d):
    share = 0.3 + 0.4 * uniform(42, "cut", F.col("doc_id"))
    return view(spark, d, DOCS).select("doc_id", F.md5(X.truncated(F.col("text"), share)).alias("h"))


def perturb_last_number(spark, d):
    return _answers(spark, d).select("id", X.perturbed_number(F.col("answer"), 0.1 + 0.4 * uniform(42, "share", F.col("id")), uniform(42, "up", F.col("id")) < 0.5).alias("changed"))


def corrupted_pool(spark, d):
    shown = F.when(F.col("type") != "noisy", F.md5("output"))
    return C.corrupt(view(spark, d, PAIRS), FR, 42).select("pool_id", "type", "partner_id", shown.alias("h"))


def duplicated_pool(spark, d):
    return C.append_duplicates(view(spark, d, PAIRS), 0.1, 42).select("pool_id", "cluster_id", F.md5("instruction").alias("h"))


def oracle_pool(spark, d):
    m = view(spark, d, "SELECT doc_id AS pool_id FROM labels WHERE quality = 0")
    return C.oracle_pool(view(spark, d, "SELECT doc_id AS pool_id FROM documents"), m)


def shingle_counts(spark, d):
    return N.shingle_sets(view(spark, d, DOCS), "doc_id", "text").select("doc_id", F.size("set").alias("n"))


def neardup_clusters(spark, d):
    return N.clusters(view(spark, d, DOCS), "doc_id", "text")


def _centred(spark, d):
    return V.as_arrays(V.mean_vectors(table(spark, d, "embeddings"), "label", "embedding"), "label")


def vector_mean(spark, d):
    return rounded(V.mean_vectors(table(spark, d, "embeddings"), "label", "embedding"))


def align_mean_layers(spark, d):
    return rounded(V.alignment(table(spark, d, "embeddings"), _centred(spark, d).drop("label"), "vec_id", "embedding"))


def align_sum_layers(spark, d):
    return rounded(V.alignment(table(spark, d, "embeddings"), _centred(spark, d).drop("label"), "vec_id", "embedding", total=True))


def delta_norm(spark, d):
    e = table(spark, d, "embeddings").select("label", "vec_id", "embedding")
    before = F.lag("embedding").over(Window.partitionBy("label").orderBy("vec_id"))
    return rounded(e.withColumn("b", before).filter("b IS NOT NULL").select("vec_id", V.norm(V.difference(F.col("embedding"), F.col("b"))).alias("norm")))


def pca_top1(spark, d):
    return rounded(V.principal(table(spark, d, "embeddings"), "label", "embedding").select("label", "lambda1", "lambda2"))


def seeded_uniform(spark, d):
    return rounded(view(spark, d, DOCS).select("doc_id", uniform(42, "u", F.col("doc_id")).alias("u")))


def first_n_per_group(spark, d):
    r = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return view(spark, d, DOCS).withColumn("r", r).filter("r <= 3").select("source", "doc_id", "r")


PAIR = f"pairs AS ({PAIRS})"
def last_sql(x: str, p: str) -> str:
    return f"regexp_extract_all({x}, {sq(p)}, 1)[-1]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, {sq(f'^{B}+|{B}+$')}, '', 'g')"


NUM = f"coalesce({strip_sql(last_sql('answer', '(?i)the answer is[ ' + chr(92) + 't' + chr(92) + 'n]*([0-9.,$-]+)'))}, {strip_sql(last_sql('answer', '####' + chr(92) + 's*([^' + chr(92) + 'n]+)'))}, {last_sql('answer', '(-?[0-9]+[.]?[0-9]*)')}, '')"
CLEAN = strip_sql(f"regexp_replace(translate({NUM}, ', $%', ''), {sq('[.]+$')}, '')")
U = "('0x' || substr(md5({}), 1, 15))::BIGINT / 1152921504606846976.0"
TOK = "list_filter(regexp_split_to_array(regexp_replace(lower({x}), '[!-/:-@\\[-`{{-~]', '', 'g'), " + sq(B + "+") + "), lambda w: w NOT IN ('', 'a', 'an', 'the'))"
LEN = f"{PAIR}, sized AS (SELECT pool_id, least(floor((row_number() OVER (ORDER BY len({words_sql('output')}), pool_id) - 1) * 4 / count(*) OVER ()), 3)::INT AS bucket FROM pairs)"


def turned(seed: int) -> str:
    o = f"PARTITION BY bucket ORDER BY md5('{seed}:derange:' || pool_id), pool_id"
    return f"SELECT pool_id, bucket, coalesce(lead(pool_id) OVER ({o}), first_value(pool_id) OVER ({o})) AS partner_id FROM sized"


QUERIES = {
    f.__name__: f
    for f in (
        word_counts, dedup_normalise, text_complete, structured_lines, word_count_buckets, conv_pairs, alpaca_prompt, prompt_styles, number_extract_grade, choice_letter_extract, task_answer_extract,
        preamble_strip, squad_em_f1, argmax_choice, display_clip, benchmark_match, length_bucket_derangement, counterfactual_pool, corrupt_assign, truncate_text, perturb_last_number, corrupted_pool,
        duplicated_pool, oracle_pool, shingle_counts, neardup_clusters, vector_mean, align_mean_layers, align_sum_layers, delta_norm, pca_top1, seeded_uniform, first_n_per_group,
    )
}

ENDINGS = ", ".join(f"'{w}'" for w in X.DANGLING)


def structured_sql(x: str) -> str:
    tests = (r"^\|.*\|$", r"^[-*+•–—] ", r"^(?:[0-9]+|\p{L}{1,4})[.)] ", r"^[^:]{1,40}:.")
    return "(" + " OR ".join(f"regexp_matches({strip_sql(x)}, {sq(t)})" for t in tests) + ")"


WRAP = X.WRAPPERS
LINES = "list_filter(regexp_split_to_array({x}, " + sq(r"\r\n|[\n\r\f\x0b]") + "), lambda y: " + strip_sql("y") + " <> '')"
COMPLETE = f"""CASE WHEN t = '' THEN false WHEN ((length(t) - length(replace(t, '```', ''))) // 3) % 2 = 1 THEN false WHEN ends_with(t, '```') THEN true
  WHEN len({LINES.format(x='t')}) > 1 AND {structured_sql(LINES.format(x='t') + '[-1]')} THEN true WHEN regexp_replace(t, {sq(f'[{WRAP}]+$')}, '') = '' THEN false
  WHEN regexp_matches(regexp_replace(t, {sq(f'[{WRAP}]+$')}, ''), {sq(f'[{X.ENDS}0-9]$')}) THEN true WHEN len(w) > 3 THEN false
  ELSE lower(regexp_replace(coalesce(w[-1], ''), {sq(f'^[{WRAP},;:]+|[{WRAP},;:]+$')}, '', 'g')) NOT IN ({ENDINGS}) END"""
NUMERIC = r"(?s)^(.*?)(-?[0-9]+(?:\.[0-9]+)?)([^0-9]*)$"
ASSIGN = f"""{PAIR}, n AS (SELECT *, md5('42:assign:' || pool_id) AS draw, regexp_matches(output, '-?[0-9]+') AS num, count(*) OVER () AS n FROM pairs),
w AS (SELECT *, num AND row_number() OVER (PARTITION BY num ORDER BY draw, pool_id) <= least(round_even(n * 0.1, 0), sum(CASE WHEN num THEN 1 ELSE 0 END) OVER ()) AS wrong FROM n),
p AS (SELECT *, row_number() OVER (PARTITION BY wrong ORDER BY draw, pool_id) AS place FROM w)"""

def preamble_sql(x: str) -> str:
    for _ in range(3):
        for pattern in X.PREAMBLES:
            x = f"regexp_replace({x}, {sq('(?i)' + pattern)}, '')"
    return strip_sql(x)


def explicit_sql(x: str, cue: str) -> str:
    found = strip_sql(f"regexp_extract({x}, {sq(cue)}, 1)")
    return f"CASE WHEN regexp_matches({x}, {sq(cue)}) THEN coalesce({', '.join(last_sql(found, p) for p in X.LABELS)}, {found}) END"


def choice_sql(x: str, n: str) -> str:
    cues = (r"(?i)answer\s+is\s+\(?([A-J])\)?", r"(?im)^\s*answer\s*[:=]\s*\(?([A-J])\)?", r"(?i)\b(?:therefore|hence|so|thus)[,\s]+\(?([A-J])\)?\b", r"\(([A-J])\)")
    return "coalesce(" + ", ".join(f"CASE WHEN ascii(upper({last_sql(x, c)})) - 65 < {n} THEN upper({last_sql(x, c)}) END" for c in cues) + ")"


CUES = (r"(?i)(?:so\s+)?the\s+answer\s+is[:\s]+([^.\n]+)", r"(?im)^\s*answer\s*[:=]\s*([^.\n]+)")
GIVEN = "CASE WHEN pool_id % 2 = 0 THEN substr(output, 1, 20) ELSE '' END"
_GIVEN = strip_sql(GIVEN)
_USER = f"instruction || CASE WHEN {_GIVEN} <> '' THEN chr(10) || chr(10) || {GIVEN} ELSE '' END"


def lit_sql(text: str) -> str:
    return " || ".join("chr(10)" if part == "\n" else sq(part) for part in re.split("(\n)", text) if part)


STYLED = ", ".join(f"md5({lit_sql(before)} || {_USER} || {lit_sql(after)}) AS {style}" for style, (before, after) in X.CHAT_STYLES.items())
PERTURBED = """CASE WHEN num = '' THEN NULL ELSE head || CASE WHEN moved = num THEN num || '0' ELSE moved END || tail END"""

ORACLE_SQL = {
    "word_counts": f"SELECT doc_id, len({words_sql('text')})::INT AS words, regexp_matches(text, '-?[0-9]+') AS numeric FROM documents",
    "dedup_normalise": f"SELECT doc_id, md5({norm_sql('text')}) AS h FROM documents",
    "word_count_buckets": "SELECT doc_id, least(floor((row_number() OVER (ORDER BY n_chars, doc_id) - 1) * 8 / count(*) OVER ()), 7)::INT AS bucket FROM documents",
    "conv_pairs": PAIRS,
    "alpaca_prompt": f"WITH {PAIR} SELECT pool_id, md5('Below is an instruction that describes a task' || CASE WHEN {_GIVEN} <> '' THEN ', using the input below as context' || chr(10) || chr(10) || '### Input:' || chr(10) || {_GIVEN} ELSE '' END || {lit_sql('. Write a response that appropriately completes the request.' + chr(10) * 2 + '### Instruction:' + chr(10))} || instruction || {lit_sql(chr(10) * 2 + '### Response:' + chr(10))}) AS h FROM pairs",
    "prompt_styles": f"WITH {PAIR} SELECT pool_id, {STYLED} FROM pairs",
    "number_extract_grade": f"WITH a AS ({ANSWERS}), n AS (SELECT id, p_size, {NUM} AS number, {CLEAN} AS clean FROM a) SELECT id, number, clean, coalesce(clean = cast(p_size AS VARCHAR) OR abs(try_cast(clean AS DOUBLE) - p_size) < 1e-6, false) AS correct FROM n",
    "choice_letter_extract": f"WITH a AS (SELECT id, CASE WHEN contains(answer, chr(10) || 'Question:') THEN split_part(answer, chr(10) || 'Question:', 1) ELSE split_part(answer, chr(10) || 'Q:', 1) END AS answer FROM ({ANSWERS})) SELECT id, {choice_sql('answer', '4 + id % 7')} AS letter FROM a",
    "squad_em_f1": f"WITH {PAIR}, t AS (SELECT pool_id, {TOK.format(x='output')} AS a, {TOK.format(x='instruction')} AS b FROM pairs), ca AS (SELECT pool_id, w, count(*) AS n FROM (SELECT pool_id, unnest(a) AS w FROM t) GROUP BY ALL), cb AS (SELECT pool_id, w, count(*) AS n FROM (SELECT pool_id, unnest(b) AS w FROM t) GROUP BY ALL), c AS (SELECT ca.pool_id, sum(least(ca.n, cb.n)) AS n FROM ca JOIN cb ON ca.pool_id = cb.pool_id AND ca.w = cb.w GROUP BY ca.pool_id) SELECT t.pool_id, array_to_string(a, ' ') = array_to_string(b, ' ') AS em, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN CASE WHEN len(a) = len(b) THEN 1.0 ELSE 0.0 END ELSE 2 * coalesce(c.n, 0) / (len(a) + len(b)) END, 6) AS f1 FROM t LEFT JOIN c ON t.pool_id = c.pool_id",
    "argmax_choice": "SELECT vec_id, list_position(embedding[1:4], list_max(embedding[1:4])) - 1 AS choice FROM embeddings",
    "display_clip": "SELECT doc_id, CASE WHEN length(text) > 40 THEN substr(text, 1, 40) || '…' ELSE text END AS shown FROM documents",
    "benchmark_match": f"WITH f AS (SELECT {norm_sql('text')} AS k, min(doc_id) AS doc_id FROM documents GROUP BY k) SELECT item_id, f.doc_id FROM benchmark LEFT JOIN f ON {norm_sql('text')} = f.k",
    "length_bucket_derangement": f"WITH {LEN} {turned(42)}",
    "counterfactual_pool": f"WITH {LEN}, one AS ({turned(1007)}), two AS ({turned(2007)}), u AS (SELECT *, 1 AS k FROM one UNION ALL SELECT *, 2 FROM two) SELECT u.pool_id, k, partner_id, md5(instruction) AS h FROM u JOIN pairs ON pairs.pool_id = partner_id",
    "truncate_text": f"WITH t AS (SELECT doc_id, text, {words_sql('text')} AS w, {U.format(chr(39) + '42:cut:' + chr(39) + ' || doc_id')} AS u FROM documents) SELECT doc_id, md5(CASE WHEN len(w) < 3 THEN text ELSE regexp_replace(array_to_string(w[1:greatest(1, floor(len(w) * (0.3 + 0.4 * u)))::BIGINT], ' '), '[.!?;:,]+$', '') END) AS h FROM t",
    "oracle_pool": "SELECT doc_id AS pool_id, cast(row_number() OVER (ORDER BY doc_id) - 1 AS INT) AS new_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)",
    "shingle_counts": f"WITH w AS (SELECT doc_id, {words_sql(norm_sql('text'))} AS w FROM documents) SELECT doc_id, cast(len(list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i+2], ' ')))) AS INT) AS n FROM w",
    "vector_mean": "WITH x AS (SELECT label, unnest(range(64)) AS idx, embedding FROM embeddings) SELECT label, cast(idx AS INT) AS idx, round(avg(cast(embedding[idx + 1] AS DOUBLE)), 6) AS mean FROM x GROUP BY ALL",
    "align_mean_layers": "WITH x AS (SELECT vec_id, label, unnest(range(64)) AS idx, embedding FROM embeddings), f AS (SELECT vec_id, label, idx, cast(embedding[idx + 1] AS DOUBLE) AS v FROM x), m AS (SELECT label, idx, avg(v) AS mean FROM f GROUP BY ALL), g AS (SELECT idx, sum(mean) / count(*) AS mean FROM m GROUP BY idx) SELECT vec_id, round(sum(v * mean), 6) AS align FROM f JOIN g USING (idx) GROUP BY vec_id",
    "align_sum_layers": "WITH x AS (SELECT vec_id, label, unnest(range(64)) AS idx, embedding FROM embeddings), f AS (SELECT vec_id, label, idx, cast(embedding[idx + 1] AS DOUBLE) AS v FROM x), m AS (SELECT label, idx, avg(v) AS mean FROM f GROUP BY ALL), g AS (SELECT idx, sum(mean) AS mean FROM m GROUP BY idx) SELECT vec_id, round(sum(v * mean), 6) AS align FROM f JOIN g USING (idx) GROUP BY vec_id",
    "delta_norm": "WITH l AS (SELECT vec_id, embedding AS a, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings), x AS (SELECT vec_id, unnest(range(64)) AS idx, a, b FROM l WHERE b IS NOT NULL) SELECT vec_id, round(sqrt(sum(power(cast(a[idx + 1] - b[idx + 1] AS DOUBLE), 2))), 6) AS norm FROM x GROUP BY vec_id",
    "seeded_uniform": f"SELECT doc_id, round({U.format(chr(39) + '42:u:' + chr(39) + ' || doc_id')}, 6) AS u FROM documents",
    "first_n_per_group": "SELECT source, doc_id, cast(r AS INT) AS r FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 3",
    "text_complete": f"WITH c AS (SELECT conv_id, turn, text, regexp_replace(text, {sq(B + '+$')}, '') AS t FROM conversations), d AS (SELECT *, {words_sql('t')} AS w FROM c) SELECT conv_id, turn, {COMPLETE} AS complete FROM d",
    "structured_lines": f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE {structured_sql('line')}) AS structured FROM l GROUP BY doc_id",
    "corrupt_assign": f"WITH {ASSIGN} SELECT pool_id, CASE WHEN wrong THEN 'wrong_answer' WHEN place <= round_even(n * 0.1, 0) THEN 'mismatch' WHEN place <= 2 * round_even(n * 0.1, 0) THEN 'noisy' WHEN place <= 2 * round_even(n * 0.1, 0) + round_even(n * 0.15, 0) THEN 'truncated' ELSE 'clean' END AS type FROM p",
    "perturb_last_number": f"WITH a AS (SELECT id, answer, regexp_extract(answer, {sq(NUMERIC)}, 1) AS head, regexp_extract(answer, {sq(NUMERIC)}, 2) AS num, regexp_extract(answer, {sq(NUMERIC)}, 3) AS tail, 0.1::DOUBLE + 0.4::DOUBLE * {U.format(chr(39) + '42:share:' + chr(39) + ' || id')} AS share, CASE WHEN {U.format(chr(39) + '42:up:' + chr(39) + ' || id')} < 0.5 THEN 1 ELSE -1 END AS sign FROM ({ANSWERS})), m AS (SELECT *, CASE WHEN contains(num, '.') THEN printf('%.2f', try_cast(num AS DOUBLE) + sign * greatest(1.0::DOUBLE, abs(try_cast(num AS DOUBLE)) * share)) ELSE cast(try_cast(num AS BIGINT) + sign * greatest(1, floor(abs(try_cast(num AS BIGINT)) * share)::BIGINT) AS VARCHAR) END AS moved FROM a) SELECT id, {PERTURBED} AS changed FROM m",
    "preamble_strip": f"WITH a AS ({ANSWERS}) SELECT id, {preamble_sql('answer')} AS rest, split_part(split_part(answer, ' or ', 1), '####', 1) AS cut FROM a",
    "task_answer_extract": f"WITH a AS ({ANSWERS}), e AS (SELECT id, answer, {strip_sql('coalesce(' + LINES.format(x='answer') + '[-1], ' + chr(39) * 2 + ')')} AS line FROM a), f AS (SELECT *, {strip_sql('regexp_replace(line, ' + sq('[.]+$') + ', ' + chr(39) * 2 + ')')} AS bare FROM e) SELECT id, coalesce({', '.join(explicit_sql('answer', c) for c in CUES)}, {', '.join(f'regexp_extract_all(line, {sq(p)}, 1)[1]' for p in X.LABELS)}, {last_sql('bare', '(-?[0-9]+(?:[.][0-9]+)?)')}, bare) AS found, {strip_sql('regexp_replace(regexp_replace(' + strip_sql('lower(answer)') + ', ' + sq('[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_' + chr(92) + 's()]') + ', ' + sq(' ') + ', ' + sq('g') + '), ' + sq(chr(92) + 's+') + ', ' + sq(' ') + ', ' + sq('g') + ')')} AS plain FROM f",
}

TYPED = ORACLE_SQL["corrupt_assign"].removeprefix("WITH ").replace(" SELECT pool_id, CASE WHEN wrong", ", typed AS (SELECT pool_id, CASE WHEN wrong") + ")"
SHARE = "0.3::DOUBLE + 0.4::DOUBLE * " + U.format("'42:cut:' || pool_id")
MOVED = f"""CASE WHEN contains(num, '.') THEN printf('%.2f', try_cast(num AS DOUBLE) + sign * greatest(1.0::DOUBLE, abs(try_cast(num AS DOUBLE)) * share)) ELSE cast(try_cast(num AS BIGINT) + sign * greatest(1, floor(abs(try_cast(num AS BIGINT)) * share)::BIGINT) AS VARCHAR) END"""
JITTER = """CASE WHEN k < 0.25 THEN ' ' || x WHEN k < 0.5 THEN x || ' ' WHEN k < 0.75 AND x <> '' THEN CASE WHEN x[1:1] = upper(x[1:1]) THEN lower(x[1:1]) ELSE upper(x[1:1]) END || x[2:] ELSE regexp_replace(x, '^([^ ]*) ', '\\1  ') END"""

ORACLE_SQL |= {
    "corrupted_pool": f"""WITH {TYPED}, turn AS (SELECT pool_id, coalesce(lead(pool_id) OVER (ORDER BY md5('42:derange:' || pool_id), pool_id), first_value(pool_id) OVER (ORDER BY md5('42:derange:' || pool_id), pool_id)) AS partner FROM pairs),
      a AS (SELECT t.pool_id, type, partner, x.output, y.output AS donor, {words_sql('x.output')} AS w, regexp_extract(x.output, {sq(NUMERIC)}, 1) AS head, regexp_extract(x.output, {sq(NUMERIC)}, 2) AS num, regexp_extract(x.output, {sq(NUMERIC)}, 3) AS tail FROM typed t JOIN turn USING (pool_id) JOIN pairs x ON x.pool_id = t.pool_id JOIN pairs y ON y.pool_id = partner),
      b AS (SELECT *, {SHARE} AS cut, 0.1::DOUBLE + 0.4::DOUBLE * {U.format("'42:share:' || pool_id")} AS share, CASE WHEN {U.format("'42:up:' || pool_id")} < 0.5 THEN 1 ELSE -1 END AS sign FROM a), m AS (SELECT *, {MOVED} AS moved FROM b)
      SELECT pool_id, type, CASE WHEN type = 'mismatch' THEN partner END AS partner_id, CASE type WHEN 'noisy' THEN NULL WHEN 'wrong_answer' THEN md5({PERTURBED}) WHEN 'mismatch' THEN md5(donor)
        WHEN 'truncated' THEN md5(CASE WHEN len(w) < 3 THEN output ELSE regexp_replace(array_to_string(w[1:greatest(1, floor(len(w) * cut))::BIGINT], ' '), '[.!?;:,]+$', '') END) ELSE md5(output) END AS h FROM m""",
    "duplicated_pool": f"""WITH {PAIR}, o AS (SELECT pool_id, instruction, row_number() OVER (ORDER BY md5('42:dup:' || pool_id), pool_id) AS place FROM pairs), p AS (SELECT * FROM o WHERE place <= greatest(1, floor((SELECT count(*) FROM pairs) * 0.1::DOUBLE))),
      m AS (SELECT *, unnest(range(1, 3 + floor(3 * {U.format("'42:copies:' || pool_id")})::INT)) AS c FROM p), j AS (SELECT place, c, pool_id AS cluster_id, instruction AS x, {U.format("'42:jitter:' || pool_id || ':' || c")} AS u, {U.format("'42:kind:' || pool_id || ':' || c")} AS k FROM m)
      SELECT (SELECT max(pool_id) FROM pairs) + row_number() OVER (ORDER BY place, c) AS pool_id, cluster_id, md5(CASE WHEN u < 0.5 THEN {JITTER} ELSE x END) AS h FROM j
      UNION ALL SELECT pairs.pool_id, p.pool_id, md5(pairs.instruction) FROM pairs LEFT JOIN p ON p.pool_id = pairs.pool_id""",
}
