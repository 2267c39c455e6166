"""Queries of the benchmark evaluators and of what prepares their records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallow.functions import schemas as M
from tallow.functions import text as X
from tallow.plans import evaluators as E
from tallow.queries.gating import rounded
from tallow.queries.inputs import PAIRS, view
from tallow.queries.texts import ANSWERS, B, CLEAN, CUES, LINES, NUM, TOK, choice_sql, explicit_sql, last_sql, preamble_sql, sq, strip_sql

STORIES = "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name || ' ' END AS Body, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE ' How many?' END AS Question, CASE WHEN p_partkey % 4 = 0 THEN p_size + 0.5 ELSE p_size + 0.0 END AS Answer, 'The answer is ' || (p_size + p_partkey % 2) || CASE WHEN p_partkey % 4 = 0 THEN '.5' ELSE '.' END AS response FROM part"
CHOICES = f"SELECT id, answer AS response, p_name AS question, 'c' || (id % 3) AS category, chr(65 + p_size % 10) AS gold, p_size, id % 7 AS k FROM ({ANSWERS})"
SPANS = "SELECT id, 'part ' || p_name || ' no. ' || p_size AS response, p_name AS g1, 'the ' || p_size AS g2, CASE id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE 'th' END AS language, p_size FROM (" + ANSWERS + ")"


def eval_gsm8k(spark, d):
    return rounded(E.evaluate("gsm8k", view(spark, d, f"SELECT id, answer AS response, '#### ' || p_size AS answer FROM ({ANSWERS})")))


def eval_svamp(spark, d):
    rows = view(spark, d, STORIES).withColumn("Answer", F.col("Answer").cast("double"))
    return rounded(E.evaluate("svamp", rows))


def story_questions(spark, d):
    rows = view(spark, d, STORIES).withColumn("Answer", F.col("Answer").cast("double"))
    return rows.select("id", M.story_question(F.col("Body"), F.col("Question")).alias("question"), M.whole_number(F.col("Answer")).alias("gold"))


def eval_mmlu(spark, d):
    rows = view(spark, d, "SELECT label % 4 AS answer, embedding FROM embeddings").select("answer", F.slice("embedding", 1, 4).alias("logits"))
    return rounded(E.evaluate("mmlu", rows))


def _choices(spark, d):
    rows = view(spark, d, CHOICES)
    names = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when(i < 4 + F.col("k"), F.concat(F.lit("option "), i)).when(i == 9, F.lit("N/A")).otherwise(F.lit(" ")))
    return rows.withColumn("options", names).withColumn("answer", F.col("gold"))


def eval_mmlu_pro(spark, d):
    return rounded(E.evaluate("mmlu_pro", _choices(spark, d)))


def options_rendered(spark, d):
    return _choices(spark, d).select("id", M.rendered_options(F.col("options")).alias("shown"), F.size(M.kept_options(F.col("options"))).alias("n"))


def eval_bbh(spark, d):
    return rounded(E.evaluate("bbh", view(spark, d, f"SELECT id % 4 AS task, answer AS response, CASE WHEN id % 2 = 0 THEN '(' || chr(65 + p_size % 10) || ')' ELSE p_size || '' END AS target FROM ({ANSWERS})")))


def _qa(spark, d):
    return view(spark, d, SPANS).withColumn("answers", F.array("g1", "g2"))


def eval_tydiqa(spark, d):
    return rounded(E.evaluate("tydiqa", _qa(spark, d)))


def eval_xquad(spark, d):
    return rounded(E.evaluate("xquad", _qa(spark, d).withColumn("response", F.concat(F.lit("The answer is: "), F.col("response"), F.lit("\n\nmore")))))


def eval_mbpp(spark, d):
    return rounded(E.evaluate("mbpp", view(spark, d, "SELECT o_orderkey AS task_id, o_totalprice > 150000 AS passed FROM orders")))


def eval_humaneval(spark, d):
    return rounded(E.evaluate("humaneval", view(spark, d, "SELECT o_custkey AS task_id, o_totalprice > 150000 AS passed FROM orders")))


def few_shot_prompts(spark, d):
    rows = view(spark, d, "SELECT p_partkey AS id, p_brand AS subject, p_name AS question, p_type AS answer FROM part")
    shown, asked = F.concat("question", F.lit(" "), "answer"), F.concat("question", F.lit(":"))
    return E.few_shot(rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1"), ["subject"], 3, "id", shown, asked).select("id", F.md5("prompt").alias("h"), "shots_found")


def crosslingual_demos(spark, d):
    examples = view(spark, d, "SELECT doc_id AS id, lang AS language FROM documents WHERE doc_id IS NOT NULL AND lang IS NOT NULL")
    demos, tests = E.crosslingual_split(examples, 5)
    return demos.select("id", "language", F.lit("demo").alias("part")).unionAll(tests.select("id", "language", F.lit("test")))


def subject_titles(spark, d):
    return view(spark, d, "SELECT p_partkey AS id, lower(replace(p_type, ' ', '_')) AS subject FROM part").select("id", M.subject_title(F.col("subject")).alias("title"))


RUN_NAMES = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'latest' ELSE '2024' || lpad(CAST(1 + o_orderkey % 12 AS VARCHAR(2)), 2, '0') || '07_0102' || lpad(CAST(o_orderkey % 60 AS VARCHAR(2)), 2, '0') END AS tag, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey % 5 END AS configured, '/r/seed3/m/seed_' || (o_custkey % 7) || CASE WHEN o_orderkey % 5 = 0 THEN '/x' ELSE '' END AS path FROM orders"


def run_tags(spark, d):
    rows = view(spark, d, RUN_NAMES)
    return rows.select("id", M.is_run_tag(F.col("tag")).alias("valid"), F.month(M.run_time(F.col("tag"))).alias("month"), M.recovered_seed(F.col("configured").cast("int"), F.col("path")).alias("seed"))


def rating_prompts(spark, d):
    p = view(spark, d, PAIRS)
    return p.select("pool_id", F.md5(F.concat(M.cycled(["Rate: ", "Score it: ", "How good? "], F.col("pool_id")), F.col("instruction"))).alias("h"), M.filler_text(F.lit(5) + F.col("pool_id").cast("int") % 4, ["so", "it", "goes"]).alias("filler"))


CODES = "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '```python' || chr(10) || 'def f(x):' || chr(10) || '    return ' || p_size || chr(10) || '```' || chr(10) || p_name WHEN 1 THEN 'Sure, here it is' || chr(10) || 'x = ' || p_size || chr(10) || '[DONE] more' WHEN 2 THEN 'def f(x):' || chr(10) || '    return x' || chr(10) || 'print(' || p_size || ')' ELSE p_name END AS response FROM part"


def code_extract(spark, d):
    return view(spark, d, CODES).select("id", E.code_of(F.col("response")).alias("code"))


QUERIES = {
    f.__name__: f
    for f in (
        eval_gsm8k, eval_svamp, story_questions, eval_mmlu, eval_mmlu_pro, options_rendered, eval_bbh, eval_tydiqa, eval_xquad, eval_mbpp, eval_humaneval, few_shot_prompts, crosslingual_demos,
        subject_titles, run_tags, rating_prompts, code_extract,
    )
}

NL = "chr(10)"
STOPPED = "split_part(split_part(split_part(response, chr(10) || 'Question:', 1), chr(10) || chr(10) || 'Question:', 1), chr(10) || 'Q:', 1)"
PRED = CLEAN.replace("(answer,", "(r,")
MICRO = "SELECT round(100 * avg(score), 6) AS accuracy, round(100 * avg(score), 6) AS micro, count(*) AS n FROM g"


def macro_sql(group: str) -> str:
    return f"SELECT round(100 * avg(a), 6) AS accuracy, round(100 * sum(s) / sum(m), 6) AS micro, cast(sum(m) AS BIGINT) AS n FROM (SELECT {group}, avg(score) AS a, sum(score) AS s, count(*) AS m FROM g GROUP BY ALL)"


def same_sql(a: str, b: str) -> str:
    return f"CASE WHEN coalesce({a} = {b} OR abs(try_cast({a} AS DOUBLE) - try_cast({b} AS DOUBLE)) < 1e-6, false) THEN 1.0 ELSE 0.0 END"


def f1_sql(a: str, b: str) -> str:
    common = f"coalesce(list_sum(list_transform(list_distinct({a}), lambda w: least(len(list_filter({a}, lambda y: y = w)), len(list_filter({b}, lambda y: y = w))))), 0)"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN CASE WHEN len({a}) = len({b}) THEN 1.0 ELSE 0.0 END ELSE 2.0 * {common} / (len({a}) + len({b})) END"


def unicode_tokens_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array(regexp_replace(lower({x}), {sq(chr(92) + 'p{P}')}, ' ', 'g'), {sq(B + '+')}), lambda w: w NOT IN ('', 'a', 'an', 'the'))"


def plain_sql(x: str) -> str:
    return strip_sql(f"regexp_replace(regexp_replace({strip_sql(f'lower({x})')}, {sq('[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_' + chr(92) + 's()]')}, ' ', 'g'), {sq(chr(92) + 's+')}, ' ', 'g')")


SVAMP = f"{STORIES}"
FOUND = f"coalesce({', '.join(explicit_sql('r', c) for c in CUES)}, {', '.join(f'regexp_extract_all(line, {sq(p)}, 1)[1]' for p in X.LABELS)}, {last_sql('bare', '(-?[0-9]+(?:[.][0-9]+)?)')}, bare)"
LINE = strip_sql("coalesce(" + LINES.format(x="r") + "[-1], '')")
BARE = strip_sql(f"regexp_replace(line, {sq('[.]+$')}, '')")
FIRST = strip_sql(f"split_part({strip_sql('response')}, {NL}, 1)")

ORACLE_SQL = {
    "eval_gsm8k": f"WITH a AS (SELECT id, answer AS response, p_size FROM ({ANSWERS})), p AS (SELECT p_size, {STOPPED} AS r FROM a), c AS (SELECT {PRED} AS x, cast(p_size AS VARCHAR) AS y FROM p), g AS (SELECT {same_sql('x', 'y')} AS score FROM c) {MICRO}",
    "eval_svamp": f"WITH p AS (SELECT response AS r, CASE WHEN Answer = floor(Answer) THEN cast(cast(Answer AS BIGINT) AS VARCHAR) ELSE cast(cast(Answer AS DOUBLE) AS VARCHAR) END AS y FROM ({STORIES})), c AS (SELECT {PRED} AS x, y FROM p), g AS (SELECT {same_sql('x', 'y')} AS score FROM c) {MICRO}",
    "story_questions": f"SELECT id, coalesce(concat_ws(' ', nullif({strip_sql('coalesce(Body, ' + chr(39) * 2 + ')')}, ''), nullif({strip_sql('coalesce(Question, ' + chr(39) * 2 + ')')}, '')), '') AS question, CASE WHEN Answer = floor(Answer) THEN cast(cast(Answer AS BIGINT) AS VARCHAR) ELSE cast(cast(Answer AS DOUBLE) AS VARCHAR) END AS gold FROM ({STORIES})",
    "eval_mmlu": f"WITH g AS (SELECT CASE WHEN list_position(embedding[1:4], list_max(embedding[1:4])) - 1 = label % 4 THEN 1.0 ELSE 0.0 END AS score FROM embeddings) {MICRO}",
    "eval_mmlu_pro": f"WITH a AS (SELECT *, split_part(response, {NL} || 'Question:', 1) AS r0, CASE WHEN k >= 6 THEN 10 ELSE 4 + k END AS n FROM ({CHOICES})), q AS (SELECT *, split_part(r0, {NL} || 'Q:', 1) AS r FROM a), g AS (SELECT category, CASE WHEN coalesce({choice_sql('r', 'n')} = gold, false) THEN 1.0 ELSE 0.0 END AS score FROM q) {macro_sql('category')}",
    "options_rendered": f"SELECT id, array_to_string(list_transform(range(CASE WHEN k >= 6 THEN 10 ELSE 4 + k END), lambda i: chr(cast(65 + i AS INT)) || ') option ' || i), {NL}) AS shown, cast(CASE WHEN k >= 6 THEN 10 ELSE 4 + k END AS INT) AS n FROM ({CHOICES})",
    "eval_bbh": f"WITH a AS (SELECT id % 4 AS task, split_part(answer, {NL} || {NL} || 'Q:', 1) AS r, CASE WHEN id % 2 = 0 THEN '(' || chr(cast(65 + p_size % 10 AS INT)) || ')' ELSE p_size || '' END AS target FROM ({ANSWERS})), l AS (SELECT *, {LINE} AS line FROM a), b AS (SELECT *, {BARE} AS bare FROM l), f AS (SELECT task, target, {FOUND} AS found FROM b), g AS (SELECT task, CASE WHEN {plain_sql('found')} = {plain_sql('target')} THEN 1.0 ELSE 0.0 END AS score FROM f) {macro_sql('task')}",
    "eval_tydiqa": f"WITH a AS (SELECT id, {FIRST} AS said, g1, g2 FROM ({SPANS})), t AS (SELECT {TOK.format(x='said')} AS a, {TOK.format(x='g1')} AS b, {TOK.format(x='g2')} AS c FROM a), g AS (SELECT greatest({f1_sql('a', 'b')}, {f1_sql('a', 'c')}) AS score FROM t) {MICRO}",
    "eval_xquad": f"WITH r AS (SELECT 'The answer is: ' || response AS response, g1, g2, language FROM ({SPANS})), a AS (SELECT language, {preamble_sql(FIRST)} AS said, g1, g2 FROM r), t AS (SELECT language, {unicode_tokens_sql('said')} AS a, {unicode_tokens_sql('g1')} AS b, {unicode_tokens_sql('g2')} AS c FROM a), g AS (SELECT language, greatest({f1_sql('a', 'b')}, {f1_sql('a', 'c')}) AS score FROM t) {macro_sql('language')}",
    "eval_mbpp": f"WITH g AS (SELECT CASE WHEN o_totalprice > 150000 THEN 1.0 ELSE 0.0 END AS score FROM orders) {MICRO}",
    "eval_humaneval": f"WITH t AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 150000) AS c FROM orders GROUP BY 1), g AS (SELECT CASE WHEN c = 0 THEN 0.0::DOUBLE WHEN n - c < 10 THEN 1.0::DOUBLE ELSE 1 - list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1 - 10.0::DOUBLE / i)) END AS score FROM t) {MICRO}",
    "few_shot_prompts": "WITH d AS (SELECT p_brand, p_partkey, p_name || ' ' || p_type AS shown, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part WHERE p_partkey % 2 = 1), j AS (SELECT p_brand, string_agg(shown, chr(10) || chr(10) ORDER BY r) AS demos FROM d WHERE r <= 3 GROUP BY p_brand) SELECT p_partkey AS id, md5(concat_ws(chr(10) || chr(10), demos, p_name || ':')) AS h, demos IS NOT NULL AS shots_found FROM part LEFT JOIN j USING (p_brand) WHERE p_partkey % 2 = 0",
    "crosslingual_demos": "WITH e AS (SELECT doc_id AS id, lang AS language, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents WHERE doc_id IS NOT NULL AND lang IS NOT NULL) SELECT id, language, CASE WHEN language = 'en' AND r <= 5 THEN 'demo' ELSE 'test' END AS part FROM e",
    "subject_titles": "SELECT p_partkey AS id, array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') AS title FROM part",
    "run_tags": f"SELECT id, regexp_matches(tag, '^[0-9]{{8}}_[0-9]{{6}}$') AS valid, CASE WHEN tag <> 'latest' THEN cast(substr(tag, 5, 2) AS INT) END AS month, cast(coalesce(configured, cast(regexp_extract_all(path, 'seed_?([0-9]+)', 1)[-1] AS INT)) AS INT) AS seed FROM ({RUN_NAMES})",
    "rating_prompts": f"WITH p AS ({PAIRS}) SELECT pool_id, md5((['Rate: ', 'Score it: ', 'How good? '])[pool_id % 3 + 1] || instruction) AS h, array_to_string(list_transform(range(5 + pool_id % 4), lambda k: (['so', 'it', 'goes'])[k % 3 + 1]), ' ') || '.' AS filler FROM p",
    "code_extract": f"SELECT id, CASE id % 4 WHEN 0 THEN 'def f(x):' || {NL} || '    return ' || p_size WHEN 1 THEN 'x = ' || p_size WHEN 2 THEN 'def f(x):' || {NL} || '    return x' ELSE p_name END AS code FROM (SELECT p_partkey AS id, p_size, p_name FROM part)",
}
