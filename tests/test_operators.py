"""Literal cases and properties of the operators."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tallow.functions import schemas
from tallow.functions import text as X
from tallow.operators import corruption, dedup, gate, results, scoring, selection, vectors
from tallow.plans import evaluators, schedules


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.select(expression(F.col("x")), "i").orderBy("i").collect()]


def test_gain(spark):
    rows = spark.createDataFrame([(1, 2.0, 10.0), (2, 5.0, 5.0)], "i int, t double, c double")
    assert [round(r[0], 9) for r in rows.orderBy("i").select(gate.gain(F.col("t"), F.col("c"))).collect()] == [0.8, 0.0]


def test_spans(spark):
    tokens = spark.createDataFrame([(1, i, float(i + 1), float(i + 1)) for i in range(6)], "pool_id int, pos int, tr double, cf double")
    assert sorted((r.m, r.span_true, r.span_len) for r in gate.spans(tokens, 4).collect()) == [(0, 10.0, 4), (1, 11.0, 2)]


def test_gate_is_zero_up_to_zero(spark):
    got = column(spark, [-1.0, 0.0, 0.5], lambda x: gate.sigmoid_gate(x, F.lit(0.2)), "double")
    assert got[:2] == [0.0, 0.0] and 0 < got[2] <= 1


def test_pava_never_rises():
    rng = random.Random(3)
    for _ in range(50):
        y, w = [rng.random() for _ in range(8)], [rng.randint(1, 9) for _ in range(8)]
        fit = gate.pava_nonincreasing(y, w)
        assert all(a >= b - 1e-12 for a, b in itertools.pairwise(fit))
        assert abs(sum(a * b for a, b in zip(fit, w)) - sum(a * b for a, b in zip(y, w))) < 1e-9


@pytest.mark.parametrize("values, expected", [([0, 1, 0, 1, 0], [0.25, 0.875, 0.25, 0.875, 0.25]), ([7], [0.5]), ([3, 3, 3], [0.5, 0.5, 0.5])])
def test_rank01(spark, values, expected):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x int")
    assert [r.r for r in scoring.rank01(rows, "x", "r").orderBy("i").collect()] == expected


def test_constrained_top(spark):
    rows = spark.createDataFrame([(i, float(s), c) for i, (s, c) in enumerate(zip([5, 4, 3, 2, 1], [0, 0, 0, -1, -1]))], "pool_id int, s double, c int")
    assert sorted(r.pool_id for r in selection.constrained_top(rows, "s", "c", 3).collect()) == [0, 3, 4]


def test_top_refuses_nan(spark):
    rows = spark.createDataFrame([(1, float("nan"))], "pool_id int, s double")
    with pytest.raises(Exception, match="NaN"):
        selection.top(rows, "s", 1).collect()


def test_completeness(spark):
    texts = ["The answer is 42", "It works.", "```\nx\n```", "and then the", "```\nx", ""]
    assert column(spark, texts, X.is_complete) == [True, True, True, False, False, False]


def test_answers(spark):
    assert column(spark, ["The answer is 7. No, the answer is 1,200.", "#### 5", "3 then 4", "none"], X.predicted_number) == ["1,200.", "5", "4", ""]
    assert column(spark, ["so the answer is (C)", "(A) or (B)", "x"], X.choice_letter) == ["C", "B", None]
    moved = column(spark, ["I have 3 apples and 4 pears.", "1.0", "none"], lambda x: X.perturbed_number(x, F.lit(0.1), F.lit(True)))
    assert moved == ["I have 3 apples and 5 pears.", "2.00", None]
    tasks = ["So the answer is (B) or so. More", "Answer: it is\nfalse", "well\nYes, of 3.", "all of\n12 or 14.", "plum.\n", ""]
    assert column(spark, tasks, X.task_answer) == ["(B)", "it is", "Yes", "14", "plum", ""]
    lines = ["- a", "• x", "iv) text", "1. ", "| a | b |", "Key: value", "Key:", "plain words", "   "]
    assert column(spark, lines, X.is_structured_line) == [True, True, True, False, True, True, False, False, False]
    assert column(spark, ["", "Paris", "and then the", "He said 'done.'", "a b c d", "x\n- item", "完了。"], X.is_complete) == [False, True, False, True, False, True, True]
    assert column(spark, ["The answer is: Based on the text here, it is X ", "sure"], X.strip_preamble) == ["X", "sure"]
    assert column(spark, ["do"], lambda x: X.prompt("mistral_instruct", x, F.lit(" "))) == ["<s>[INST] do [/INST] "]


def test_corruption_is_seeded_and_disjoint(spark):
    pool = spark.createDataFrame([(i, f"do {i}", "", f"word {i} of the text is here and then more " + (f"gives {i}." if i % 3 == 0 else "ends.")) for i in range(60)], "pool_id long, instruction string, input string, output string")
    shares = {"wrong_answer": 0.1, "mismatch": 0.2, "noisy": 0.1, "truncated": 0.1}
    one, two = ({r.pool_id: (r.type, r.output) for r in corruption.corrupt(pool, shares, 5).collect()} for _ in range(2))
    assert one == two
    kinds = [t for t, _ in one.values()]
    assert (kinds.count("wrong_answer"), kinds.count("mismatch"), kinds.count("noisy"), kinds.count("truncated")) == (6, 12, 6, 6)
    turned = corruption.derange(pool.withColumn("b", F.lit(0)), "b", 5).collect()
    assert all(r.pool_id != r.partner_id for r in turned) and len({r.partner_id for r in turned}) == 60
    with pytest.raises(ValueError):
        corruption.assign(pool, {"noisy": 1.2}, 1)


def test_clusters(spark):
    base = "the quick brown fox jumps over the lazy dog near the old river bank today"
    rows = spark.createDataFrame([(0, base), (1, base.upper()), (2, base + " "), (3, "something else entirely is written in this line of text"), (4, "")], "k long, t string")
    assert {r.k: r.cluster_id for r in dedup.clusters(rows, "k", "t").collect()} == {0: 0, 1: 0, 2: 0, 3: -1, 4: -1}


def test_permutation_and_t(spark):
    rows = spark.createDataFrame([("g", 1.0), ("g", 2.0), ("g", 3.0)], "g string, diff double")
    assert results.sign_flip(rows, ["g"]).first().p == 0.25
    assert round(results.t_quantile(0.975, 2), 4) == 4.3027 and round(results.t_quantile(0.975, 10), 4) == 2.2281


def test_integrity(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 1.1)], "k string, v double")
    with pytest.raises(results.IntegrityError):
        results.require_unique(rows, ["k"])
    with pytest.raises(results.IntegrityError):
        results.require_agreement(rows, ["k"], "v")
    with pytest.raises(results.IntegrityError):
        results.require_unit(rows, "v")


def test_noise(spark):
    text = "one two three four five six seven eight nine ten"
    rows = spark.range(200).select("id", corruption.eda(F.lit(text), 3, F.col("id")).alias("e"), corruption.noisy(F.lit(text), 3, F.col("id"), F.lit("A foreign one. Or two!")).alias("n")).collect()
    for r in rows:
        words = r.e.split()
        assert 1 <= len(words) < 10 and set(words) <= set(text.split()) and len(set(words)) == len(words)
        assert len(r.n.split()) >= 2
    assert 30 < sum("foreign" in r.n or "Or two!" in r.n for r in rows) < 90
    assert column(spark, ["x", ""], lambda x: corruption.eda(x, 1, F.lit(1))) == ["x", ""]


def test_replacement_must_exist(spark):
    pool = spark.createDataFrame([(1, "a"), (2, "b")], "pool_id long, output string")
    assert {r.pool_id: r.output for r in corruption.replaced(pool, pool.selectExpr("pool_id", "'new' AS text"), pool.filter("pool_id = 1")).collect()} == {1: "new", 2: "b"}
    with pytest.raises(Exception, match="no replacement"):
        corruption.replaced(pool, pool.selectExpr("pool_id", "'new' AS text").limit(0), pool).collect()


def test_seeds_and_permutations(spark):
    runs = spark.createDataFrame([("a", 1), ("a", 2), ("b", None)], "cell string, seed int")
    assert results.require_distinct_seeds(runs, ["cell"]).count() == 3
    for extra in (("a", 2), ("a", None), ("b", None)):
        with pytest.raises(results.IntegrityError):
            results.require_distinct_seeds(runs.union(spark.createDataFrame([extra], "cell string, seed int")), ["cell"])
    diffs = spark.createDataFrame([("x", float(d)) for d in (1, 2, 3)] + [("y", 1.0 + i) for i in range(15)], "g string, diff double")
    p = {r.g: r.p for r in results.sign_flip(diffs, ["g"]).collect()}
    assert p["x"] == 0.25 and 0 < p["y"] < 0.01


def test_guards(spark):
    rows = spark.createDataFrame([(1, 1.0, 1.0, 1.0), (2, None, 2.0, 1.0)], "pool_id int, s double, f double, g double")
    with pytest.raises(Exception, match="null"):
        selection.gated_key(rows, "s", "f", "g").collect()
    with pytest.raises(Exception, match="infinity"):
        selection.top(rows.selectExpr("pool_id", "double('Infinity') AS s"), "s", 1).collect()
    with pytest.raises(ValueError):
        selection.top(rows, "f", 3, exact=True)
    empty = spark.createDataFrame([], "pool_id long, pos long, tr double, cf double")
    assert gate.gate(empty, gate.GateConfig()).count() == 0


def test_principal_direction(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 5)) @ np.diag([3, 1, 1, 0.5, 0.2]) + 1
    rows = spark.createDataFrame([(i % 2, v.tolist()) for i, v in enumerate(x)], "g int, v array<double>").repartition(4)
    for r in vectors.principal(rows, "g", "v").collect():
        own = x[r.g :: 2]
        values, found = np.linalg.eigh(np.cov(own, rowvar=False, bias=True))
        assert abs(r.lambda1 - values[-1]) < 1e-9 and abs(abs(np.dot(r.direction, found[:, -1])) - 1) < 1e-9 and np.dot(r.direction, own.mean(axis=0)) >= 0
    now = vectors.principal(rows, "g", "v")
    turned = now.withColumn("direction", F.transform("direction", lambda y: -y))
    back = vectors.stability(vectors.signed(now, turned, "g"), turned, "g").first()
    assert back.stability == 0 and back.gap > 0
    assert vectors.stability(now, turned.filter("g = 0"), "g").first().stability is None


def test_evaluators(spark):
    assert set(evaluators.REGISTRY) == {"gsm8k", "svamp", "mmlu", "mmlu_pro", "bbh", "tydiqa", "xquad", "mbpp", "humaneval"}
    rows = spark.createDataFrame([("The answer is 7. No. The answer is 12.", "#### 12"), ("#### 5", "#### 6")], "response string, answer string")
    assert evaluators.evaluate("gsm8k", rows).first().accuracy == 50
    choices = spark.createDataFrame([("q", '["a", "b", "n/a"]', 1, None), ("r", '["a", "b"]', None, "a")], "question string, options string, answer_index int, answer string")
    assert [(r.answer, r.category) for r in schemas.choice_rows(choices).orderBy("question").collect()] == [("B", "other"), ("A", "other")]
    answers = spark.createDataFrame([('["a","b"]',), ('{"text": ["c"]}',), ("plain",)], "x string")
    assert [r[0] for r in answers.select(schemas.answer_texts(answers, "x")).collect()] == [["a", "b"], ["c"], ["plain"]]
    code = spark.createDataFrame([(7, "do", ["assert 1"], "import x")], "task_id int, prompt string, test_list array<string>, test_imports string")
    assert schemas.code_rows(code).first().asDict() == {"task_id": "7", "text": "do", "code": None, "tests": ["assert 1"], "setup": "import x"}
    qa = spark.createDataFrame([("q", ["a"], "en"), (None, ["a"], "en"), ("q", [], "xx")], "question string, answers array<string>, language string")
    assert evaluators.audit_questions(qa, ("en",)) == ["questions are missing"]
    with pytest.raises(results.IntegrityError):
        evaluators.audit_questions(qa.filter("question IS NULL"))
    mmlu = spark.createDataFrame([(["a", "b", "c", "d"], 3), (["a"], 0)], "choices array<string>, answer int")
    assert evaluators.audit_choices(mmlu.limit(1)).count() == 1
    with pytest.raises(results.IntegrityError):
        evaluators.audit_choices(mmlu)


def test_schedules():
    assert schedules.layers("middle_to_last", 5) == [2, 3, 4] and schedules.layers([0, 4], 5) == [0, 4]
    with pytest.raises(ValueError):
        schedules.layers([5], 5)
    assert schedules.preset("composite-20".replace("-", ""))["noisy"] == 0.05 and schedules.preset("grounded30")["mismatch"] == 0.15 and schedules.preset("pertype-noisy-10")["noisy"] == 0.1
    assert schedules.shard_bounds(10, 3) == [(0, 3), (3, 7), (7, 10)]
    with pytest.raises(ValueError):
        schedules.recomputable({"c_trunc": 0.2}, {"c_trunc": 0.3})
    assert schedules.calibration(None, {"scale": 1.0, "tau": 0.5}, {"scale": 2.0}, {"tau": 0.5})[0] == "reference"
    with pytest.raises(ValueError):
        schedules.calibration(None, {"scale": 1.0, "tau": 0.4}, None, {"tau": 0.5})
    with pytest.raises(ValueError):
        schedules.require_base_gate(2, "epoch_1")


def test_places_are_those_of_one_sort(spark, monkeypatch):
    import numpy as np

    from tallow.operators import ranks

    monkeypatch.setattr(ranks, "SMALL", 10)
    rng = random.Random(4)
    values = [float(rng.randrange(40)) for _ in range(3000)]
    rows = spark.createDataFrame(list(enumerate(values)), "i long, x double").repartition(5)
    got = [(r.i, r.at, r.s) for r in ranks.running(rows, ["x", "i"], {"at": F.lit(1), "s": F.col("x")}).orderBy("at").collect()]
    order = sorted(range(3000), key=lambda i: (values[i], i))
    assert [i for i, _, _ in got] == order and [a for _, a, _ in got] == list(range(1, 3001))
    assert np.allclose([s for _, _, s in got], np.cumsum([values[i] for i in order]))
    found = {r.share: r.value for r in ranks.percentiles(rows, "x", [0.0, 0.1, 0.333, 0.5, 1.0]).collect()}
    assert all(abs(found[q] - np.quantile(values, q)) < 1e-9 for q in found) and len(found) == 5
    assert ranks.percentiles(rows.limit(0), "x", [0.5]).count() == 0
    assert [r.r for r in scoring.rank01(rows, "x", "r").orderBy("i").limit(5).collect()] == pytest.approx([(sum(v < x for v in values) + (values.count(x) - 1) / 2) / 2999 for x in values[:5]])


def test_rank01_evaluates_its_rows_once(spark):
    """A value that another evaluation would give differently still meets its rank."""
    unstable = F.udf(lambda i: i + random.random(), "double").asNondeterministic()
    ranked = scoring.rank01(spark.range(50).select("id", unstable("id").alias("x")), "x", "r")
    assert [round(r.r, 9) for r in ranked.orderBy("id").collect()] == [round(i / 49, 9) for i in range(50)]


def test_curve_and_scale_evaluate_their_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def value(i):
        seen.add(1)
        return float(i)

    rows = spark.range(500).select((F.col("id") % 7 + 1).alias("n_spans"), F.udf(value, "double")("id").alias("delta_raw"))
    curve = gate.null_curve(rows, 0.05, min_count=50).collect()
    assert sum(r.n for r in curve) == 500 and seen.value == 500
    s = gate.scale(rows.select((F.col("delta_raw") - 400).alias("delta_hat")), 0.1, 0.6).first().s
    assert s == pytest.approx(50 / 1.3862943611198906) and seen.value == 1000


def test_percentiles_by_group(spark, monkeypatch):
    """Whatever the bounds of the first rounds hold."""
    import numpy as np

    from tallow.operators import ranks

    rng = random.Random(7)
    values = {g: [rng.choice([rng.gauss(0, 1), 0.5]) for _ in range(n)] for g, n in ((None, 900), (1, 1), (2, 400))}
    rows = spark.createDataFrame([(g, x) for g, xs in values.items() for x in [*xs, None]] + [(3, None)], "g int, x double").repartition(3)
    for margins in ((0.001, 0.02, 1.0), (0.0, 1.0), (1.0,)):
        monkeypatch.setattr(ranks, "MARGINS", margins)
        found = {(r.g, r.share): (r.value, r.lower) for r in ranks.percentiles(rows, "x", [0.05, 0.5, 0.9], ("g",)).collect()}
        assert set(found) == {(g, q) for g in values for q in (0.05, 0.5, 0.9)}
        for (g, q), got in found.items():
            assert got == pytest.approx((np.quantile(values[g], q), np.quantile(values[g], q, method="lower")))


def test_token_shares_hold_every_token(spark, monkeypatch):
    import compare

    from tallow.queries import gating, inputs

    monkeypatch.setattr(inputs, "SMALL", 10)
    shares = inputs.token_shares(spark, compare.SF)
    whole = inputs.view(spark, compare.SF, inputs.TOKENS).select(*shares[0].columns)
    assert len(shares) == 4 and all(x.count() for x in shares)
    assert sorted(map(tuple, whole.collect())) == sorted(tuple(r) for x in shares for r in x.collect())
    plan = gate.components(shares[0], gating.CFG)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
    assert compare.difference(spark, compare.connection(), gating.calibrate_scale, gating.ORACLE_SQL["calibrate_scale"]) == ""


def test_sweep_reads_the_tokens_once(spark, monkeypatch):
    import compare

    from tallow.queries import gating, inputs

    tokens = inputs.token_shares(spark, compare.SF)[0]
    swept = gate.sweep(tokens, (1, 4), (0.5, 2.0))
    assert swept._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    for w in (1, 4):
        for i, tau in enumerate((0.5, 2.0)):
            one = gate.components(tokens, gate.GateConfig(span_tokens=w, tau=tau)).select("pool_id", "delta_raw", "n_valid_spans")
            assert sorted(map(tuple, one.collect())) == sorted(map(tuple, swept.filter(F.col("w") == w).select("pool_id", f"delta_raw_{i}", f"n_valid_spans_{i}").collect()))
    monkeypatch.setattr(inputs, "SMALL", 10)
    assert compare.difference(spark, compare.connection(), gating.gate_config_sweep, gating.ORACLE_SQL["gate_config_sweep"]) == ""


def test_sweep_of_odd_tables(spark, tmp_path):
    """Records without losses count as not positive; an empty table has its six rows."""
    import compare

    from tallow.queries import gating

    lines = spark.read.parquet(f"{compare.SF}/lineitem.parquet").limit(300)
    gone = F.when(F.col("l_orderkey") % 3 != 0, F.col("l_extendedprice"))
    for name, rows in (("nulls", lines.withColumn("l_extendedprice", gone)), ("empty", lines.limit(0))):
        rows.coalesce(1).write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        con = compare.duckdb.connect()
        con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/{name}/lineitem.parquet/*.parquet'")
        assert compare.difference(spark, con, gating.gate_config_sweep, gating.ORACLE_SQL["gate_config_sweep"], f"{tmp_path}/{name}") == ""
