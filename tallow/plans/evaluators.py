"""Benchmark evaluators as plans: extract, grade, average. A registry maps a benchmark to its evaluator.

An evaluator takes a table of predictions (``response`` beside the benchmark's columns) and
gives one row ``accuracy`` with the parts it averages. Generation is no part of it; code tasks
come with a column ``passed``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallow.functions import text as X
from tallow.functions.schemas import choice_rows, kept_options, rendered_options, story_question, whole_number
from tallow.operators.results import IntegrityError, pass_at


@dataclass(frozen=True)
class Evaluator:
    name: str
    shots: int
    grade: Callable[[DataFrame], DataFrame]  # adds ``score`` (and what a report shows)
    group: str | None = None  # macro over this column, else micro


REGISTRY: dict[str, Evaluator] = {}


def register(name: str, shots: int, group: str | None = None):
    def keep(grade: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        REGISTRY[name] = Evaluator(name, shots, grade, group)
        return grade

    return keep


def get(name: str) -> Evaluator:
    if name not in REGISTRY:
        raise KeyError(f"unknown benchmark {name}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]


def evaluate(name: str, predictions: DataFrame) -> DataFrame:
    """One row: accuracy (0 to 100; macro where the benchmark has groups), micro, n."""
    found = get(name)
    graded = found.grade(predictions)
    if not found.group:
        return graded.agg((100 * F.avg("score")).alias("accuracy"), (100 * F.avg("score")).alias("micro"), F.count("*").alias("n"))
    each = graded.groupBy(found.group).agg(F.avg("score").alias("a"), F.sum("score").alias("s"), F.count("*").alias("m"))
    return each.agg((100 * F.avg("a")).alias("accuracy"), (100 * F.sum("s") / F.sum("m")).alias("micro"), F.sum("m").alias("n"))


def by_group(name: str, predictions: DataFrame) -> DataFrame:
    found = get(name)
    return found.grade(predictions).groupBy(found.group).agg((100 * F.avg("score")).alias("accuracy"), F.count("*").alias("n"))


def as_score(correct: Column) -> Column:
    return F.coalesce(correct, F.lit(False)).cast("double")


QUESTION_STOPS = ("\nQuestion:", "\n\nQuestion:", "\nQ:")


@register("gsm8k", 8)
def grade_numbers(rows: DataFrame) -> DataFrame:
    """response against answer, by the numbers they declare."""
    return rows.withColumn("score", as_score(X.same_number(X.predicted_number(X.cut_at(F.col("response"), *QUESTION_STOPS)), X.predicted_number(F.col("answer")))))


@register("svamp", 8)
def grade_stories(rows: DataFrame) -> DataFrame:
    """Body, Question, Answer (a number) and response."""
    rows = rows.withColumn("question", story_question(F.col("Body"), F.col("Question"))).withColumn("answer", whole_number(F.col("Answer")))
    return grade_numbers(rows)


@register("mmlu", 5)
def grade_logits(rows: DataFrame) -> DataFrame:
    """The largest of the choices' logits against answer, 0 to 3."""
    return rows.withColumn("score", as_score(F.array_position("logits", F.array_max("logits")) - 1 == F.col("answer")))


@register("mmlu_pro", 5, "category")
def grade_letters(rows: DataFrame) -> DataFrame:
    """response against the letter answer, among as many letters as options are kept."""
    letter = X.choice_letter(X.cut_at(F.col("response"), "\nQuestion:"), F.size(kept_options(F.col("options"))))
    return rows.withColumn("letter", letter).withColumn("score", as_score(F.col("letter") == F.col("answer")))


@register("bbh", 3, "task")
def grade_tasks(rows: DataFrame) -> DataFrame:
    found = X.task_answer(X.cut_at(F.col("response"), "\n\nQ:"))
    return rows.withColumn("score", as_score(X.task_normalised(found) == X.task_normalised(F.col("target"))))


def bag_f1(a: Column, b: Column) -> Column:
    """Overlap F1 of two token arrays, counted with repeats; 1 where both are empty."""

    def count(words: Column, w: Column) -> Column:
        return F.size(F.filter(words, lambda x: x == w))

    common = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, w: s + F.least(count(a, w), count(b, w)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(2.0 * common / (F.size(a) + F.size(b)))


def best_f1(response: Column, golds: Column, tokens: Callable[[Column], Column]) -> Column:
    """The largest F1 over the gold answers that are not empty; 0 without one."""
    held = F.filter(golds, lambda g: g != "")
    best = F.array_max(F.transform(held, lambda g: bag_f1(tokens(response), tokens(g))))
    return F.coalesce(best, F.lit(0.0))


def any_exact(response: Column, golds: Column, tokens: Callable[[Column], Column]) -> Column:
    return F.exists(golds, lambda g: F.array_join(tokens(g), " ") == F.array_join(tokens(response), " "))


def first_line(x: Column) -> Column:
    return X.strip(F.substring_index(X.strip(x), "\n", 1))


@register("tydiqa", 5)
def grade_spans(rows: DataFrame) -> DataFrame:
    """First line of response against answers: F1 is the score, em beside it."""
    said = first_line(F.col("response"))
    return rows.withColumn("score", best_f1(said, F.col("answers"), X.answer_tokens)).withColumn("em", any_exact(said, F.col("answers"), X.answer_tokens))


@register("xquad", 5, "language")
def grade_crosslingual(rows: DataFrame) -> DataFrame:
    said = X.strip_preamble(first_line(X.cut_at(F.col("response"), "\n\n", "\nQuestion:")))
    return rows.withColumn("score", best_f1(said, F.col("answers"), X.unicode_answer_tokens)).withColumn("em", any_exact(said, F.col("answers"), X.unicode_answer_tokens))


@register("mbpp", 3)
def grade_code(rows: DataFrame) -> DataFrame:
    """passed: whether all asserts of the task held."""
    return rows.withColumn("score", as_score(F.col("passed")))


@register("humaneval", 0)
def grade_samples(rows: DataFrame, k: int = 10) -> DataFrame:
    """A row a task: pass@k of its samples."""
    each = rows.groupBy("task_id").agg(F.count("*").alias("n"), F.count_if("passed").alias("c"))
    return each.withColumn("score", pass_at(F.col("n"), F.col("c"), k))


def demonstrations(demos: DataFrame, by: list[str], n: int, order: str) -> DataFrame:
    """The first n rows of each group."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return demos.withColumn("place", place).filter(F.col("place") <= n)


def few_shot(tests: DataFrame, demos: DataFrame, by: list[str], n: int, order: str, shown: Column, asked: Column, head: str = "") -> DataFrame:
    """``prompt``: the group's demonstrations, then the question; groups without any get the question alone."""
    blocks = demonstrations(demos, by, n, order).withColumn("_shown", shown)
    joined = blocks.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "_shown"))), lambda x: x["_shown"]), "\n\n").alias("_demos"))
    rows = tests.join(joined, by, "left").withColumn("shots_found", F.col("_demos").isNotNull())
    return rows.withColumn("prompt", F.concat_ws("\n\n", F.lit(head) if head else F.lit(None).cast("string"), "_demos", asked)).drop("_demos")


def choice_prompt(rows: DataFrame) -> Column:
    return F.concat(F.lit("Question: "), F.col("question"), F.lit("\nOptions:\n"), rendered_options(F.col("options")), F.lit("\nAnswer:"))


def crosslingual_split(examples: DataFrame, n: int, home: str = "en", order: str = "id") -> tuple[DataFrame, DataFrame]:
    """Demonstrations (the home language's first n) and test rows without them."""
    demos = demonstrations(examples.filter(F.col("language") == home), ["language"], n, order).drop("place")
    return demos, examples.join(demos.select(order, "language"), [order, "language"], "left_anti")


def audit_questions(examples: DataFrame, languages: tuple[str, ...] = ()) -> list[str]:
    """Warnings about a question-answer table; one that cannot be what it should be is an error."""
    row = examples.agg(
        F.count("*").alias("n"), F.count_if(F.coalesce("question", F.lit("")) != "").alias("q"),
        F.count_if(F.size(F.filter("answers", lambda a: a != "")) > 0).alias("a"), F.count_distinct(F.when(F.col("language").isin(*languages), F.col("language"))).alias("known"),
    ).first()
    if not row["n"] or row["q"] < 0.5 * row["n"] or row["a"] < 0.1 * row["n"]:
        raise IntegrityError(f"{row['q']} of {row['n']} rows have a question, {row['a']} an answer")
    found = [(row["q"] < 0.95 * row["n"], "questions are missing"), (row["a"] < 0.5 * row["n"], "answers are missing"), (bool(languages) and row["known"] < min(5, len(languages)), "few known languages")]
    return [what for wrong, what in found if wrong]


def audit_choices(rows: DataFrame, options: int = 4) -> DataFrame:
    """The table, unless a row has another number of choices or an answer beyond them."""
    bad = (F.size("choices") != options) | F.col("answer").isNull() | ~F.col("answer").between(0, options - 1)
    if n := rows.filter(F.coalesce(bad, F.lit(True))).count():
        raise IntegrityError(f"{n} rows do not hold {options} choices and an answer among them")
    return rows


# What may begin a line of a program, what begins a line of chat, and what ends a program.
CODE_STARTS = ("def ", "class ", "from ", "import ", "@", "async ", "#", '"""', "'''", "if ", "while ", "for ", "try", "return ")
CHAT_STARTS = ("sure", "here", "certainly", "of course", "okay", "ok", "the ", "this ", "to ", "below", "i ", "we ", "you ")
CODE_ENDS = (
    r"\n\s*\[DONE\]", r"\n\s*\[BEGIN\]", r"\n\s*You are an expert Python programmer", r"\n\s*Your code should pass", r"\n\s*### Instruction",
    r"\n\s*### Response", r"\nif __name__", r"\nprint\(", r"\nclass ", r"\ndef test_", r"\n\s*```",
)


def code_of(response: Column) -> Column:
    """The program in a response: fences, echoes and chat before it and what follows it cut off."""
    x = F.regexp_replace(response, r"(?i)^\s*```(?:python|py)?\s*\n", "")
    x = F.regexp_replace(x, r"(?i)^\s*\[BEGIN\]\s*\n", "")
    lines = F.split(x, "\n")

    def is_chat(line: Column) -> Column:
        bare = F.lower(F.ltrim(line))
        code = F.lit(False)
        for s in CODE_STARTS:
            code = code | F.ltrim(line).startswith(s)
        chat = bare == ""
        for s in CHAT_STARTS:
            chat = chat | bare.startswith(s)
        return ~code & chat

    # the first line that is not chat begins the program; all chat: the text stays
    first = F.array_position(F.transform(lines, is_chat), F.lit(False)).cast("int")
    x = F.when(first > 0, F.array_join(F.slice(lines, first, F.size(lines)), "\n")).otherwise(x)
    for end in CODE_ENDS:
        x = F.regexp_replace(x, f"(?s){end}.*$", "")
    return F.rtrim(F.regexp_replace(x, r"\s+$", ""))


def completion_of(response: Column, prompt: Column, stops: tuple[str, ...] = ("\nclass ", "\ndef ", "\n#", "\nif ", "\nprint(", "\n```")) -> Column:
    """A completion of ``prompt``: fence and echoed prompt off, cut at the earliest stop."""
    x = F.regexp_replace(response, r"(?i)^\s*```(?:python|py)?\s*\n", "")
    x = F.when(F.startswith(x, prompt), F.substring(x, F.length(prompt) + 1, F.length(x))).otherwise(x)
    places = F.filter(F.array(*[F.locate(s, x) for s in stops]), lambda p: p > 0)
    end = F.coalesce(F.array_min(places) - 1, F.length(x))
    return F.regexp_replace(F.substring(x, F.lit(1), end), r"\s+$", "")


def truncation_rate(rows: DataFrame, finished: str) -> DataFrame:
    """Share of generations that met the length limit before an end."""
    return rows.agg(F.avg((~F.col(finished)).cast("double")).alias("truncated"), F.count("*").alias("n"))


def mmlu_pro_rows(rows: DataFrame) -> DataFrame:
    return choice_rows(rows)
