"""Benchmark records of several layouts as one: questions, options, answers, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallow.functions.text import strip

LETTERS = "ABCDEFGHIJ"


def first_column(rows: DataFrame, *names: str, kind: str = "string") -> Column:
    """The first of the given columns that a table has and that is not null; null if it has none."""
    own = {c.lower(): c for c in rows.columns}
    found = [F.col(own[n.lower()]).cast(kind) for n in names if n.lower() in own]
    return F.coalesce(*found) if found else F.lit(None).cast(kind)


def story_question(body: Column, question: Column) -> Column:
    """Body and question with a space between; either alone where the other is blank."""
    body, question = (strip(F.coalesce(x, F.lit(""))) for x in (body, question))
    return F.concat_ws(" ", F.nullif(body, F.lit("")), F.nullif(question, F.lit("")))


def whole_number(answer: Column) -> Column:
    """A number as text, without the fraction where it is whole."""
    return F.when(answer == F.floor(answer), F.floor(answer).cast("bigint").cast("string")).otherwise(answer.cast("string"))


def kept_options(options: Column) -> Column:
    """The options without blank ones and n/a, which pad a list."""
    return F.filter(options, lambda o: o.isNotNull() & (strip(o) != "") & (F.lower(strip(o)) != "n/a"))


def rendered_options(options: Column) -> Column:
    """``A) first`` a line."""
    lines = F.transform(kept_options(options), lambda o, i: F.concat(F.substring(F.lit(LETTERS), i + 1, 1), F.lit(") "), o))
    return F.coalesce(F.array_join(lines, "\n"), F.lit(""))


def choice_rows(rows: DataFrame) -> DataFrame:
    """question, options, answer (a letter), category of tables that name or pack them otherwise."""
    own = {c.lower(): c for c in rows.columns}
    lettered = [F.col(own[f"option_{x}"]).cast("string") for x in LETTERS.lower() if f"option_{x}" in own]
    name = next((own[n] for n in ("options", "choices") if n in own), None)
    if name is None:
        options = F.array(*lettered) if lettered else F.array().cast("array<string>")
    elif dict(rows.dtypes)[name] == "string":
        options = F.from_json(name, "array<string>")
    else:
        options = F.col(name).cast("array<string>")
    index = first_column(rows, "answer_index", "answer_idx", kind="int")
    answer = first_column(rows, "answer", "label", "target")
    number = answer.try_cast("int")
    letter = F.when(strip(answer).rlike("^[A-Ja-j]$"), F.upper(strip(answer)))
    by_place = F.substring(F.lit(LETTERS), F.coalesce(index, number) + 1, 1)
    place = F.array_position(options, answer)
    by_text = F.when(place > 0, F.substring(F.lit(LETTERS), place.cast("int"), 1))
    return rows.select(
        first_column(rows, "question", "input", "query").alias("question"), options.alias("options"),
        F.coalesce(letter, F.nullif(by_place, F.lit("")), by_text).alias("answer"), F.coalesce(first_column(rows, "category", "subject"), F.lit("other")).alias("category"),
    )


def code_rows(rows: DataFrame) -> DataFrame:
    """task_id, text, code, tests, setup of code tasks whose columns have other names or are text or lists."""
    own = {c.lower(): c for c in rows.columns}
    kinds = dict(rows.dtypes)

    def listed(*names: str) -> Column:
        name = next((own[n] for n in names if n in own), None)
        if name is None:
            return F.array().cast("array<string>")
        if kinds[name].startswith("array"):
            return F.coalesce(F.col(name).cast("array<string>"), F.array().cast("array<string>"))
        return F.coalesce(F.from_json(name, "array<string>"), F.filter(F.array(F.col(name).cast("string")), lambda x: strip(x) != ""))

    setup = F.array_join(listed("test_setup_code", "test_imports", "setup"), "\n")
    return rows.select(first_column(rows, "task_id", "id").alias("task_id"), first_column(rows, "text", "prompt", "question").alias("text"), first_column(rows, "code", "canonical_solution", "solution").alias("code"), listed("test_list", "tests", "test").alias("tests"), setup.alias("setup"))


def answer_texts(rows: DataFrame, column: str) -> Column:
    """An answers field as an array of texts: text, list of texts, struct of lists, or list of structs."""
    kind = dict(rows.dtypes)[column]
    x = F.col(column)
    if kind == "string":
        found = F.coalesce(F.from_json(x, "array<string>"), F.from_json(x, "struct<text:array<string>>")["text"], F.array(x))
    elif kind == "array<string>":
        found = x
    elif kind.startswith("array<struct"):
        found = F.transform(x, lambda a: a["text"].cast("string"))
    elif "text:array" in kind:
        found = x["text"].cast("array<string>")
    else:
        found = F.array(x["text"].cast("string"))
    return F.coalesce(F.filter(found, lambda t: t.isNotNull()), F.array().cast("array<string>"))


def subject_title(subject: Column) -> Column:
    return F.initcap(F.translate(subject, "_", " "))


def is_run_tag(name: Column) -> Column:
    return name.rlike(r"^[0-9]{8}_[0-9]{6}$")


def run_time(tag: Column) -> Column:
    return F.when(is_run_tag(tag), F.try_to_timestamp(tag, F.lit("yyyyMMdd_HHmmss")))


def recovered_seed(configured: Column, path: Column) -> Column:
    """The configured seed, else that of the path's deepest ``seed<n>``, else null."""
    return F.coalesce(configured, F.try_element_at(F.regexp_extract_all(path, F.lit(r"seed_?([0-9]+)"), F.lit(1)), F.lit(-1)).cast("int"))


def cycled(templates: list[str], key: Column) -> Column:
    """Template key mod n."""
    return F.element_at(F.array(*map(F.lit, templates)), (F.pmod(key, F.lit(len(templates))) + 1).cast("int"))


def filler_text(words: Column, filler: list[str]) -> Column:
    """``words`` words, from ``filler`` over and over."""
    picked = F.transform(F.sequence(F.lit(0), F.greatest(words, F.lit(1)) - 1), lambda k: F.element_at(F.array(*map(F.lit, filler)), k % len(filler) + 1))
    return F.concat(F.array_join(picked, " "), F.lit("."))
