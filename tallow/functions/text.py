"""Text expressions: completeness, answer extraction and grading, prompts. Columns in, column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[ \t\n\r\f\x0b]"
NUMBER = r"-?[0-9]+(?:\.[0-9]+)?"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, rf"^{BLANK}+|{BLANK}+$", "")


def words(x: Column) -> Column:
    return F.filter(F.split(x, rf"{BLANK}+"), lambda w: w != "")


def word_count(x: Column) -> Column:
    return F.size(words(x))


def has_number(x: Column) -> Column:
    return x.rlike(NUMBER)


def normalised(x: Column) -> Column:
    """Trimmed, lower-cased, white space collapsed."""
    return F.regexp_replace(F.lower(strip(x)), rf"{BLANK}+", " ")


def is_structured_line(x: Column) -> Column:
    """A table row, a bullet, a short numbered item, or a short ``key: value``, with content."""
    s = strip(x)
    return s.rlike(r"^\|.*\|$") | s.rlike(r"^[-*+•–—] ") | s.rlike(r"^(?:[0-9]+|\p{L}{1,4})[.)] ") | s.rlike(r"^[^:]{1,40}:.")


# Function words that a finished sentence does not end with, the characters that may
# close a sentence after its end, and the ends themselves.
DANGLING = tuple(
    """a an the and or but nor for so yet of in on at to from by with without into onto upon about as if then than that
    which who whom whose is are was were be been being am do does did have has had will would shall should can could may
    might must""".split()
)
WRAPPERS = r"\"')\]}*_` \t"
ENDS = ".!?。！？…"
SHORT_WORDS = 3


def is_complete(text: Column) -> Column:
    """Whether a response looks finished: closed fences, a structured last line of several, an end
    or digit last (after wrappers), or at most three words of which the last does not dangle."""
    t = F.regexp_replace(text, rf"{BLANK}+$", "")
    lines = F.filter(F.split(t, r"\r\n|[\n\r\f\x0b]"), lambda x: strip(x) != "")
    bare = F.regexp_replace(t, f"[{WRAPPERS}]+$", "")
    few = words(t)
    ends = F.lower(F.regexp_replace(F.coalesce(F.try_element_at(few, F.lit(-1)), F.lit("")), f"^[{WRAPPERS},;:]+|[{WRAPPERS},;:]+$", ""))
    return (
        F.when(t == "", False)
        .when(F.regexp_count(t, F.lit("```")) % 2 == 1, False)
        .when(t.endswith("```"), True)
        .when((F.size(lines) > 1) & is_structured_line(F.try_element_at(lines, F.lit(-1))), True)
        .when(bare == "", False)
        .when(bare.rlike(rf"[{ENDS}0-9]$"), True)
        .when(F.size(few) > SHORT_WORDS, False)
        .otherwise(~ends.isin(*DANGLING))
    )


def last_match(x: Column, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(F.regexp_extract_all(x, F.lit(pattern), F.lit(group)), F.lit(-1))


def predicted_number(x: Column) -> Column:
    """The last 'the answer is X', else the rest of the line after the last ####, else the last number, else ''."""
    cue = last_match(x, r"(?i)the answer is\s*([\-0-9.,$]+)")
    return F.coalesce(strip(cue), strip(last_match(x, r"####\s*([^\n]+)")), last_match(x, r"(-?[0-9]+\.?[0-9]*)"), F.lit(""))


def normalised_number(x: Column) -> Column:
    return strip(F.regexp_replace(F.translate(x, ", $%", ""), r"\.+$", ""))


def same_number(a: Column, b: Column) -> Column:
    a, b = normalised_number(a), normalised_number(b)
    x, y = a.try_cast("double"), b.try_cast("double")
    return F.coalesce((a == b) | (F.abs(x - y) < 1e-6), F.lit(False))


def choice_letter(x: Column, options: Column | None = None) -> Column:
    """The letter of the last 'answer is (X)', 'Answer: X' or 'so (X)' (the first of these cues that
    names one of the options), else the last parenthesised capital; null if there is none.

    What follows the first sign of another question does not count.
    """
    options = F.lit(10) if options is None else options
    x = F.when(F.contains(x, F.lit("\nQuestion:")), F.substring_index(x, "\nQuestion:", 1)).otherwise(F.substring_index(x, "\nQ:", 1))
    cues = (r"(?i)answer\s+is\s+\(?([A-J])\)?", r"(?im)^\s*answer\s*[:=]\s*\(?([A-J])\)?", r"(?i)\b(?:therefore|hence|so|thus)[,\s]+\(?([A-J])\)?\b", r"\(([A-J])\)")
    found = [F.upper(last_match(x, cue)) for cue in cues]
    return F.coalesce(*[F.when(F.ascii(c) - 65 < options, c) for c in found])


#: Labels of multiple-choice and yes/no answers, in the order in which they are looked for.
LABELS = (r"(\([A-Z]\))", r"(?i)\b(True|False)\b", r"(?i)\b(Yes|No)\b")


def task_answer(x: Column) -> Column:
    """The first explicit answer (its last label, else its text), else the last line's first label, number or text."""
    cues = (r"(?i)(?:so\s+)?the\s+answer\s+is[:\s]+([^.\n]+)", r"(?im)^\s*answer\s*[:=]\s*([^.\n]+)")
    lines = F.filter(F.split(x, r"\r\n|[\n\r\f\x0b]"), lambda y: strip(y) != "")
    line = strip(F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit("")))

    def explicit(cue: str) -> Column:
        found = strip(F.regexp_extract(x, cue, 1))
        return F.when(x.rlike(cue), F.coalesce(*[last_match(found, p) for p in LABELS], found))

    firsts = [F.try_element_at(F.regexp_extract_all(line, F.lit(p), F.lit(1)), F.lit(1)) for p in LABELS]
    bare = strip(F.regexp_replace(line, r"\.+$", ""))
    return F.coalesce(*[explicit(c) for c in cues], *firsts, last_match(bare, f"({NUMBER})"), bare)


def task_normalised(x: Column) -> Column:
    """Lower case, punctuation but parentheses a space, white space collapsed."""
    return strip(F.regexp_replace(F.regexp_replace(strip(F.lower(x)), r"[^\p{L}\p{N}_\s()]", " "), r"\s+", " "))


def cut_at(x: Column, *stops: str) -> Column:
    for stop in stops:
        x = F.substring_index(x, stop, 1)
    return x


def answer_tokens(x: Column) -> Column:
    """Lower case, ASCII punctuation deleted, articles dropped, split."""
    x = F.regexp_replace(F.lower(x), r"[!-/:-@\[-`{-~]", "")
    return F.filter(words(x), lambda w: ~w.isin("a", "an", "the"))


def unicode_answer_tokens(x: Column) -> Column:
    """As ``answer_tokens``, any punctuation becoming a space."""
    return F.filter(words(F.regexp_replace(F.lower(x), r"\p{P}", " ")), lambda w: ~w.isin("a", "an", "the"))


# What a model puts before a short answer.
PREAMBLES = (
    r"^\s*the\s+answer\s+(?:is|would\s+be)\s*[:,]?\s*",
    r"^\s*answer\s*[:=]\s*",
    r"^\s*(?:it|that)\s+is\s*[:,]?\s*",
    r"^\s*based\s+on\s+the\s+(?:passage|context|text)[^,]*,\s*",
    r"^\s*according\s+to\s+the\s+(?:passage|context|text)[^,]*,\s*",
)


def strip_preamble(x: Column) -> Column:
    """Drops what stands before a short answer, three rounds at most."""
    for _ in range(3):
        for pattern in PREAMBLES:
            x = F.regexp_replace(x, f"(?i){pattern}", "")
    return strip(x)


def alpaca_prompt(instruction: Column, given: Column) -> Column:
    given = strip(F.coalesce(given, F.lit("")))
    part = F.when(given != "", F.concat(F.lit(", using the input below as context\n\n### Input:\n"), given)).otherwise(F.lit(""))
    return F.concat(
        F.lit("Below is an instruction that describes a task"), part,
        F.lit(". Write a response that appropriately completes the request.\n\n### Instruction:\n"), instruction, F.lit("\n\n### Response:\n"),
    )


#: What stands before and after the user's text, by prompt style.
CHAT_STYLES = {
    "qwen_chatml": ("<|im_start|>user\n", "\n<|im_end|>\n<|im_start|>assistant\n"),
    "mistral_instruct": ("<s>[INST] ", " [/INST] "),
    "llama_user_assistant": ("<|user|>\n", "\n\n<|assistant|>\n"),
    "deepseek_user_assistant": ("<|user|>\n", "\n\n<|assistant|>\n"),
}


def prompt(style: str, instruction: Column, given: Column) -> Column:
    """The prompt of a record in one of five styles."""
    if style == "alpaca_default":
        return alpaca_prompt(instruction, given)
    if style not in CHAT_STYLES:
        raise ValueError(f"unknown prompt style: {style}")
    given = F.coalesce(given, F.lit(""))
    user = F.when(strip(given) != "", F.concat(instruction, F.lit("\n\n"), given)).otherwise(instruction)
    before, after = CHAT_STYLES[style]
    return F.concat(F.lit(before), user, F.lit(after))


def clip(x: Column, n: int) -> Column:
    return F.when(F.length(x) > n, F.concat(F.left(x, F.lit(n)), F.lit("…"))).otherwise(x)


def perturbed_number(x: Column, share: Column, up: Column) -> Column:
    """The last number of the text moved by ``share`` of itself, one at least, up or down; null without one."""
    head, num, tail = (F.regexp_extract(x, rf"(?s)^(.*?)({NUMBER})([^0-9]*)$", i) for i in (1, 2, 3))
    sign = F.when(up, 1).otherwise(-1)
    real, whole = num.try_cast("double"), num.try_cast("decimal(30,0)")
    moved = F.when(num.contains("."), F.format_string("%.2f", real + sign * F.greatest(F.lit(1.0), F.abs(real) * share)))
    moved = moved.otherwise((whole + sign * F.greatest(F.lit(1), F.floor(F.abs(whole).cast("double") * share).cast("decimal(30,0)"))).cast("decimal(30,0)").cast("string"))
    changed = F.when(moved == num, F.concat(num, F.lit("0"))).otherwise(moved)
    return F.when(has_number(x), F.concat(head, changed, tail))


def truncated(x: Column, share: Column) -> Column:
    """The first ``share`` of the words, one at least, without closing punctuation; under three words unchanged."""
    w = words(x)
    kept = F.greatest(F.lit(1), F.floor(F.size(w) * share).cast("int"))
    return F.when(F.size(w) < 3, x).otherwise(F.regexp_replace(F.array_join(F.slice(w, F.lit(1), kept), " "), r"[.!?;:,]+$", ""))


def shingles(x: Column, k: int = 3) -> Column:
    """Word k-shingles of the normalised text, distinct; the whole text where it is shorter."""

    def cut(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, k), " "))

    return F.array_distinct(F.transform(F.array(words(normalised(x))), cut).getItem(0))  # the words are bound once
