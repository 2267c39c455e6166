"""Quality rules with cross-document line frequency, in DataFrame expressions only.

Base counts come from each text alone. For the verdict every line is normalised (lower case,
white space collapsed, ends trimmed) and hashed; a line that more than ``max_documents``
distinct documents of one host hold is boilerplate of that host and is removed; a document
that thereby loses more than ``max_removed`` of its words is rejected as depleted.

A document lists each of its lines once, with the words it has in all its occurrences, so a
repeated line meets the count as one row a document; counts are reduced before the shuffle,
and frequent lines are joined back by line and a salt, so a line that a third of all
documents hold is spread over ``SALTS`` tasks. The text itself is read once and not shuffled.

Defined cases: null text has no words and fails; a null host is a host of its own; rows that
share a doc_id count as one document for a line's frequency (those without one each for its
text), and each has its own verdict; equal rows have the same; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallow.llm.common import Scratch, let

MIN_WORDS = 50
MAX_DOCUMENTS = 20
MAX_REMOVED = 0.5
SALTS = 32

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def repeated_words(words: Column, window: int = 3) -> Column:
    """Words that lie in a window found at least twice.

    Each window's hash gives the high bits of a long and its position the low ones; sorted,
    equal windows are neighbours, and neighbours' words are compared. Of the positions that have one, each covers the words up to
    the next position, ``window`` at most.
    """
    zero = F.lit(0).cast("long")

    def packed(w: Column) -> Column:
        bits = F.length(F.bin(F.size(w)))
        keys = F.transform(
            F.sequence(F.lit(1), F.size(w) - (window - 1)),
            lambda i: F.call_function("shiftleft", F.xxhash64(*[F.get(w, i + (j - 1)) for j in range(window)]), bits).bitwiseOR(i.cast("long")),
        )
        return let(F.struct(F.sort_array(keys).alias("keys"), bits.alias("bits"), w.alias("words")), twice)

    def twice(s: Column) -> Column:
        def high(x: Column) -> Column:
            return F.call_function("shiftright", x, s["bits"])

        mask = F.call_function("shiftleft", F.lit(1).cast("long"), s["bits"]) - 1

        def equal(x: Column, y: Column) -> Column:
            """Equal hashes, and then equal words."""
            found = high(x) == high(y)
            for j in range(window):
                found = found & (F.get(s["words"], (x.bitwiseAND(mask) + (j - 1)).cast("int")) == F.get(s["words"], (y.bitwiseAND(mask) + (j - 1)).cast("int")))
            return found

        same = F.filter(s["keys"], lambda x, i: F.coalesce(equal(x, F.get(s["keys"], i - 1)), F.lit(False)) | F.coalesce(equal(x, F.get(s["keys"], i + 1)), F.lit(False)))
        return let(F.sort_array(F.transform(same, lambda x: x.bitwiseAND(mask))), covered)

    def covered(at: Column) -> Column:
        before = F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0)))
        steps = F.zip_with(before, F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), lambda a, b: F.least(b - a, F.lit(window).cast("long")))
        return F.when(F.size(at) > 0, F.aggregate(steps, F.lit(window).cast("long"), lambda s, x: s + x)).otherwise(zero)

    return F.when(F.size(words) > window, let(words, packed)).otherwise(zero)


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))


def base_counts(docs: DataFrame, host: str) -> DataFrame:
    """doc_id, host, row (a hash of the text), the five counts and the normalised lines (hash, words)."""
    rows = docs.select(F.col("doc_id"), F.col(host).cast("string").alias("host"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.when(trimmed(F.col("text")) == "", F.array().cast("array<string>")).otherwise(F.split(trimmed(F.col("text")), SPACE)))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    rows = rows.withColumn("lines", lines)

    def listed(line: Column) -> Column:
        return let(
            F.lower(F.regexp_replace(trimmed(line), SPACE, " ")),
            lambda x: F.struct(F.xxhash64(x).alias("h"), (F.length(x) - F.length(F.replace(x, F.lit(" "))) + 1).alias("w")),
        )

    return rows.select(
        "doc_id",
        "host",
        F.xxhash64("text").alias("row"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.transform("lines", listed).alias("listed"),
    )


def quality_rules(
    spark: SparkSession,
    docs: DataFrame,
    host: str = "source",
    min_words: int = MIN_WORDS,
    max_documents: int = MAX_DOCUMENTS,
    max_removed: float = MAX_REMOVED,
) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and the words that frequent lines took away."""
    base = Scratch(spark, "quality").table(base_counts(docs, host), "base")
    unique = base.select("doc_id", "row", "host", "listed").dropDuplicates(["doc_id", "row", "host"])  # equal rows do not add up
    lines = unique.select("doc_id", "row", "host", F.explode("listed").alias("l")).select("doc_id", "row", "host", "l.h", "l.w")
    lines = lines.groupBy("doc_id", "row", "host", "h").agg(F.sum("w").alias("w"))
    frequent = lines.groupBy("host", "h").agg(F.count_distinct(F.coalesce("doc_id", "row")).alias("documents")).filter(F.col("documents") > max_documents)
    frequent = frequent.select(F.xxhash64("host", "h").alias("line"), "h", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt")).distinct()
    salted = lines.select("doc_id", "row", "host", "w", F.xxhash64("host", "h").alias("line"), "h", F.pmod(F.xxhash64("doc_id", "row"), F.lit(SALTS)).cast("int").alias("salt"))
    removed = salted.join(frequent, ["line", "h", "salt"]).groupBy("doc_id", "row", "host").agg(F.sum("w").alias("removed"))
    removed = removed.withColumnsRenamed({"doc_id": "_id", "row": "_row", "host": "_host"})
    total = base.join(removed, base["doc_id"].eqNullSafe(removed["_id"]) & (base["row"] == removed["_row"]) & base["host"].eqNullSafe(removed["_host"]), "left")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    taken = F.coalesce(F.col("removed"), F.lit(0))
    return total.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (taken <= max_removed * F.col("n_words"))).alias("kept"),
        taken.cast("long").alias("removed_words"),
    )
