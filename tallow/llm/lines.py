"""Fuzzy line dedup by MinHash, in DataFrame expressions only: one line of each group stays.

Lines are compared in lower case with white space collapsed. A line's shingles are the
``SHINGLE`` characters (UTF-16 units) from each character on; lines of a Jaccard similarity of
0.8 or more over all their shingles are linked, and of each connected group the first
occurrence, by (doc_id, line number), stays. Lines under ``min_chars`` characters stay always.

Equal lines meet once, before anything else. Each distinct line's shingles are hashed in
place (substrings of its bytes, no strings) into bands of minima;
``resemblance.groups`` finds the buckets, verifies candidates by their exact similarity and
unites them. Texts cross the network to collapse equal lines and to verify candidates.

Defined cases: null text has no line; a line of fewer than ``SHINGLE`` characters is one
shingle; rows with one doc_id, or none, are rows of their own unless their texts are equal
too: equal rows' lines are kept or removed together; ``dedup_lines`` drops documents of which
no line with a word is left but had one before, and passes all other columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallow.llm.common import Scratch, free_names, let, setting
from tallow.llm.resemblance import DEALT, WHOLE, dealt_keys, groups, whole_keys, with_few

MIN_CHARS = 20
SHINGLE = 8
#: Bytes of a character (UTF-16).
UNIT = 2
BLANKS = " \t\r"
#: Groups (a power of two) that the generated aggregation holds in its fast map: a task's lines times their parts.
FAST_MAP, FAST_BITS = "spark.sql.codegen.aggregate.fastHashMap.capacityBit", "20"


def normalised(line: Column) -> Column:
    wide = line.contains("  ")
    for blank in BLANKS[1:]:
        wide = wide | line.contains(blank)
    return F.lower(F.trim(F.when(wide, F.regexp_replace(line, f"[{BLANKS}]+", " ")).otherwise(line)))


def encoded(line: Column) -> Column:
    return F.encode(normalised(line), "UTF-16BE")


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, row, text; ``row`` is a hash of the text: it tells rows that share a doc_id apart."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))


def hashed(line: Column, min_chars: int) -> Column:
    return F.when(F.length(line) >= min_chars, F.xxhash64(line))


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, row, line_no, line, h; h is null for lines that stay always.

    Lines are told apart as they stand; what differs in case or white space alone has equal
    shingles and so is linked like any near-equal pair.
    """
    lines = identified(docs).select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.withColumn("line", F.trim("line")).withColumn("h", hashed(F.col("line"), min_chars))


def distinct_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """h, line; copies are collapsed before they cross the network."""
    return occurrences(docs, min_chars).filter("h IS NOT NULL").select("h", "line").dropDuplicates(["h"])


def starts(side: Column) -> Column:
    """Where the shingles of an encoded line begin."""
    return F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(side) - (SHINGLE - 1) * UNIT), F.lit(UNIT))


def shingles(side: Column) -> Column:
    """The hashed shingles of an encoded line, repeats included."""
    return let(side, lambda x: F.transform(starts(x), lambda i: F.xxhash64(F.substring(x, i, SHINGLE * UNIT))))


def pieces(lines: DataFrame) -> DataFrame:
    """The columns of ``lines`` (h, side and others) without side, and x: a row a shingle, its hash of 31 bits."""
    rows = lines.withColumn("i", F.explode(starts(F.col("side"))))
    hashed_piece = F.shiftrightunsigned(F.hash(F.substring("side", F.col("i"), SHINGLE * UNIT)), 1).cast("long")
    return rows.select(*[c for c in lines.columns if c != "side"], hashed_piece.alias("x"))


def signatures(docs: DataFrame, min_chars: int, scratch: Scratch) -> DataFrame:
    """h, keys: the bands' keys of each distinct line, some rows a line.

    A line's length bounds its set, so short lines have minima of the whole set and long ones of its
    parts. Long lines of few different shingles are found afterwards and have both.
    """
    lines = distinct_lines(docs, min_chars).select("h", encoded(F.col("line")).alias("side"))
    count = F.length("side") / UNIT - (SHINGLE - 1)
    short = whole_keys(pieces(lines.filter(count <= WHOLE))).select("h", "keys", F.lit(0).cast("long").alias("seen"), F.lit(False).alias("alone"))
    long = dealt_keys(pieces(lines.filter(count >= DEALT).select("h", "side", (count > WHOLE).alias("alone"))))
    with setting(scratch.spark, FAST_MAP, FAST_BITS):
        signed = scratch.table(short.union(long), "signed")
    few = scratch.table(with_few(signed), "few")
    if few.isEmpty():
        return signed.select("h", "keys")
    again = occurrences(docs, min_chars).select("h", "line").join(few, "h").dropDuplicates(["h"]).select("h", encoded(F.col("line")).alias("side"))
    return signed.select("h", "keys").union(scratch.table(whole_keys(pieces(again)), "signed-few"))


def row_classes(spark: SparkSession, docs: DataFrame, min_chars: int, exhaustive: bool) -> DataFrame:
    """doc_id, row, line_no, line_hash, component (both null for lines that stay always), kept."""
    scratch = Scratch(spark, "lines")
    placed = scratch.table(occurrences(docs, min_chars).select("doc_id", "row", "line_no", "h"), "placed")
    signed = signatures(docs, min_chars, scratch)

    def sides_of(wanted: DataFrame) -> DataFrame:
        rows = distinct_lines(docs, min_chars).join(wanted, "h").select("h", encoded(F.col("line")).alias("side"))
        return rows.select("h", "side", F.size(F.array_distinct(shingles(F.col("side")))).alias("n"))

    roots = groups(spark, signed, sides_of, shingles, scratch, exhaustive=exhaustive)
    # lines that occur once and are not linked stay; a frequent line's rows are split by adaptive execution
    firsts = placed.filter("h IS NOT NULL").groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "line_no", "row")).alias("first"))
    shared = firsts.join(roots.withColumnRenamed("node", "h"), "h", "left").filter("n > 1 OR root IS NOT NULL")
    shared = scratch.table(shared.select("h", F.coalesce("root", "h").alias("component"), "first"), "firsts")
    least = shared.groupBy("component").agg(F.min("first").alias("stays"))
    shared = scratch.table(shared.join(least, "component").select("h", "component", "stays"), "shared")
    rows = placed.join(shared, "h", "left")
    kept = F.col("stays").isNull() | F.col("stays").eqNullSafe(F.struct("doc_id", "line_no", "row"))
    return rows.select("doc_id", "row", "line_no", F.col("h").alias("line_hash"), F.coalesce("component", "h").alias("component"), kept.alias("kept"))


def line_classes(spark: SparkSession, docs: DataFrame, min_chars: int = MIN_CHARS, exhaustive: bool = False) -> DataFrame:
    """doc_id, line_no, line_hash, component (both null for lines that stay always), kept."""
    return row_classes(spark, docs, min_chars, exhaustive).drop("row")


def dedup_lines(spark: SparkSession, docs: DataFrame, min_chars: int = MIN_CHARS, exhaustive: bool = False) -> DataFrame:
    """``docs`` without the removed lines in text, and without documents that lost all."""
    doc, row, gone, left = free_names(docs, "doc", "row", "gone", "left")
    removed = row_classes(spark, docs, min_chars, exhaustive).filter("NOT kept").groupBy(F.col("doc_id").alias(doc), F.col("row").alias(row)).agg(F.collect_set("line_no").alias(gone))
    same = docs["doc_id"].cast("long").eqNullSafe(removed[doc]) & (F.xxhash64(docs["text"].cast("string")) == removed[row])

    def remaining(parts: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone))
        return F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n")

    text = F.col("text").cast("string")
    rows = docs.join(removed, same, "left").withColumn(left, F.when(F.col(gone).isNull(), text).otherwise(let(F.split(text, "\n"), remaining)))
    rows = rows.filter(F.col(gone).isNull() | F.col(left).rlike(r"[^\x00-\x20\x7f ]"))
    return rows.select(*[F.col(left).alias("text") if c == "text" else docs[c] for c in docs.columns])
