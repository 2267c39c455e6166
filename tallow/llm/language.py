"""Language identification by nearest clustered centroids of TF-IDF n-gram vectors.

A text becomes a hashed vector of its character 1- to 3-grams (letters lower-cased, all else
a word break), damped (1 + log count), weighted by inverse document frequency and scaled to
length one. Each language has ``clusters`` centroids by spherical k-means. The prediction is
the language of the centroid with the greatest cosine, which is also the score.

Rejection by distance: shorter texts lie farther from every centroid, so for each power of
two of the number of n-grams the fit keeps the least cosine of the training texts at least
half as long to their own language's centroids; a text below ``slack`` times that, or without
a letter, is rejected.

Fit: of the labelled rows of each language about ``sample`` (at most ``SAMPLE_LIMIT`` times
that), chosen by a hash of doc_id, whole texts; executors send hashed counts. Everything
after the fit runs in one pass over the whole texts, without a shuffle.

Defined cases: null or letterless text is ``und`` with score 0; with no labelled row at all,
every text is ``und``; ties go to the language first in order; long texts are read in slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallow.llm.common import free_names

UND = "und"
DIMENSIONS = 1 << 14
CLUSTERS = 4
#: Labelled rows a language that the fit reads, on average, and the factor it may reach.
SAMPLE, SAMPLE_LIMIT = 800, 2
SLACK = 0.6
#: Texts of at most so many n-grams are rejected only below a cosine of TRACE: too little to judge by.
FEW, TRACE = 64, 0.02
BUCKETS = 24
SLICE = 1 << 18

_LETTERS: np.ndarray | None = None


def letters() -> np.ndarray:
    """Code point -> lower-case letter, 0 for what is no letter; built once a worker."""
    global _LETTERS
    if _LETTERS is None:
        table = np.zeros(0x110000, dtype=np.uint32)
        for code in range(len(table)):
            c = chr(code)
            if c.isalpha():
                low = c.lower()
                table[code] = ord(low) if len(low) == 1 else code
        _LETTERS = table
    return _LETTERS


def counts(text: str, dimensions: int = DIMENSIONS) -> np.ndarray | None:
    """Hashed n-gram counts; None for a text without a letter."""
    table, total = letters(), None
    carried = np.zeros(1, dtype=np.uint32)
    for at in range(0, len(text), SLICE):
        codes = table[np.frombuffer(text[at : at + SLICE].encode("utf-32-le", "replace"), np.uint32)]
        codes = np.concatenate([carried, codes])
        codes = np.concatenate([codes[:1], codes[1:][(codes[1:] != 0) | (codes[:-1] != 0)]])
        found = hashed(codes, len(carried), dimensions)
        total = found if total is None else total + found
        carried = codes[-2:]
    if total is not None and carried[-1]:
        total = total + hashed(np.concatenate([carried, [0]]).astype(np.uint32), len(carried), dimensions)
    return total if total is not None and total.any() else None


def hashed(codes: np.ndarray, new: int, dimensions: int) -> np.ndarray:
    """Counts of the n-grams that end at position ``new`` or later; lone breaks are none."""
    out = np.zeros(dimensions, dtype=np.int64)
    with np.errstate(over="ignore"):
        mixed = codes.astype(np.uint64) + np.uint64(1)
        gram = np.zeros(len(codes), dtype=np.uint64)
        for n in (1, 2, 3):
            gram[n - 1 :] = gram[n - 1 :] * np.uint64(0x100000001B3) + mixed[: len(codes) - n + 1] if n > 1 else mixed
            ends = gram[max(new, n - 1) :]
            keep = codes[max(new, n - 1) :] != 0 if n == 1 else np.ones(len(ends), dtype=bool)
            h = (ends[keep] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            out += np.bincount((h >> np.uint64(40)).astype(np.int64) % dimensions, minlength=dimensions)
    return out


def bucket(total: float) -> int:
    return min(BUCKETS - 1, int(total).bit_length())


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # a row each
    owner: np.ndarray  # language of each row
    least: np.ndarray  # by language and bucket: a cosine below it is rejected

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, rejected."""
        found = counts(text, len(self.idf)) if text and self.languages else None
        if found is None:
            return UND, 0.0, True
        at = np.flatnonzero(found)
        v = weigh(found[at], self.idf[at])
        cosines = v @ self.centroids[at]
        best = int(np.argmax(cosines))
        language, score = int(self.owner[best]), float(min(1.0, max(0.0, cosines[best])))
        return self.languages[language], score, score < self.least[language, bucket(found.sum())]


def weigh(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1 + np.log(found)) * idf
    return (v / max(np.sqrt((v * v).sum()), 1e-12)).astype(np.float32)


def cluster(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; the first centres are mutually distant rows."""
    centres = [rows.mean(axis=0)]
    nearest = rows @ centres[0]
    while len(centres) < min(k, len(rows)):
        centres.append(rows[int(np.argmin(nearest))])
        nearest = np.maximum(nearest, rows @ centres[-1])
    centres = np.stack(centres)
    for _ in range(rounds):
        own = np.argmax(rows @ centres.T, axis=1)
        for c in range(len(centres)):
            if (own == c).any():
                centres[c] = rows[own == c].mean(axis=0)
        centres /= np.maximum(np.sqrt((centres * centres).sum(axis=1, keepdims=True)), 1e-12)
    return centres


def fit(labelled: DataFrame, sample: int = SAMPLE, clusters: int = CLUSTERS, dimensions: int = DIMENSIONS, slack: float = SLACK) -> Model:
    """``labelled``: key (any), text, lang. Nulls in text or lang are left out."""
    rows = labelled.filter("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    share = F.pmod(F.xxhash64("key", F.lit("fit")), F.lit(1_000_000))
    chosen = F.lit(False)
    for lang, n in sizes.items():
        chosen = chosen | ((F.col("lang") == lang) & (share < int(min(1.0, sample / n) * 1_000_000)))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = counts(text, dimensions)
                if found is not None:
                    at = np.flatnonzero(found)
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([at.astype(np.int32)]), pa.array([found[at].astype(np.int32)])], names=["lang", "at", "n"])

    picked = rows.filter(chosen).select("lang", "text").mapInArrow(vectors, "lang string, at array<int>, n array<int>")
    by_lang: dict[str, list] = {lang: [] for lang in sorted(sizes)}
    for r in picked.limit(SAMPLE_LIMIT * sample * max(1, len(sizes))).collect():  # bounded by the sample
        by_lang[r["lang"]].append((np.array(r["at"], dtype=np.int64), np.array(r["n"], dtype=np.int64)))
    by_lang = {lang: found for lang, found in by_lang.items() if found}
    frequency, texts = np.zeros(dimensions), 0
    for found in by_lang.values():
        for at, _ in found:
            frequency[at] += 1
            texts += 1
    idf = np.log((1 + texts) / (1 + frequency)) + 1
    centroids, owner = [], []
    least = np.zeros((len(by_lang), BUCKETS))
    for i, found in enumerate(by_lang.values()):
        matrix = np.zeros((len(found), dimensions), dtype=np.float32)
        for row, (at, n) in zip(matrix, found):
            row[at] = weigh(n, idf[at])
        own = cluster(matrix, clusters)
        centroids.append(own)
        owner += [i] * len(own)
        near, size = (matrix @ own.T).max(axis=1), np.array([bucket(n.sum()) for _, n in found])
        for b in range(BUCKETS):
            longer = near[size >= min(b - 1, size.max())]
            least[i, b] = slack * longer.min() if b > bucket(FEW) else TRACE
    stacked = np.concatenate(centroids).T.copy() if centroids else np.zeros((dimensions, 0), dtype=np.float32)
    return Model(list(by_lang), idf, stacked, np.array(owner, dtype=np.int64), least)


def predict(spark: SparkSession, docs: DataFrame, model: Model) -> tuple[DataFrame, list[str]]:
    """``docs`` with language, score and whether it is rejected, and the names of these columns."""
    text, *names = free_names(docs, "_text", "_lang", "_score", "_rejected")
    predicted = [T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType()))]
    shared = spark.sparkContext.broadcast(model)  # dimensions x centroids, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                found = [shared.value.predict(t) for t in part.column(0).to_pylist()]
                columns = [pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *columns], names=[*part.schema.names[1:], *names])

    rows = docs.select(F.col("text").cast("string").alias(text), "*").mapInArrow(run, T.StructType([*docs.schema.fields, *predicted]))
    return rows, names


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_documents(docs: DataFrame) -> Model:
    """Learns from the documents that are not held out."""
    return fit(docs.filter(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("key"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")))


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row of ``docs``."""
    rows, (lang, score, rejected) = predict(spark, docs.select("doc_id", "text"), fit_documents(docs))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(lang).alias("lang_pred"), F.col(score).alias("score"), F.col(rejected).alias("rejected"))


def keep_identified(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected."""
    rows, names = predict(spark, docs, fit_documents(docs))
    return rows.filter(~F.col(names[-1])).drop(*names)
