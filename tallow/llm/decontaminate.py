"""Benchmark decontamination by winnowed k-gram fingerprints.

An item's windows are its runs of ``window`` words (an item of fewer words is one window).
Of the k-grams of a window the least hash is kept as its fingerprint, and neighbouring
windows mostly keep the same one. Any text that shares a whole window with an item keeps the
same fingerprint for it, so joining the fingerprints of the documents with those of the
benchmark misses no shared span of ``window`` words or more. A joined fingerprint is then
extended to the whole windows around it, which are compared word by word: hits are exact.

The benchmark is indexed in blocks of bounded size, written to the shared folder. A task
holds one block at a time and passes each batch of documents by every block, so a benchmark
of any size keeps the memory of a task constant; documents are never shuffled.

Defined cases: null and wordless texts have no words and no hits; items without words and
null items match nothing; items that share an id count once; an item id of null is listed as
the empty string; extra columns of the documents pass through ``mark`` unchanged.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallow.llm.common import Scratch, free_names
from tallow.llm.files import make_folder, open_folder
from tallow.llm.words import ALNUM, slices, texts

WINDOW = 10
KGRAM = 5
#: A block of the index holds so many items and so many bytes of their text.
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 16 << 20
#: Document words that are matched at once.
STEP = 1 << 19


def word_list(text: bytes) -> Iterator[list[bytes]]:
    for part in slices(text.translate(ALNUM)):
        yield part.split()


def rolled(values: np.ndarray, size: int, multiplier: int) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` values."""
    n = len(values) - size + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            out = out * np.uint64(multiplier) + values[j : j + n]
        return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class Windows:
    """The distinct windows of one length, and what winnowing keeps of them."""

    def __init__(self, rows: np.ndarray, owners: list[list[str]], values: np.ndarray):
        self.length = rows.shape[1]
        self.k = min(KGRAM, self.length)
        self.multiplier = 0x9E3779B97F4A7C15
        while True:  # another multiplier if two windows share a hash
            hashes = np.concatenate([rolled(values[r], self.length, self.multiplier) for r in rows])
            if len(np.unique(hashes)) == len(hashes):
                break
            self.multiplier += 2
        order = np.argsort(hashes)
        self.hashes, self.rows = hashes[order], rows[order]
        self.owners = [owners[i] for i in order]
        grams = np.stack([rolled(values[r], self.k, self.multiplier) for r in self.rows])
        self.kept = np.unique(grams.min(axis=1))

    def match(self, ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows that occur in ``ids`` (-1: a word that no item has), and which."""
        n = len(ids) - self.length + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        foreign = np.concatenate([[0], np.cumsum(ids < 0)])
        starts = np.flatnonzero(foreign[self.length :] == foreign[:n])
        if not len(starts):
            return starts, starts
        grams = rolled(values[ids], self.k, self.multiplier)
        least = grams[starts].copy()
        for j in range(1, self.length - self.k + 1):
            np.minimum(least, grams[starts + j], out=least)
        at = np.minimum(np.searchsorted(self.kept, least), len(self.kept) - 1)
        starts = starts[self.kept[at] == least]  # joined fingerprints; now extend them
        whole = np.zeros(len(starts), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for j in range(self.length):
                whole = whole * np.uint64(self.multiplier) + values[ids[starts + j]]
            whole = (whole ^ (whole >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        at = np.minimum(np.searchsorted(self.hashes, whole), len(self.hashes) - 1)
        same = self.hashes[at] == whole
        for j in range(self.length):
            same &= ids[np.minimum(starts + j, len(ids) - 1)] == self.rows[at, j]
        return starts[same], at[same]


class Block:
    """The index of one block of items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple, set[str]]] = {}
        for item_id, text in items:
            words = [w for part in word_list(text) for w in part]
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            size = min(window, len(ids))
            for at in range(len(ids) - size + 1 if size else 0):
                by_length.setdefault(size, {}).setdefault(tuple(ids[at : at + size]), set()).add(item_id)
        self.values = np.random.default_rng(7).integers(0, 1 << 64, size=len(self.vocabulary) + 1, dtype=np.uint64)
        self.windows = [Windows(np.array(list(found)), [sorted(x) for x in found.values()], self.values) for _, found in sorted(by_length.items())]

    def ids(self, text: bytes) -> np.ndarray:
        get = self.vocabulary.get
        parts = [np.fromiter(map(get, words, [-1] * len(words)), np.int64, len(words)) for words in word_list(text)]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)

    def find(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, Windows]]:
        """(starts, numbers of the windows, their table)."""
        for table in self.windows:
            for at in range(0, len(ids), STEP):
                starts, which = table.match(ids[at : at + STEP + table.length - 1], self.values)
                if len(starts):
                    yield starts + at, which, table


def write_blocks(spark: SparkSession, benchmark: DataFrame, folder: str, window: int) -> list[str]:
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").distinct()
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))
    system, path = open_folder(make_folder(folder))
    names = []
    for b in range(blocks):
        block = Block([(r["id"], r["text"].encode()) for r in dealt.filter(F.col("block") == b).collect()], window)  # one block's items
        names.append(f"{uuid.uuid4().hex}.block")
        with system.open_output_stream(f"{path}/{names[-1]}") as out:
            out.write(pickle.dumps(block))
    return names


_HELD: tuple[str, Block | None] = ("", None)


def load_block(folder: str, name: str) -> Block:
    global _HELD
    if _HELD[0] != name:
        _HELD = ("", None)
        system, path = open_folder(folder)
        with system.open_input_stream(f"{path}/{name}") as f:
            _HELD = (name, pickle.loads(f.read()))
    return _HELD[1]


def verdicts(documents: list[bytes], folder: str, names: list[str]) -> tuple[list[int], list[int], list[list[str]]]:
    """Words, hit words and items of each document."""
    n_words = [0] * len(documents)
    hits = [[] for _ in documents]
    items: list[set[str]] = [set() for _ in documents]
    for name in names:
        block = load_block(folder, name)
        at = 0
        while at < len(documents):  # several short documents are matched together, parted by a foreign word
            group, lengths = [], []
            while at + len(lengths) < len(documents) and sum(lengths) < STEP // 4:
                ids = block.ids(documents[at + len(lengths)])
                group += [ids, np.array([-1])]
                lengths.append(len(ids))
            bounds = np.concatenate([[0], np.cumsum(np.array(lengths) + 1)])
            n_words[at : at + len(lengths)] = lengths
            for starts, which, table in block.find(np.concatenate(group)):
                doc = np.searchsorted(bounds, starts, side="right") - 1
                for d, begin, end in zip(*runs(doc)):
                    local = starts[begin:end] - bounds[d]
                    hits[at + d].append((local, local + table.length))
                    for w in np.unique(which[begin:end]).tolist():
                        items[at + d].update(table.owners[w])
            at += len(lengths)
    return n_words, [covered(h) for h in hits], [sorted(x) for x in items]


def runs(values: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[first].tolist(), first.tolist(), np.append(first[1:], len(values)).tolist()


def covered(spans: list[tuple[np.ndarray, np.ndarray]]) -> int:
    """Words inside at least one span."""
    if not spans:
        return 0
    starts, ends = np.concatenate([s for s, _ in spans]), np.concatenate([e for _, e in spans])
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    begins = np.concatenate([[starts[0]], np.maximum(starts[1:], reach[:-1])])
    return int(np.maximum(reach - begins, 0).sum())


def mark(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, list[str]]:
    """``docs`` with words, hit words and items (sorted ids of those with occurring windows), and the names of these columns."""
    text, *added = free_names(docs, "_text", "_n_words", "_n_hit", "_items")
    fields = [T.StructField(n, t) for n, t in zip(added, (T.LongType(), T.LongType(), T.ArrayType(T.StringType())))]
    folder = Scratch(spark, "benchmark").path("blocks")
    names = write_blocks(spark, benchmark, folder, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                n_words, n_hit, items = verdicts(list(texts(part.column(0))), folder, names)
                marks = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *marks], names=[*part.schema.names[1:], *added])

    read = docs.select(F.col("text").cast("string").alias(text), "*")
    return read.mapInArrow(run, T.StructType([*docs.schema.fields, *fields])), added


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of ``docs``."""
    marked, (n_words, n_hit, items) = mark(spark, docs.select("doc_id", "text"), benchmark, window)
    return marked.select(
        "doc_id",
        F.col(n_words).alias("n_words"),
        F.col(n_hit).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.col(n_hit) > 0).alias("contaminated"),
    )


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs."""
    marked, names = mark(spark, docs, benchmark, window)
    return marked.filter(F.col(names[1]) == 0).drop(*names)
