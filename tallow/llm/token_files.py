"""Token ids in binary shards with keyed access through a minimal perfect hash.

A shard holds a range of document keys in ascending order::

    magic | payload: raw ids, little-endian | index | footer (JSON) | footer length | magic

The payload is unsigned 16-bit where the vocabulary allows, else 32-bit. The index has the
token offset and the key of every document, a minimal perfect hash over the distinct keys,
and for each of its slots a 32-bit fingerprint of the key, the key's first document and its
number of documents: a lookup is one hash, one fingerprint comparison and one slice,
whatever the size of the shard.

Shards are written under names of their own by every task attempt, and only the attempts
that Spark counts enter the manifest, so a lost executor or a speculative twin leaves at
most an unlisted file. A task streams its range: it holds the index, not the payload.

Defined cases: null or empty text is the end id alone; documents with a null key come first
and are reached by position only; rows that share a key lie side by side, the lower text
hash first; an empty table gives no shard.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallow.llm.common import Scratch, shuffle_partitions
from tallow.llm.encoding import default_vocabulary, encoder
from tallow.llm.files import make_folder, open_folder
from tallow.llm.perfect_hash import PerfectHash, fingerprints

END_ID = 1
MAGIC = b"TALLOWT1"
READ_TOKENS = 1 << 20

MANIFEST = "first_key long, nulls long, documents long, tokens long, file string, part int"


def sections(keys: np.ndarray, nulls: int, offsets: np.ndarray) -> list[tuple[str, bytes]]:
    """The index of a shard whose documents, after ``nulls`` without a key, have ``keys`` in order."""
    distinct, first, copies = np.unique(keys, return_index=True, return_counts=True)
    table = PerfectHash.build(distinct)
    slot = table.lookup(distinct)
    entries = np.zeros(len(distinct), dtype=[("fingerprint", "<u4"), ("first", "<u4"), ("copies", "<u4")])
    entries["fingerprint"][slot] = fingerprints(distinct)
    entries["first"][slot] = first + nulls
    entries["copies"][slot] = copies
    return [("offsets", offsets.astype("<u8").tobytes()), ("keys", keys.astype("<i8").tobytes()), ("hash", table.to_bytes()), ("entries", entries.tobytes())]


def write_shards(docs: DataFrame, folder: str, vocabulary: str, end_id: int, partitions: int) -> DataFrame:
    """Writes the shards when run; the manifest's rows."""
    end = end_id.to_bytes(4, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens = encoder(vocabulary)
        kind = "<u2" if max(end_id + 1, tokens.tokenizer.get_vocab_size()) <= 1 << 16 else "<u4"
        system, base = open_folder(folder)
        out, name, nulls = None, f"{uuid.uuid4().hex}.tok", 0
        keys: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                if out is None:
                    out = system.open_output_stream(f"{base}/{name}")
                    out.write(MAGIC)
                sizes = []
                for ids in tokens.encode_all(part.column(1).to_pylist()):
                    out.write(np.frombuffer(ids + end, "<u4").astype(kind).tobytes())
                    sizes.append(len(ids) // 4 + 1)
                column = part.column(0)
                nulls += column.null_count
                keys.append(column.drop_null().to_numpy(zero_copy_only=False))
                lengths.append(np.array(sizes, dtype=np.int64))
        if out is None:
            return
        all_keys, all_lengths = np.concatenate(keys), np.concatenate(lengths)
        offsets = np.concatenate([[0], np.cumsum(all_lengths)])
        footer: dict = {"ids": kind, "documents": len(all_lengths), "nulls": nulls, "tokens": int(offsets[-1]), "sections": {}}
        at = len(MAGIC) + int(offsets[-1]) * np.dtype(kind).itemsize
        for label, data in sections(all_keys, nulls, offsets):
            out.write(data)
            footer["sections"][label] = [at, len(data)]
            at += len(data)
        tail = json.dumps(footer).encode()
        out.write(tail + len(tail).to_bytes(4, "little") + MAGIC)
        out.close()
        first = int(all_keys[0]) if len(all_keys) else None
        row = [[first], [nulls], [len(all_lengths)], [int(offsets[-1])], [name], [TaskContext.get().partitionId()]]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names=["first_key", "nulls", "documents", "tokens", "file", "part"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    dealt = rows.repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return dealt.mapInArrow(write, MANIFEST)


class Shard:
    """Reads one shard: ``ids(key)`` by the perfect hash, ``scan()`` in key order."""

    def __init__(self, folder: str, name: str):
        system, base = open_folder(folder)
        self.file = system.open_input_file(f"{base}/{name}")
        size = self.file.size()
        tail = self.file.read_at(12, size - 12)
        if tail[4:] != MAGIC or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{name} is not a token shard")
        length = int.from_bytes(tail[:4], "little")
        self.footer = json.loads(self.file.read_at(length, size - 12 - length))
        self.kind = np.dtype(self.footer["ids"])
        self.offsets = np.frombuffer(self._section("offsets"), "<u8").astype(np.int64)
        self.keys = np.frombuffer(self._section("keys"), "<i8")
        self.hash = PerfectHash.from_bytes(self._section("hash"))
        self.entries = np.frombuffer(self._section("entries"), [("fingerprint", "<u4"), ("first", "<u4"), ("copies", "<u4")])

    def _section(self, label: str) -> bytes:
        at, length = self.footer["sections"][label]
        return self.file.read_at(length, at)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that the shard does not have."""
        if not len(self.entries):
            return np.full(len(keys), -1, dtype=np.int64)
        slot = self.hash.lookup(keys)
        return np.where((slot >= 0) & (self.entries["fingerprint"][slot] == fingerprints(keys)), slot, -1)

    def tokens(self, start: int, end: int) -> np.ndarray:
        size = self.kind.itemsize
        return np.frombuffer(self.file.read_at((end - start) * size, len(MAGIC) + start * size), self.kind).astype("<u4")

    def ids(self, key: int) -> list[np.ndarray]:
        """The ids of every document with this key."""
        slot = int(self.find(np.array([key], dtype=np.int64))[0])
        if slot < 0:
            return []
        first, copies = int(self.entries["first"][slot]), int(self.entries["copies"][slot])
        return [self.tokens(self.offsets[i], self.offsets[i + 1]) for i in range(first, first + copies)]

    def scan(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(key, offset, ids) of every document; each key is looked up in the index."""
        nulls, n = self.footer["nulls"], self.footer["documents"]
        order = np.arange(n)
        if len(self.keys):
            distinct, inverse, seen = np.unique(self.keys, return_inverse=True, return_index=False, return_counts=True)
            slot = self.find(distinct)
            if (slot < 0).any() or (self.entries["copies"][slot] != seen).any():
                raise ValueError("the index misses a key")
            starts = np.concatenate([[0], np.cumsum(seen)[:-1]])
            order[nulls:] = self.entries["first"][slot][inverse] + (np.arange(len(self.keys)) - starts[inverse])
        at = 0
        while at < n:
            end = max(at + 1, int(np.searchsorted(self.offsets, self.offsets[at] + READ_TOKENS, side="right")) - 1)
            held = self.tokens(self.offsets[at], self.offsets[end])
            for i in range(at, end):
                j = order[i]
                start, stop = self.offsets[j] - self.offsets[at], self.offsets[j + 1] - self.offsets[at]
                yield (None if i < nulls else int(self.keys[i - nulls])), int(self.offsets[j]), held[start:stop]
            at = end


def read_shards(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    shards, start = [], 0
    for r in sorted(manifest.collect(), key=lambda r: (r["first_key"] is not None and not r["nulls"], r["part"])):  # a row a file
        shards.append((r["file"], start))
        start += r["tokens"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(*(c.to_pylist() for c in batch.columns)):
                rows: list[tuple] = []
                for key, at, ids in Shard(folder, name).scan():
                    rows.append((key, base + at, len(ids), zlib.crc32(ids.tobytes())))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame(shards, "file string, start long").repartition(max(1, len(shards)))
    return listed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(spark: SparkSession, docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, partitions: int | None = None) -> DataFrame:
    """Writes the shards of ``docs`` into a scratch folder and reads them back."""
    scratch = Scratch(spark, "tokens")
    folder = make_folder(scratch.path("shards"))
    written = write_shards(docs, folder, vocabulary or default_vocabulary(), end_id, partitions or shuffle_partitions(spark))
    return read_shards(spark, folder, scratch.table(written, "manifest"))
