"""Best-fit packing of documents into sequences of at most ``max_tokens`` ids.

Bulk-synchronous best-fit decreasing. A superstep takes all documents of one length, longest
first, against all gaps: documents and gaps are range-sorted by size, the sweep walks the
successors (the smallest gap that still holds the document, then the next larger), conflicts
for a gap are resolved by the documents' ranks, the gaps are updated, and the next superstep
begins; what finds no gap opens sequences. A gap takes as many documents of the length as fit
before the sweep moves on, as best-fit would, since a filled gap is smaller and so preferred.

Documents of one length are interchangeable and a length is at most ``max_tokens``, so sizes
are range-sorted as size classes: the corpus is counted by length in parallel, the sweeps
match runs of ranks to runs of sequences (the state is at most ``max_tokens`` gap classes,
whatever the corpus), and every document then finds its place from its rank in parallel. The
result is the best-fit-decreasing packing of single documents, with one shuffle of piece
rows and none of text.

Defined cases: null or empty text is the end id alone; only documents longer than
``max_tokens`` are cut; equal rows are packed each for itself; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallow.llm.common import Scratch
from tallow.llm.encoding import default_vocabulary, encoder

MAX_TOKENS = 2048
END_ID = 0
#: Pieces of one length that are ranked together, and parts of a length at most.
RANKED_TOGETHER, PARTS = 500, 10_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(texts_ids: Iterator[tuple[int | None, bytes]], max_tokens: int) -> Iterator[tuple]:
    for doc_id, ids in texts_ids:
        for piece, at in enumerate(range(0, len(ids), 4 * max_tokens)):
            part = ids[at : at + 4 * max_tokens]
            yield doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)


def document_pieces(docs: DataFrame, vocabulary: str, max_tokens: int, end_id: int) -> DataFrame:
    end = end_id.to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):  # few texts at once as Python strings
                part = batch.slice(at, 1000)
                ids = (x + end for x in encoder(vocabulary).encode_all(part.column(1).to_pylist()))
                rows = list(cut(zip(part.column(0).to_pylist(), ids), max_tokens))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(encode, PIECES)


def sweep(counts: dict[int, int], max_tokens: int) -> list[tuple[int, int, int, int, int, int]]:
    """Supersteps over the length classes.

    Returns (length, first rank, documents, documents a sequence, first sequence, offset).
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # size of gap: runs of sequences that have it
    sizes: list[int] = []
    placed: list[tuple[int, int, int, int, int, int]] = []
    opened = 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        todo, rank = counts[length], 0
        while todo:
            at = bisect_left(sizes, length)
            if at == len(sizes):
                gap, each = max_tokens, max_tokens // length
                first, n = opened, -(-todo // each)
                opened += n
            else:
                gap = sizes[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[at]
                each = gap // length
            full = min(n, todo // each)
            if full:
                placed.append((length, rank, full * each, each, first, max_tokens - gap))
                put(gap - each * length, first, full)
                rank, todo = rank + full * each, todo - full * each
            rest = n - full
            if rest and todo:
                placed.append((length, rank, todo, todo, first + full, max_tokens - gap))
                put(gap - todo * length, first + full, 1)
                full, rank, rest, todo = full + 1, rank + todo, rest - 1, 0
            put(gap, first + full, rest)
    return placed


def pack_documents(
    spark: SparkSession, docs: DataFrame, vocabulary: str | None = None, max_tokens: int = MAX_TOKENS, end_id: int = END_ID
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    scratch = Scratch(spark, "packing")
    pieces = scratch.table(document_pieces(docs, vocabulary or default_vocabulary(), max_tokens, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a class each
    placed = sweep(counts, max_tokens)

    # ranks within a length class: a frequent class is split by a hash, and the parts' sizes summed up
    parts = 1 + min(PARTS, max(counts.values(), default=0) // RANKED_TOGETHER)
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    sizes = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    sizes = sizes.select("length", "part", before.alias("before"))
    own = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(own)).join(sizes, ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before") - 1).alias("rank"))

    runs = spark.sparkContext.broadcast(sorted(placed))  # bounded by the size classes

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        table = np.array(runs.value, dtype=np.int64).reshape(-1, 6)
        low = (table[:, 0] << 50) + table[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            run = table[np.searchsorted(low, (length << 50) + rank, side="right") - 1]
            j = rank - run[:, 1]
            sequence, offset = run[:, 4] + j // run[:, 3], run[:, 5] + j % run[:, 3] * length
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")
