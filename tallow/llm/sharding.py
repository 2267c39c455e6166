"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` cells of a ring of ``cells`` cells; a key hashes to a cell and
belongs to the next owned cell clockwise. No shard takes more than its capacity: keys that
find it full continue clockwise to the next owned cell whose shard has room. With
``epsilon=0`` the capacities are the row count dealt out evenly (law ``rows``); a larger
``epsilon`` moves fewer keys when a shard is added.

Turns: the keys of an arc arrive in hash order; in turn t every arc offers what it still
holds to its t-th owned cell clockwise, arcs in ring order. The outcome depends on rows
alone, not on partitions. Keys are counted by arc first, the turns then run over the counts
(at most ``shards * vnodes`` numbers, whatever the corpus), and each key finds its shard
from its rank within its arc: one shuffle, of (doc_id, size, crc32) without the text.

Defined cases: null text has no bytes and crc32 0; a null doc_id hashes by its text; equal
rows share a turn order and lie in consecutive slots; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallow.llm.common import Scratch, shuffle_partitions

SHARDS = 40
VNODES = 128


def ring(shards: int, vnodes: int) -> tuple[int, list[tuple[int, int]]]:
    """Number of cells, and (cell, shard) of each virtual node in ring order."""
    cells = 1 << max(10, (8 * shards * vnodes - 1).bit_length())
    taken: dict[int, int] = {}
    for shard in range(shards):
        for replica in range(vnodes):
            digest = hashlib.blake2b(f"{shard}/{replica}".encode(), digest_size=8).digest()
            cell = int.from_bytes(digest, "big") % cells
            taken[cell] = min(shard, taken.get(cell, shard))  # the lower shard keeps a contested cell
    return cells, sorted(taken.items())


def capacities(rows: int, shards: int, epsilon: float) -> list[int]:
    if epsilon > 0:
        return [-(-int(rows * (1 + epsilon) * 1_000_000) // (shards * 1_000_000)) + 1] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def turns(counts: dict[int, int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, slot of the first rank) of each run of keys."""
    n, room, used = len(owners), list(room), [0] * len(room)
    runs: list[tuple[int, int, int, int, int]] = []
    waiting = [(arc, 0, count) for arc, count in sorted(counts.items()) if count]
    step = 0
    while waiting:
        left = []
        for arc, start, count in waiting:
            shard = owners[(arc + step) % n]
            take = min(count - start, room[shard])
            if take:
                runs.append((arc, start, start + take, shard, used[shard]))
                room[shard] -= take
                used[shard] += take
            if start + take < count:
                left.append((arc, start + take, count))
        waiting, step = left, step + 1
        if step > n:
            raise ValueError("the shards have less room than there are rows")
    return runs


def shard_documents(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, epsilon: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs``."""
    scratch = Scratch(spark, "sharding")
    cells, nodes = ring(shards, vnodes)
    owners = [shard for _, shard in nodes]
    arc_of, at = [], 0
    for cell in range(cells):
        while at < len(nodes) and nodes[at][0] < cell:
            at += 1
        arc_of.append(at % len(nodes))
    ring_table = spark.createDataFrame(list(enumerate(arc_of)), "cell int, arc int")

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    # equal rows are counted before they meet, so a row repeated without end stays one row
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("h", F.when(F.col("doc_id").isNull(), F.xxhash64("text_crc32", "size")).otherwise(F.xxhash64("doc_id")))
    rows = rows.withColumn("cell", F.shiftrightunsigned("h", 64 - (cells.bit_length() - 1)).cast("int"))
    rows = scratch.table(rows.join(F.broadcast(ring_table), "cell").drop("cell"), "keys")

    counts = {r["arc"]: r["n"] for r in rows.groupBy("arc").agg(F.sum("copies").alias("n")).collect()}  # one number an arc
    total = sum(counts.values())
    by_arc: dict[int, list] = defaultdict(list)
    for arc, start, end, shard, slot in turns(counts, owners, capacities(total, shards, epsilon)):
        by_arc[arc].append((start, end, shard, slot))
    runs = spark.createDataFrame(
        sorted(by_arc.items()), "arc int, runs array<struct<start:long,end:long,shard:int,slot:long>>"
    )

    order = Window.partitionBy("arc").orderBy("h", "doc_id", "text_crc32", "size")
    ranked = rows.repartition(shuffle_partitions(spark), "arc").withColumn("last", F.sum("copies").over(order))
    ranked = ranked.join(F.broadcast(runs), "arc")
    # a row and its copies take the ranks last - copies .. last - 1, in one run or across several
    pieces = ranked.select(
        "doc_id",
        "size",
        "text_crc32",
        F.explode(
            F.expr(
                "filter(transform(runs, r -> struct(greatest(r.start, last - copies) AS a, least(r.end, last) AS b, r.shard AS shard, r.slot - r.start AS base)), r -> r.a < r.b)"
            )
        ).alias("r"),
    )
    placed = pieces.select(
        "doc_id",
        "size",
        "text_crc32",
        F.col("r.shard").alias("shard"),
        F.when(F.col("r.b") - F.col("r.a") == 1, F.array("r.a")).otherwise(F.sequence(F.col("r.a"), F.col("r.b") - 1)).alias("ranks"),
        F.col("r.base").alias("base"),
    ).select("doc_id", "size", "text_crc32", "shard", "base", F.explode("ranks").alias("rank"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("base") + F.col("rank")).alias("slot"),
        F.lit(None).cast(T.IntegerType()).alias("grown_shard"),
    )
