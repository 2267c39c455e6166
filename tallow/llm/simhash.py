"""SimHash near duplicates by a Gray-order hierarchical index.

Fingerprints of at most ``distance`` (3) differing bits are linked. The distinct fingerprints
are cut into five blocks of bits; three differing bits leave two blocks alike, so every link
lies in one of the groups that share two blocks (ten groups a fingerprint): these shared
masked patterns are the top of the hierarchy and deal it out over the cluster. Inside a group
the fingerprints are sorted by Gray rank; runs of them become leaves, runs of leaves become
nodes, and each node keeps the masked bits that all below it share and that its parent does
not have yet. A search walks down adding up the differences on each node's own bits and
leaves a node, with all below it, once they exceed ``distance`` or once all below it is
already in the searcher's component. So no link between components is lost, and a dense
group costs little more than its members.

Equal fingerprints meet as one row with their smallest doc_id. A group reports a spanning
forest, at most one edge a member.

``keep_one`` leaves one document of each group of texts whose five-word shingles have a Jaccard
similarity of 0.8 or more. Three bits of 64 hold only the closest of such pairs (a pair of 0.8
differs in ten bits), so the index finds the dense groups, and MinHash bands
(``resemblance``) find the rest; every link is verified by the exact similarity.

Defined cases: null and wordless text has fingerprint 0 and is linked like any other; equal
rows are each returned; null doc_ids get the smallest doc_id they reach (null if none).
``keep_one``: wordless texts are one group; of unlike texts that share a doc_id, or have none,
each stays; of equal rows one; other columns pass, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallow.llm.common import Scratch, free_names, shuffle_partitions
from tallow.llm.graph import connected_components
from tallow.llm.resemblance import BANDS, MASK, ROWS, groups, multipliers
from tallow.llm.words import SPACED, slices, texts

DISTANCE = 3
SHINGLE = 3
#: Words of a shingle in ``keep_one``.
WIDE_SHINGLE = 5
SEED = 42
#: Shingles whose minima are taken, and texts whose sets are held, at once.
STEP, SETS = 1 << 13, 200
LEAF = 16
FANOUT = 8
BLOCKS = (13, 13, 13, 13, 12)


def shingle_hashes(text: bytes, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles of a text, in arrays of bounded size."""
    from xxhash import xxh64_intdigest

    carried: list[bytes] = []
    seen = False
    for part in slices(text.translate(SPACED)):
        words = carried + part.split()
        if len(words) >= size:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = np.concatenate([[0], ends[:-1]])[: len(words) - size + 1].tolist()
            yield np.array([xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, (ends[size - 1 :] - 1).tolist())], dtype=np.uint64)
            seen = True
            carried = words[len(words) - size + 1 :]
        else:
            carried = words
    if not seen and carried:
        yield np.array([xxh64_intdigest(b" ".join(carried), SEED)], dtype=np.uint64)


def fingerprint(shingles: Iterator[np.ndarray]) -> int:
    ones, total = np.zeros(64, dtype=np.int64), 0
    for hashes in shingles:
        total += len(hashes)
        for at in range(0, len(hashes), 1 << 15):
            part = hashes[at : at + (1 << 15)]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > total, bitorder="little").tobytes(), "little", signed=True) if total else 0


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (signed 64 bits) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(shingle_hashes(t)) for t in texts(batch.column(1))], pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def text_key(docs: DataFrame) -> Column:
    """What tells rows with one doc_id, or none, apart; null and empty text are equal."""
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))


def gray_rank(code: Column) -> Column:
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code


def masks() -> list[int]:
    """The pairs of blocks, as signed 64-bit masks."""
    at, blocks = 0, []
    for width in BLOCKS:
        blocks.append(((1 << width) - 1) << at)
        at += width
    pairs = [a | b for a, b in combinations(blocks, 2)]
    return [m - (1 << 64) if m >> 63 else m for m in pairs]


class GrayIndex:
    """The hierarchy over codes in Gray order; ``forest`` links those within ``distance``."""

    def __init__(self, codes: np.ndarray, distance: int):
        self.codes, self.distance = codes, distance
        # levels[0] are the codes; each level: start of its members below, shared bits, mask of those bits
        ands, ors = codes, codes
        shared: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        width = LEAF
        while len(ands) > 1:
            starts = np.arange(0, len(ands), width)
            ands, ors = np.bitwise_and.reduceat(ands, starts), np.bitwise_or.reduceat(ors, starts)
            shared.append((starts, ands, ~(ands ^ ors)))
            width = FANOUT
        self.levels = []  # from the root down: starts, pattern, the node's own bits
        above = np.zeros(1, dtype=np.uint64)
        for depth, (starts, pattern, mask) in enumerate(reversed(shared)):
            if depth:
                above = np.repeat(self.masks_above, self.sizes)
            self.levels.append((starts, pattern, mask & ~above))
            below = len(shared[-depth - 2][0]) if depth + 1 < len(shared) else len(codes)
            self.sizes = np.diff(np.append(starts, below))
            self.masks_above = mask
        self.leaf_bits = ~np.repeat(self.masks_above, self.sizes)

    def forest(self) -> np.ndarray:
        """The component of each code: the least position in it."""
        n = len(self.codes)
        labels = np.arange(n)
        step = max(256, n // 64)
        for at in range(0, n, step):
            found = self._search(np.arange(at, min(n, at + step)), labels)
            labels = unite(labels, *found)
        return labels

    def _search(self, queries: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, firsts, lows, highs = len(self.codes), [], labels, labels
        ranges = []
        for starts, _, _ in reversed(self.levels):
            lows, highs = np.minimum.reduceat(lows, starts), np.maximum.reduceat(highs, starts)
            ranges.append((lows, highs))
        ranges.reverse()
        left, right = [firsts], [firsts]
        for at in range(0, len(queries), 512):
            q = queries[at : at + 512]
            node, spent = np.zeros(len(q), dtype=np.int64), np.zeros(len(q), dtype=np.int64)
            for depth, (starts, pattern, own) in enumerate(self.levels):
                spent = spent + np.bitwise_count((self.codes[q] ^ pattern[node]) & own[node])
                low, high = ranges[depth]
                keep = (spent <= self.distance) & ~((low[node] == labels[q]) & (high[node] == labels[q]))
                q, node, spent = q[keep], node[keep], spent[keep]
                below = len(self.levels[depth + 1][0]) if depth + 1 < len(self.levels) else n
                first = starts[node]
                size = np.minimum(first + (FANOUT if depth + 1 < len(self.levels) else LEAF), below) - first
                q, spent = np.repeat(q, size), np.repeat(spent, size)
                node = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(size) else node
            spent = spent + np.bitwise_count((self.codes[q] ^ self.codes[node]) & self.leaf_bits[node])
            keep = (spent <= self.distance) & (node != q)
            left.append(q[keep])
            right.append(node[keep])
        return np.concatenate(left).astype(np.int64), np.concatenate(right).astype(np.int64)


def unite(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of labelled sets by the links a - b; labels stay least positions."""
    while len(a):
        la, lb = labels[a], labels[b]
        differ = la != lb
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while (labels[labels] != labels).any():
            labels = labels[labels]
    return labels


def links(groups: np.ndarray, codes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of each run of equal ``groups``."""
    starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    sizes = np.diff(np.append(starts, len(groups)))
    left, right = [], []
    small = np.repeat(sizes <= LEAF, sizes)  # one leaf
    for d in range(1, min(LEAF, sizes.max())):
        near = np.flatnonzero((groups[d:] == groups[:-d]) & small[d:])
        near = near[np.bitwise_count(codes[near] ^ codes[near + d]) <= distance]
        left.append(near)
        right.append(near + d)
    for start, size in zip(starts[sizes > LEAF].tolist(), sizes[sizes > LEAF].tolist()):
        labels = GrayIndex(codes[start : start + size], distance).forest()
        moved = np.flatnonzero(labels != np.arange(size))
        left.append(start + labels[moved])
        right.append(start + moved)
    empty = np.zeros(0, dtype=np.int64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def link_fingerprints(codes: DataFrame, distance: int = DISTANCE, partitions: int = 0) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that connect all within ``distance``."""
    tables = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks())]))
    dealt = codes.select("fp", tables.alias("t")).select(F.xxhash64("t.i", "t.key").alias("g"), "t.i", "t.key", "fp")
    dealt = dealt.repartition(partitions, "g") if partitions else dealt.repartition("g")
    dealt = dealt.sortWithinPartitions("g", "i", "key", gray_rank(F.col("fp"))).select("g", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_g, held_c = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)

        def found(groups: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
            a, b = links(groups, codes, distance) if len(groups) > 1 else (np.zeros(0, dtype=np.int64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(codes[a].view(np.int64)), pa.array(codes[b].view(np.int64))], names=["a", "b"])

        for batch in batches:
            held_g = np.concatenate([held_g, batch.column(0).to_numpy()])
            held_c = np.concatenate([held_c, batch.column(1).to_numpy().view(np.uint64)])
            last = int(np.searchsorted(held_g, held_g[-1])) if len(held_g) else 0  # the last group may go on
            if last:
                yield found(held_g[:last], held_c[:last])
                held_g, held_c = held_g[last:], held_c[last:]
        if len(held_g):
            yield found(held_g, held_c)

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(spark: SparkSession, docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp, component_id of every row of ``docs``."""
    scratch = Scratch(spark, "simhash")
    fps = scratch.table(fingerprints(docs), "fingerprints")
    codes = scratch.table(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "codes")
    roots = connected_components(spark, link_fingerprints(codes, distance, shuffle_partitions(spark)), scratch)
    rooted = codes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = scratch.table(rooted.join(least, "root").select("fp", "component_id"), "classes")
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")


def near_duplicate_digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id."""
    return near_duplicates(spark, docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: bytes) -> np.ndarray:
    """The distinct hashes of a text's five-word shingles."""
    return np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *shingle_hashes(text, WIDE_SHINGLE)]))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The keys of the bands of minima of a set; none of an empty one."""
    if not len(hashes):
        return np.zeros(0, dtype=np.int64)
    factors = np.array(multipliers(), dtype=np.uint64)
    x = hashes >> np.uint64(33)
    least = np.min([((x[at : at + STEP, None] * factors) & np.uint64(MASK)).min(axis=0) for at in range(0, len(x), STEP)], axis=0).reshape(BANDS, ROWS)
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.T:
        keys = (keys ^ column) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(np.concatenate(arrays).view(np.int64)))


def signed_texts(rows: DataFrame) -> DataFrame:
    """doc_id, key, fp, keys of rows doc_id, key, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, keys = [], []
            for text in texts(batch.column(2)):
                parts = list(shingle_hashes(text, WIDE_SHINGLE))
                fps.append(fingerprint(iter(parts)))
                keys.append(band_keys(np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *parts]))))
            if fps:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64()), lists(keys)], names=["doc_id", "key", "fp", "keys"])

    return rows.mapInArrow(run, "doc_id long, key long, fp long, keys array<long>")


def shingle_sets(rows: DataFrame) -> DataFrame:
    """h, side (distinct hashes), n of rows key, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SETS):
                part = batch.slice(at, SETS)
                yield pa.RecordBatch.from_arrays([part.column(0), lists([shingle_set(t) for t in texts(part.column(1))])], names=["h", "side"])

    return rows.mapInArrow(run, "h long, side array<long>").select("h", "side", F.size("side").alias("n"))


def resembling_rows(spark: SparkSession, docs: DataFrame, exhaustive: bool = False) -> DataFrame:
    """doc_id, key, root of every row of ``docs``: root names its group of similar texts."""
    scratch = Scratch(spark, "resembling")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(docs).alias("key"), F.col("text").cast("string").alias("text"))
    placed = scratch.table(signed_texts(rows), "placed")
    signed = scratch.table(placed.groupBy(F.col("key").alias("h")).agg(F.first("fp").alias("fp"), F.first("keys").alias("keys")), "signed")
    codes = scratch.table(signed.groupBy("fp").agg(F.min("h").alias("least")), "codes")
    same = signed.join(codes, "fp").select(F.col("h").alias("a"), F.col("least").alias("b"))
    near = link_fingerprints(codes, DISTANCE, shuffle_partitions(spark))
    for c in ("a", "b"):
        near = near.withColumnRenamed(c, "fp").join(codes, "fp").drop("fp").withColumnRenamed("least", c)

    def sides_of(wanted: DataFrame) -> DataFrame:
        return shingle_sets(rows.select("key", "text").dropDuplicates(["key"]).join(wanted, F.col("key") == F.col("h")).select("key", "text"))

    roots = groups(spark, signed.select("h", "keys"), sides_of, lambda side: side, scratch, same.union(near.select("a", "b")), exhaustive)
    placed = placed.select("doc_id", "key").join(roots.withColumnRenamed("node", "key"), "key", "left")
    return placed.select("doc_id", "key", F.coalesce("root", "key").alias("root"))


def keep_one(spark: SparkSession, docs: DataFrame, exhaustive: bool = False) -> DataFrame:
    """The rows of ``docs``, one of each group of similar texts: that with the smallest doc_id.

    Rows without a doc_id come last; the key of the text breaks ties, and of equal rows one stays.
    """
    rooted = resembling_rows(spark, docs, exhaustive)
    kept, key, text = free_names(docs, "kept", "key", "text_key")
    least = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("x"))
    chosen = Scratch(spark, "kept").table(least.select(F.col("x.doc_id").alias(kept), F.col("x.key").alias(key)), "kept")
    keyed = docs.withColumn(text, text_key(docs))
    joined = keyed.join(chosen, keyed["doc_id"].cast("long").eqNullSafe(chosen[kept]) & (keyed[text] == chosen[key]), "left_semi")
    return joined.dropDuplicates(["doc_id", text]).drop(text)
