"""Groups of resembling sets by MinHash, in DataFrame expressions only.

Items are sets of hashes; those of a Jaccard similarity of ``TIMES / OF`` (0.8) or more are
linked, and components of links are the groups. ``BANDS`` bands of ``ROWS`` minima put a pair
of similarity 0.8 into a common bucket with probability 0.9994 (1 - (1 - 0.8 ** 4) ** 14).
Large sets need fewer minima for that (``dealt_keys``): their hashes are dealt into ``PARTS``
parts and ``EACH`` minima are taken of each part, so that a hash meets four factors, not 56; a
band is one minimum of each of four parts. A pair of 0.8 and ``DEALT`` hashes or more has none of
these bands in common with probability 0.0005 at most (0.00024 from 150 hashes on).

At first an item of a bucket meets two others only, so that a large group of similar items is
united by 2n comparisons, not n squared: the first item of the bucket and the one before it.
Pairs are verified by the exact similarity and united, at first one pair an item (which joins
most of a large group), then the others that still lie in different components.

In buckets that then hold several components all pairs of different components are compared
(``close_pairs``), so that no pair of a common bucket is missed: by sketches that rule out only
pairs that cannot be similar, inside the join, and exactly where they do not. Only that many comparisons
of sketches grow with the square of a family of sets that are alike and yet under the similarity.

So a pair is missed where no band has it alone. With ``exhaustive`` such pairs among the items of
buckets that hold several components are found too: two similar sets share ``SHARED`` hashes
at least among the rarest fifth and ``SHARED`` more of each (prefix filter), and all pairs of different
components that share so many are verified.

Hot buckets (more than about ``HOT_SEEN`` of ``HOT_SAMPLE`` items; found in a sample, which steers
the cost and not the result) are not gathered in one task: their first and last item are found by
partial aggregation and broadcast, at most a few ten thousand rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallow.llm.common import Scratch
from tallow.llm.graph import connected_components

#: Jaccard 0.8 as a fraction.
TIMES, OF = 4, 5
BANDS, ROWS = 14, 4
#: Hashes of a set from which on its parts have minima; up to which the whole set (also) has.
DEALT, WHOLE = 80, 112
PARTS, EACH = 16, 4
#: Minima are taken of multiples of a 31-bit hash, modulo 2 ** 46.
MASK = (1 << 46) - 1
HOT_SAMPLE, HOT_SEEN, HOT_LEAST = 200_000, 32, 256
#: Words of 64 bits of an item's sketch (a power of two); items of a bucket that one task compares with the others.
WORDS, BLOCK = 16, 1024
#: Rare hashes that a similar pair must share; smaller sets must share as many as they can.
SHARED = 8
#: Items of the sample that finds frequent shingles, how many of them hold one, and how many such are sent out at most.
SAMPLE, FREQUENT, HELD = 8000, 3, 50_000


def multipliers() -> list[int]:
    """Odd 31-bit factors, one a minimum: every 46-bit product order is a permutation of its own."""
    factors, state = [], 1
    for _ in range(BANDS * ROWS):
        state = (state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        factors.append((state >> 33) | (1 << 30) | 1)
    return factors


def minima(x: Column, count: int = BANDS * ROWS) -> list[Column]:
    """Aggregates over hashes ``x`` (long, 31 bits): the least product under each factor."""
    return [F.min((x * F.lit(a)).bitwiseAND(F.lit(MASK))).alias(f"m{i}") for i, a in enumerate(multipliers()[:count])]


def band_keys() -> Column:
    """The bands' keys of a row of minima."""
    return F.array(*[F.xxhash64(F.lit(i), *[F.col(f"m{ROWS * i + j}") for j in range(ROWS)]) for i in range(BANDS)])


def whole_keys(hashes: DataFrame) -> DataFrame:
    """h, keys of rows h, x: the bands of minima over the whole set."""
    return hashes.groupBy("h").agg(*minima(F.col("x"))).select("h", band_keys().alias("keys"))


def dealt_keys(hashes: DataFrame) -> DataFrame:
    """h, keys, seen, alone of rows h, x, alone, four rows a set: the bands of minima over its parts.

    The sum of ``seen`` over a set's rows is no more than its distinct hashes. ``alone``: the set has no other keys.
    """
    part = F.col("x").bitwiseAND(F.lit(PARTS - 1)).cast("int") + F.when(F.col("alone"), F.lit(PARTS)).otherwise(F.lit(0))
    bit = F.expr("shiftleft(1L, cast(shiftright(x, 4) & 63 AS int))")
    parts = hashes.select("h", "x", part.alias("part"), bit.alias("bit")).groupBy("h", "part").agg(*minima(F.col("x"), EACH), F.bit_or("bit").alias("seen"))
    own = F.col("part").bitwiseAND(F.lit(PARTS - 1))
    keys = [F.bit_xor(F.xxhash64(F.lit(BANDS + i), own, F.col(f"m{i}"))).alias(f"k{i}") for i in range(EACH)]
    bands = parts.groupBy("h", F.floor(F.col("part") / ROWS).cast("int").alias("band")).agg(*keys, F.sum(F.bit_count("seen")).alias("seen"))
    return bands.select("h", F.array(*[f"k{i}" for i in range(EACH)]).alias("keys"), "seen", (F.col("band") >= PARTS // ROWS).alias("alone"))


def with_few(dealt: DataFrame) -> DataFrame:
    """h of the sets without other keys that may be similar to sets of fewer than ``DEALT`` hashes."""
    return dealt.filter("alone").groupBy("h").agg(F.sum("seen").alias("seen")).filter(TIMES * F.col("seen") <= OF * DEALT).select("h")


def hot_keys(signed: DataFrame) -> list[int]:
    """Keys of buckets too large for one task; bounded by the sample."""
    every = max(1, signed.count() // HOT_SAMPLE)
    sample = signed.filter(F.pmod(F.xxhash64("h", F.lit(1)), F.lit(every)) == 0).select(F.explode("keys").alias("key"))
    seen = sample.groupBy("key").count().filter(F.col("count") >= max(HOT_SEEN, HOT_LEAST // every))
    return [r["key"] for r in seen.collect()]


def shared_buckets(spark: SparkSession, signed: DataFrame) -> DataFrame:
    """h, key, head, before of the items that share a bucket; ``before`` is null for the first."""
    rows = signed.select("h", F.explode("keys").alias("key"))
    hot = spark.createDataFrame([(k,) for k in hot_keys(signed)], "key long")
    window = Window.partitionBy("key").orderBy(F.col("h").bitwiseXOR(F.col("key")))
    cold = rows.join(F.broadcast(hot), "key", "left_anti").select(
        "h", "key", F.first("h").over(window).alias("head"), F.lag("h").over(window).alias("before"), F.lead("h").over(window).alias("after")
    )
    cold = cold.filter("before IS NOT NULL OR after IS NOT NULL").drop("after")
    large = rows.join(F.broadcast(hot), "key", "left_semi")
    mixed = F.col("h").bitwiseXOR(F.col("key"))
    ends = large.groupBy("key").agg(F.min(mixed).bitwiseXOR(F.col("key")).alias("head"), F.max(mixed).bitwiseXOR(F.col("key")).alias("before"))
    return cold.union(large.join(F.broadcast(ends), "key").select("h", "key", "head", "before"))


def ordered(one: str, other: str) -> list[Column]:
    return [F.least(one, other).alias("a"), F.greatest(one, other).alias("b")]


def verified(pairs: DataFrame, sides: DataFrame, to_hashes: Callable[[Column], Column]) -> DataFrame:
    """a, b, linked of the pairs whose sizes allow a link.

    ``sides`` (h, side, n) holds what ``to_hashes`` makes the hashes of a set of ``n`` of. A
    column a step, so that each is evaluated once; filter the written result.
    """
    left, right = (sides.select(F.col("h").alias(x), F.col("side").alias(f"side_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b").filter(OF * F.least("n_a", "n_b") >= TIMES * F.greatest("n_a", "n_b"))
    both = both.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("sizes"), to_hashes(F.col("side_a")).alias("side_a"), to_hashes(F.col("side_b")).alias("side_b"))
    met = both.select("a", "b", "sizes", F.size(F.array_intersect("side_a", "side_b")).alias("n"))
    return met.select("a", "b", (OF * F.col("n") >= TIMES * (F.col("sizes") - F.col("n"))).alias("linked"))


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose items are not in one component yet."""
    for c in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")), c, "left").withColumn(f"r{c}", F.coalesce(f"r{c}", c))
    return pairs.filter("ra <> rb").select("a", "b")


def frequent(items: DataFrame) -> DataFrame:
    """x, seen: hashes that many items of a sample hold; bounded, to be broadcast.

    It orders the prefixes alone: a hash that is not among them counts as rare, and any order finds the same pairs.
    """
    every = max(1, items.count() // SAMPLE)
    sample = items.filter(F.pmod(F.xxhash64("h", F.lit(2)), F.lit(every)) == 0).select(F.explode("set").alias("x"))
    return sample.groupBy("x").agg(F.count("*").alias("seen")).filter(F.col("seen") >= FREQUENT).orderBy(F.desc("seen"), "x").limit(HELD)


def still_open(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """h, key, root of the buckets that hold several components."""
    held = rows.select("h", "key").join(roots.withColumnRenamed("node", "h"), "h", "left").withColumn("root", F.coalesce("root", "h"))
    several = held.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least < most").select("key")
    return held.join(several, "key", "left_semi")


def sketches(items: DataFrame, to_hashes: Callable[[Column], Column]) -> DataFrame:
    """h, n and ``WORDS`` words of a parity sketch: bit x mod 64 * WORDS is odd where the set holds an odd number of such x.

    Two sketches differ in the sketch of the sets' symmetric difference, so in no more bits than it has members.
    """
    rows = items.select("h", "n", F.explode(F.array_distinct(to_hashes(F.col("side")))).alias("x"))
    word = F.shiftright("x", 6).bitwiseAND(F.lit(WORDS - 1))
    bit = F.expr("shiftleft(1L, cast(x & 63 AS int))")
    return rows.groupBy("h").agg(F.first("n").alias("n"), *[F.bit_xor(F.when(word == i, bit).otherwise(F.lit(0).cast("long"))).alias(f"w{i}") for i in range(WORDS)])


def close_pairs(held: DataFrame, sides: DataFrame, to_hashes: Callable[[Column], Column], scratch: Scratch) -> DataFrame:
    """a, b: all pairs of a bucket in different components, without those whose sketches rule out a link.

    Items of the bucket's largest component meet only those outside it. Buckets of more than
    ``BLOCK`` items are dealt out in blocks. The join's condition compares, so that only pairs
    that are (nearly always) to be linked become rows.
    """
    sketched = scratch.table(sketches(held.select("h").distinct().join(sides, "h"), to_hashes), "sketches")
    largest = held.groupBy("key", "root").agg(F.count("*").alias("m")).groupBy("key")
    largest = largest.agg(F.max(F.struct("m", "root"))["root"].alias("main"), F.ceil(F.sum("m") / BLOCK).cast("int").alias("blocks"))
    rows = held.join(largest, "key").join(sketched, "h").withColumn("inside", F.col("root") == F.col("main")).drop("main")
    one = rows.filter("NOT inside").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks", "inside")
    other = rows.withColumn("block", F.pmod(F.xxhash64("h", F.lit(3)), F.col("blocks")).cast("int")).drop("blocks")
    a, b = (df.select(*[F.col(c).alias(f"{c}_{side}") for c in df.columns]) for df, side in ((one, "a"), (other, "b")))
    n_a, n_b = F.col("n_a"), F.col("n_b")
    once = (F.col("root_a") != F.col("root_b")) & (F.col("inside_b") | (F.col("h_a") < F.col("h_b")))
    sizes = (OF * n_a >= TIMES * n_b) & (OF * n_b >= TIMES * n_a)
    unlike = sum((F.bit_count(F.col(f"w{i}_a").bitwiseXOR(F.col(f"w{i}_b"))) for i in range(1, WORDS)), F.bit_count(F.col("w0_a").bitwiseXOR(F.col("w0_b"))))
    met = a.join(b, (F.col("key_a") == F.col("key_b")) & (F.col("block_a") == F.col("block_b")) & once & sizes & ((OF + TIMES) * unlike <= (OF - TIMES) * (n_a + n_b)))
    return met.select(*ordered("h_a", "h_b")).distinct()


def least_overlap(n: Column) -> Column:
    """Hashes that a set of ``n`` shares with any similar one at least."""
    return F.ceil(n * F.lit(TIMES) / F.lit(OF) - F.lit(1e-9)).cast("int")


def prefixes(items: DataFrame, often: DataFrame) -> DataFrame:
    """x, n, h, root: the hashes of which similar sets must share some, the rare ones first."""
    dealt = items.repartition("h").select("h", "root", F.explode("set").alias("x")).join(F.broadcast(often), "x", "left")
    sets = dealt.groupBy("h").agg(F.first("root").alias("root"), F.sort_array(F.collect_list(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "x"))).alias("set"))
    n = F.size("set")
    rows = sets.select("h", "root", n.alias("n"), F.explode(F.slice("set", F.lit(1), n - least_overlap(n) + F.least(F.lit(SHARED), least_overlap(n)))).alias("s"))
    return rows.select(F.col("s.x").alias("x"), "n", "h", "root")


def open_pairs(held: DataFrame, sides: DataFrame, to_hashes: Callable[[Column], Column], scratch: Scratch) -> DataFrame:
    """a, b of different components, of the items whose buckets hold several, that share enough rare hashes."""
    items = scratch.table(held.select("h", "root").distinct().join(sides, "h").select("h", "root", F.array_distinct(to_hashes(F.col("side"))).alias("set")), "items")
    posted = scratch.table(prefixes(items, scratch.table(frequent(items), "frequent")), "prefixes")
    mixed = posted.groupBy("x").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least < most").select("x")
    posted = scratch.table(posted.join(mixed, "x", "left_semi"), "mixed")
    a, b = (posted.select("x", *[F.col(c).alias(f"{c}_{side}") for c in ("n", "h", "root")]) for side in "ab")
    smaller = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("h_a") < F.col("h_b")))
    both = a.join(b, (a["x"] == b["x"]) & smaller & (F.col("root_a") != F.col("root_b")) & (OF * F.col("n_a") >= TIMES * F.col("n_b")))
    met = both.groupBy("h_a", "h_b").agg(F.count("*").alias("shared"), F.first("n_a").alias("n_a"))
    return met.filter(F.col("shared") >= F.least(F.lit(SHARED), least_overlap(F.col("n_a")))).select(*ordered("h_a", "h_b"))


def groups(
    spark: SparkSession,
    signed: DataFrame,
    sides_of: Callable[[DataFrame], DataFrame],
    to_hashes: Callable[[Column], Column],
    scratch: Scratch,
    known: DataFrame | None = None,
    exhaustive: bool = False,
) -> DataFrame:
    """node, root of every item that is linked to another; root is the least item of the group.

    ``signed``: a written table h, keys of one or more rows an item. ``sides_of`` gives (h, side, n) for a table of wanted h.
    ``known``: pairs a, b from elsewhere that are verified first.
    """
    rows = scratch.table(shared_buckets(spark, signed), "buckets")
    wanted = rows.select("h")
    first = rows.filter("h <> head").groupBy("h").agg(F.min("head").alias("head")).select(*ordered("h", "head"))
    if known is not None:
        known = scratch.table(known.filter("a <> b").select(*ordered("a", "b")).distinct(), "known")
        wanted = wanted.union(known.select("a")).union(known.select("b"))
        first = first.union(known)
    sides = scratch.table(sides_of(wanted.distinct()), "sides")
    links = roots = tried = None

    def meet(pairs: DataFrame, name: str) -> bool:
        """Verify pairs that were not tried and unite what they link."""
        nonlocal links, roots, tried
        if tried is not None:
            pairs = apart(pairs, roots).join(tried, ["a", "b"], "left_anti")
        pairs = scratch.table(pairs, f"pairs-{name}")
        found = scratch.table(verified(pairs, sides, to_hashes), f"links-{name}").filter("linked").select("a", "b")
        tried = pairs if tried is None else tried.union(pairs)
        if roots is not None and found.isEmpty():
            return False
        links = found if links is None else links.union(found)
        roots = scratch.table(connected_components(spark, links, scratch), f"roots-{name}")
        return True

    meet(first.distinct(), "first")
    rest = rows.select("h", F.explode(F.array("head", "before")).alias("other")).filter("h <> other").select(*ordered("h", "other"))
    meet(rest.distinct(), "rest")
    held = scratch.table(still_open(rows, roots), "open-buckets")
    meet(close_pairs(held, sides, to_hashes, scratch), "close")
    if exhaustive:
        held = scratch.table(still_open(rows, roots), "open")
        meet(open_pairs(held, sides, to_hashes, scratch), "all")
    return roots
