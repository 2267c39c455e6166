"""Near-duplicate clusters of texts: MinHash, bands, exact Jaccard, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallow.functions.text import shingles

PERMUTATIONS, ROWS = 64, 4
PRIME = (1 << 31) - 1


def parameters(n: int = PERMUTATIONS, seed: int = 42) -> list[tuple[int, int]]:
    import hashlib

    draw = [int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:15], 16) for i in range(2 * n)]
    return [(1 + a % (PRIME - 1), b % PRIME) for a, b in zip(draw[::2], draw[1::2])]


def shingle_sets(rows: DataFrame, key: str, text: str, k: int = 3) -> DataFrame:
    return rows.select(key, shingles(F.col(text), k).alias("set"))


def signatures(sets: DataFrame, key: str) -> DataFrame:
    """One minimum a permutation, in one aggregation over the exploded shingles."""
    x = F.conv(F.substring(F.md5("s"), 1, 7), 16, 10).cast("bigint")
    flat = sets.select(key, F.explode("set").alias("s")).select(key, x.alias("x"))
    return flat.groupBy(key).agg(*[F.min((F.col("x") * a + b) % PRIME).alias(f"m{i}") for i, (a, b) in enumerate(parameters())])


def candidates(signed: DataFrame, key: str) -> DataFrame:
    """a < b: each member of a band's bucket with the bucket's least member."""
    bands = [F.struct(F.lit(i).alias("band"), F.xxhash64(*[F.col(f"m{i * ROWS + j}") for j in range(ROWS)]).alias("h")) for i in range(PERMUTATIONS // ROWS)]
    rows = signed.select(key, F.explode(F.array(*bands)).alias("b")).select(key, "b.band", "b.h")
    heads = rows.groupBy("band", "h").agg(F.min(key).alias("a"), F.count("*").alias("n")).filter("n > 1")
    return rows.join(heads, ["band", "h"]).filter(F.col(key) > F.col("a")).select("a", F.col(key).alias("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, key: str, threshold: float) -> DataFrame:
    a, b = sets.select(F.col(key).alias("a"), F.col("set").alias("sa")), sets.select(F.col(key).alias("b"), F.col("set").alias("sb"))
    both = pairs.join(a, "a").join(b, "b")
    return both.withColumn("jaccard", F.size(F.array_intersect("sa", "sb")) / F.size(F.array_union("sa", "sb"))).filter(F.col("jaccard") >= threshold).select("a", "b", "jaccard")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) by propagating least labels; every round is a checkpoint in the shared folder."""
    from tallow.plans.checkpoints import cut

    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a"))
    labels, changed = cut(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("root"))), True
    while changed:
        offered = both.join(labels, both["y"] == labels["node"]).groupBy(F.col("x").alias("n")).agg(F.min("root").alias("r"))
        new = cut(labels.join(offered, labels["node"] == offered["n"]).select("node", F.least("root", "r").alias("root"), (F.col("r") < F.col("root")).alias("moved")))
        changed = not new.filter("moved").isEmpty()
        labels = new.drop("moved")
    return labels


def clusters(rows: DataFrame, key: str, text: str, threshold: float = 0.8) -> DataFrame:
    """(key, cluster_id): the least key of the row's component, -1 for rows without a near duplicate."""
    from tallow.plans.checkpoints import cut

    sets = cut(shingle_sets(rows, key, text))
    roots = components(cut(verified(candidates(signatures(sets, key), key), sets, key, threshold)))
    return sets.select(key).join(roots, F.col(key) == roots["node"], "left").select(key, F.coalesce("root", F.lit(-1)).alias("cluster_id"))
