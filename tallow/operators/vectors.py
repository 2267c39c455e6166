"""Vectors as arrays: alignment with directions, means, stability, first principal direction."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def mean_vectors(rows: DataFrame, by: str, vector: str) -> DataFrame:
    """The mean vector of each group, as (by, idx, mean) rows."""
    flat = rows.select(by, F.posexplode(vector).alias("idx", "v"))
    return flat.groupBy(by, "idx").agg(F.avg(F.col("v").cast("double")).alias("mean"))


def as_arrays(flat: DataFrame, by: str) -> DataFrame:
    """The size of a vector, not of the data, bounds each array."""
    return flat.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("idx", "mean"))).alias("x")).select(by, F.transform("x", lambda s: s["mean"]).alias("direction"))


def alignment(rows: DataFrame, directions: DataFrame, key: str, vector: str, total: bool = False) -> DataFrame:
    """Mean (or sum) over the directions of the inner product; the directions are a row a layer."""
    scored = rows.crossJoin(F.broadcast(directions)).withColumn("_d", dot(F.col(vector), F.col("direction")))
    return scored.groupBy(key).agg((F.sum("_d") if total else F.avg("_d")).alias("align"))


def moments(rows: DataFrame, by: str, vector: str) -> DataFrame:
    """by, n, mean, second (the upper triangle of the mean products): sums made in the JVM, a row a group."""
    flat = rows.select(by, F.posexplode(vector).alias("i", "x"), vector).select(by, "i", F.col("x").cast("double").alias("x"), F.posexplode(vector).alias("j", "y")).filter("i <= j")
    cells = flat.groupBy(by, "i", "j").agg(F.avg(F.col("x") * F.col("y").cast("double")).alias("xy"), F.avg("x").alias("mx"), F.count("*").alias("n"))
    return cells.groupBy(by).agg(
        F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.when(F.col("i") == F.col("j"), F.struct("i", "mx")))), lambda c: c["mx"]).alias("mean"),
        F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "xy"))), lambda c: c["xy"]).alias("second"),
    )


def principal(rows: DataFrame, by: str, vector: str) -> DataFrame:
    """by, direction, mean, lambda1, lambda2 of each group's covariance; the direction agrees with the mean.

    Products are summed by dimension pair over all rows; only a group's matrix meets in one task.
    """
    import numpy as np

    def fit(batches):
        for pdf in batches:
            found = []
            for key, mean, second in zip(pdf[by], pdf["mean"], pdf["second"]):
                m = np.asarray(mean, dtype=np.float64)
                matrix = np.zeros((len(m), len(m)))
                matrix[np.triu_indices(len(m))] = second
                matrix = matrix + np.triu(matrix, 1).T - np.outer(m, m)
                values, vectors = np.linalg.eigh(matrix)
                first = vectors[:, -1] * (1.0 if vectors[:, -1] @ m >= 0 else -1.0)
                found.append((key, first.tolist(), m.tolist(), float(values[-1]), float(values[-2]) if len(m) > 1 else 0.0))
            yield pd.DataFrame(found, columns=[by, "direction", "mean", "lambda1", "lambda2"])

    kind = rows.schema[by].dataType.simpleString()
    return moments(rows, by, vector).mapInPandas(fit, f"{by} {kind}, direction array<double>, mean array<double>, lambda1 double, lambda2 double")


def signed(directions: DataFrame, previous: DataFrame | None, by: str) -> DataFrame:
    """Directions turned to agree with the previous epoch's, or with the mean where there is none."""
    if previous is None:
        held = directions.withColumn("_old", F.lit(None).cast("array<double>"))
    else:
        held = directions.join(previous.select(by, F.col("direction").alias("_old")), by, "left")
    turn = dot(F.col("direction"), F.coalesce("_old", "mean")) < 0
    return held.withColumn("direction", F.when(turn, F.transform("direction", lambda x: -x)).otherwise(F.col("direction"))).drop("_old")


def stability(now: DataFrame, before: DataFrame, by: str) -> DataFrame:
    """Mean distance of the directions from the epoch before (null where the layers differ) and mean eigengap."""
    both = now.select(by, "direction", (F.col("lambda1") - F.col("lambda2")).alias("gap")).join(before.select(by, F.col("direction").alias("old")), by, "full")
    far = norm(difference(F.col("direction"), F.col("old")))
    whole = F.count("direction") == F.count("*")
    return both.agg(F.when(whole & (F.count("old") == F.count("*")), F.avg(far)).alias("stability"), F.avg("gap").alias("gap"))


def weighted_stability(cosines: DataFrame) -> DataFrame:
    """Mean |cosine| weighted by the eigengap."""
    return cosines.agg((F.sum(F.abs("cosine") * F.col("gap")) / F.sum("gap")).alias("stability"))
