"""Places, running sums and percentiles over a whole table, without one task that sorts it all.

For places and sums, rows are dealt by ranges of the order, so that range i holds what comes before range i + 1; each
range numbers its own rows, and the ranges' totals (a row a range) are added up and joined back.
The dealt rows are checkpointed, since ranges are sampled and must be the same for both uses.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallow.plans.checkpoints import cut

#: Tables of at most so many rows are numbered in one task, which costs less than dealing them out.
SMALL = 100_000

#: Of approximate percentiles, one over their error; and how far from a share they are taken, the last for all values.
ACCURACY, MARGINS = 5000, (0.001, 0.02, 1.0)


def running(rows: DataFrame, order: list[Column | str], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with the running sum of each of ``sums`` in ``order``, which must tell all rows apart."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    upto = (Window.unboundedPreceding, Window.currentRow)
    if rows.limit(SMALL + 1).count() <= SMALL:
        return rows.withColumns({name: F.sum(x).over(Window.orderBy(*order).rowsBetween(*upto)) for name, x in sums.items()})
    dealt = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(*upto)
    totals = dealt.groupBy("_range").agg(*[F.sum(x).alias(f"_t_{name}") for name, x in sums.items()])
    before = Window.orderBy("_range")  # a row a range
    totals = totals.select("_range", *[(F.sum(f"_t_{name}").over(before) - F.col(f"_t_{name}")).alias(f"_b_{name}") for name in sums])
    out = dealt.withColumns({name: F.sum(x).over(own) for name, x in sums.items()}).join(F.broadcast(totals), "_range")
    return out.withColumns({name: F.col(name) + F.col(f"_b_{name}") for name in sums}).drop("_range", *[f"_b_{name}" for name in sums])


def numbered(rows: DataFrame, order: list[Column | str], out: str) -> DataFrame:
    """``rows`` with their place in ``order``, from 0."""
    return running(rows, order, {out: F.lit(1).cast("long")}).withColumn(out, F.col(out) - 1)


def percentiles(rows: DataFrame, column: str, shares: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, share, value, lower): exact interpolated percentiles of a column, and the values at or below their places.

    Nulls are left out; no row for an empty group. Groups and shares are few, and ``rows`` are read
    more than once. Approximate percentiles on both sides of a share bound the values whose places
    are found; what lies below is only counted. Should the two values not lie between the bounds, wider ones are taken,
    in the end the least and the greatest value.
    """
    spark, by = rows.sparkSession, list(by)
    values = rows.filter(F.col(column).isNotNull()).select(*by, F.col(column).cast("double").alias("_x"))
    keys = StructType([values.schema[c] for c in by])
    field = ", ".join(f"_{c} double" for c in ("share", "at", "from", "to"))
    wanted_schema = StructType([*keys, *StructType.fromDDL(field)])
    found, missing = [], None
    for margin in MARGINS:
        around = [min(1.0, max(0.0, float(q) + m)) for q in shares for m in (-margin, margin)]
        bounds = F.array(F.min("_x"), F.max("_x")) if margin >= 1 else F.percentile_approx("_x", F.array(*map(F.lit, around)), ACCURACY)
        wanted = []
        for r in values.groupBy(*by).agg(F.count("*").alias("_all"), bounds.alias("_bounds")).collect():  # a row a group
            key = tuple(r[c] for c in by)
            for i, q in enumerate(map(float, shares)):
                if r["_all"] and (missing is None or (key, q) in missing):
                    wanted.append((*key, q, q * (r["_all"] - 1), *(r["_bounds"] if margin >= 1 else r["_bounds"][2 * i : 2 * i + 2])))
        if not wanted:
            break
        few = F.broadcast(spark.createDataFrame(wanted, wanted_schema).withColumnsRenamed({c: f"_by_{c}" for c in by}))
        near = values.crossJoin(few) if not by else values.join(few, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]))
        group = [*by, "_share", "_at"]
        counts = near.filter(F.col("_x") <= F.col("_to")).groupBy(*group, F.when(F.col("_x") >= F.col("_from"), F.col("_x")).alias("_x")).agg(F.count("*").alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy(*group).orderBy(F.asc_nulls_first("_x")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        placed = counts.withColumn("_upto", upto).filter(F.col("_x").isNotNull())
        low = F.max(F.when(F.col("_upto") - F.col("_n") <= F.floor("_at"), F.struct("_x", "_upto")))
        high = F.min(F.when(F.col("_upto") > F.ceil("_at"), F.col("_x")))
        hits = placed.groupBy(*group).agg(low.alias("_low"), high.alias("_high"))
        hits = hits.filter((F.col("_low._upto") > F.floor("_at")) & F.col("_high").isNotNull())
        lower, rest = F.col("_low._x"), F.col("_at") - F.floor("_at")
        got = hits.select(*by, F.col("_share").alias("share"), F.when(F.col("_high") == lower, lower).otherwise(lower + (F.col("_high") - lower) * rest).alias("value"), lower.alias("lower")).collect()  # a row a group and share
        found += map(tuple, got)
        missing = {(tuple(w[: len(by)]), w[len(by)]) for w in wanted} - {(tuple(g[: len(by)]), g[len(by)]) for g in got}
    return spark.createDataFrame(found, StructType([*keys, *StructType.fromDDL("share double, value double, lower double")]))
