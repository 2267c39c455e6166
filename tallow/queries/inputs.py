"""The driver's tables seen as the engine's inputs; the SQL holds for Spark and the oracle alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallow.operators.ranks import SMALL

TOKENS = """SELECT l_orderkey AS pool_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 AS pos,
  l_extendedprice / 10000 AS cf,
  (l_extendedprice / 10000) * (1 - l_discount * (1 + l_tax) * l_quantity / 30) AS tr,
  (l_extendedprice / 10000) * (1 - l_tax * l_quantity / 20) AS tr2
FROM lineitem"""

SIGNALS = """SELECT o_orderkey AS pool_id, o_custkey AS cluster_id, o_orderstatus AS type, o_orderpriority AS bench, l.loss, l.entropy,
  round(o_totalprice / 100000, 8) AS align_raw, l.n_tokens
FROM orders JOIN (SELECT l_orderkey, round(avg(l_extendedprice) / 10000, 10) AS loss, round(coalesce(stddev_pop(l_extendedprice), 0) / 10000, 9) AS entropy,
  count(*) AS n_tokens FROM lineitem GROUP BY l_orderkey) l ON o_orderkey = l.l_orderkey"""

#: Documents with their labels: quality 0 is dirty.
LABELLED = """SELECT d.doc_id AS pool_id, d.text, d.lang, d.source, d.n_chars, CASE WHEN l.quality = 0 THEN 1 ELSE 0 END AS dirty,
  CASE WHEN l.quality = 0 AND l.toxic = 1 THEN 'toxic' WHEN l.quality = 0 THEN 'noisy' ELSE 'clean' END AS type, round(1e0 / (1 + d.n_chars % 997), 6) AS score
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""

#: A user turn and the assistant turn after it.
PAIRS = """SELECT u.conv_id * 1000 + u.turn AS pool_id, u.text AS instruction, '' AS input, a.text AS output
FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'"""

#: Results of training runs.
RUNS = """SELECT r_name AS set_key, n_name AS model, c_mktsegment AS method, c_custkey % 5 AS seed, c_custkey % 7 AS bench, 50 + c_acctbal / 333.7 AS accuracy
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables of more than SMALL rows are numbered in so many shares of their records, so that a shuffle carries one share.
SHARES = 4


def token_shares(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The columns pool_id, pos, tr and cf of TOKENS, in shares by record that hold every record once.

    Losses are found after the numbering: the shuffle carries lineitem's columns alone, and what is
    grouped by record afterwards needs none of its own.
    """
    lines = table(spark, sf_dir, "lineitem")
    shares = 1 if lines.limit(SMALL + 1).count() <= SMALL else SHARES
    price = F.col("l_extendedprice") / 10000
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    out = []
    for i in range(shares):
        own = lines.filter(F.pmod(F.xxhash64("l_orderkey"), F.lit(shares)) == i) if shares > 1 else lines
        own = own.withColumn("pos", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)) - 1)
        tr = price * (1 - F.col("l_discount") * (1 + F.col("l_tax")) * F.col("l_quantity") / 30)
        out.append(own.select(F.col("l_orderkey").alias("pool_id"), "pos", price.alias("cf"), tr.alias("tr")))
    return out


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """``sql`` over the tables it names; no view outlives the call by name."""
    import re
    import zlib

    tag = f"t{zlib.crc32(sf_dir.encode()):08x}_"
    for name in TABLES:
        if re.search(rf"\b{name}\b", sql):
            table(spark, sf_dir, name).createOrReplaceTempView(tag + name)
            sql = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {tag}{name}", sql)
    return spark.sql(sql)
