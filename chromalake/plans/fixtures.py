"""The driver's tables seen as fragments, genes, counts, cells and embeddings; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEQNAMES = ("click", "error", "purchase", "signup", "view")
EPOCH = 1704067200  # 2024-01-01
SPAN = 2_592_000


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def fragments(spark: SparkSession, d: str) -> DataFrame:
    """Events: type as chromosome, whole seconds as start, value as length, user as barcode."""
    start = F.expr(f"timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz))").cast("long")
    return table(spark, d, "events").select(
        F.concat(F.lit("S"), F.col("user_id") % 4).alias("sample"), F.col("event_type").alias("chrom"), start.alias("start"),
        (start + F.floor("value").cast("long") + 1).alias("end"), F.concat(F.lit("B"), "user_id").alias("barcode"))


FRAGMENTS = f"""(SELECT 'S' || (user_id % 4) AS sample, event_type AS chrom, (floor(epoch(ts))::BIGINT - {EPOCH}) AS "start",
  (floor(epoch(ts))::BIGINT - {EPOCH}) + floor(value)::BIGINT + 1 AS "end", 'B' || user_id AS barcode,
  'S' || (user_id % 4) || '#' || 'B' || user_id AS cell_id, event_id FROM events)"""


def genes(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    start = (k * 7919) % SPAN + 1
    return table(spark, d, "orders").select(
        F.concat(F.lit("G"), k).alias("name"), F.element_at(F.array(*map(F.lit, SEQNAMES)), (k % 5 + 1).cast("int")).alias("seqname"),
        start.alias("start"), (start + 50 + c % 200).alias("end"), F.when(c % 2 == 1, "-").otherwise("+").alias("strand"))


GENES = f"""(SELECT 'G' || o_orderkey AS name, ['click', 'error', 'purchase', 'signup', 'view'][(o_orderkey % 5 + 1)::INT] AS seqname,
  (o_orderkey * 7919) % {SPAN} + 1 AS "start", (o_orderkey * 7919) % {SPAN} + 1 + 50 + o_custkey % 200 AS "end",
  CASE WHEN o_custkey % 2 = 1 THEN '-' ELSE '+' END AS strand FROM orders)"""


def counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("feature_id"), F.col("l_suppkey").cast("string").alias("cell_id")).agg(F.count(F.lit(1)).alias("value"))


COUNTS = "(SELECT l_partkey AS feature_id, l_suppkey::VARCHAR AS cell_id, count(*)::BIGINT AS value FROM lineitem GROUP BY ALL)"


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as cells, their region as sample, their line items as depth, their nation as cluster."""
    depth = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("fragments"))
    place = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey")).join(depth, "s_suppkey", "left").select(
        F.col("s_suppkey").cast("string").alias("cell_id"), F.col("r_name").alias("sample"), F.coalesce("fragments", F.lit(0)).alias("fragments"),
        F.col("n_name").alias("cluster"), F.col("s_acctbal").alias("balance"))


CELLS = """(SELECT s_suppkey::VARCHAR AS cell_id, r_name AS sample, coalesce(f, 0)::BIGINT AS fragments, n_name AS cluster, s_acctbal AS balance
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN (SELECT l_suppkey, count(*) f FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey)"""


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("cell_id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), F.col("label").alias("cluster"))
