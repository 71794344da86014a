"""The role of each driver table: nations are groups and regions, customers and suppliers are members of two kinds, orders and shipments are cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("customer", "supplier")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("ref"), F.lit("customer").alias("kind"), F.col("c_nationkey").cast("string").alias("group_id"))
    s = read(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ref"), F.lit("supplier").alias("kind"), F.col("s_nationkey").cast("string").alias("group_id"))
    return c.unionByName(s)


def cases(spark: SparkSession, sf_dir: str, fine: bool = True) -> DataFrame:
    """A case of the customer when a part's brand (and size) was ordered, and of the supplier when it was shipped."""
    code = F.concat_ws("-", "p_brand", F.col("p_size").cast("string")) if fine else F.col("p_brand")
    parts = read(spark, sf_dir, "part").select("p_partkey", code.alias("code"))
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    number = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("case_id")
    bought = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("ref"), "code", F.to_date("o_orderdate").alias("onset"), number)
    shipped = lines.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ref"), "code", F.to_date("l_shipdate").alias("onset"), number)
    return bought.unionByName(shipped)


def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


def monthly_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("nation"))
    o = read(spark, sf_dir, "orders").select("o_custkey", F.to_date(F.trunc("o_orderdate", "month")).alias("month"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("nation", "month").agg(F.count("*").alias("n"))


MEMBERS_SQL = """members AS (
  SELECT 'C' || c_custkey AS ref, 'customer' AS kind, CAST(c_nationkey AS VARCHAR) AS group_id FROM customer
  UNION ALL SELECT 'S' || s_suppkey, 'supplier', CAST(s_nationkey AS VARCHAR) FROM supplier)"""


def cases_sql(fine: bool = True) -> str:
    code = "p_brand || '-' || p_size" if fine else "p_brand"
    return f"""cases AS (
  SELECT 'C' || o_custkey AS ref, {code} AS code, CAST(o_orderdate AS DATE) AS onset, l_orderkey * 10 + l_linenumber AS case_id
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT 'S' || l_suppkey, {code}, CAST(l_shipdate AS DATE), l_orderkey * 10 + l_linenumber
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


DAILY_SQL = "daily AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2)"
MONTHLY_SQL = "monthly AS (SELECT CAST(c_nationkey AS VARCHAR) AS nation, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"
