"""The project ledger bound to the star-schema tables: Spark frames, and the same as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Projects that start before this day are outside the study period of the test tables.
FLOOR = "1995-07-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def places(spark: SparkSession, d: str) -> DataFrame:
    """Order, its municipality (nation of the customer) and cluster (region)."""
    nation = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.expr("n_regionkey = r_regionkey"))
    customer = table(spark, d, "customer").join(F.broadcast(nation), F.expr("c_nationkey = n_nationkey"))
    return table(spark, d, "orders").join(customer, F.expr("o_custkey = c_custkey")).select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus", "c_custkey", F.col("n_name").alias("municipality"), F.col("r_name").alias("cluster"))


def monitoring(spark: SparkSession, d: str, linked: DataFrame | None = None) -> DataFrame:
    """One monitored row per order line. Dates linked to orders (order_id, linked) join while the lines lie by order."""
    lines = table(spark, d, "lineitem").join(places(spark, d), F.expr("l_orderkey = o_orderkey"))
    if linked is not None:
        lines = lines.join(linked.withColumnRenamed("order_id", "_order"), F.expr("l_orderkey = _order"), "left")
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    return (
        lines.join(part, F.expr("l_partkey = p_partkey"))
        .select(
            F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("mon_row_id"),
            F.col("l_orderkey").alias("order_id"),
            F.col("p_name").alias("name"),
            F.col("l_extendedprice").alias("amount"),
            F.col("o_orderdate").cast("timestamp").alias("released"),
            F.col("l_shipdate").cast("timestamp").alias("monitored"),
            F.expr("case when l_linestatus = 'F' then cast(l_shipdate as timestamp) end").alias("completed"),
            F.expr("case l_returnflag when 'A' then 'Completed/ Fuctional' when 'N' then 'On-going' else 'For refund of full amount' end").alias("status"),
            F.expr("case when l_linenumber = 7 then 'Delayed by typhoon' else 'No remarks' end").alias("remarks"),
            F.expr("case when p_type in ('LARGE', 'STANDARD', 'MEDIUM') then 'Infrastructure' when p_type in ('SMALL', 'ECONOMY') then 'Non-Infrastructure' else 'Unclassified' end").alias("project_type"),
            "municipality",
            "cluster",
            *(["linked"] if linked is not None else []),
        )
    )


def liquidation(spark: SparkSession, d: str) -> DataFrame:
    """Linked liquidation dates: each line of an order."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_shipdate").cast("timestamp").alias("submitted"))


def known_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of municipalities, which the last five nations lack."""
    region = table(spark, d, "region")
    return table(spark, d, "nation").filter("n_nationkey < 20").join(region, F.expr("n_regionkey = r_regionkey")).select(F.col("n_name").alias("municipality"), F.col("r_name").alias("cluster"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Published projects: an order each, with a probability made from its key."""
    p = F.expr("pmod(o_orderkey * 7919, 1000) / 1000.0").cast("double")
    return places(spark, d).select(
        F.concat(F.lit("PRJ_"), F.col("o_orderkey").cast("string")).alias("project_key"),
        F.col("o_orderkey").alias("order_id"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderdate").cast("timestamp").alias("released"),
        F.expr("case o_orderstatus when 'F' then 'Completed' when 'O' then 'On-going' else 'Not Started' end").alias("status"),
        "municipality",
        "cluster",
        F.when(F.expr("pmod(o_orderkey, 11) <> 0"), p).alias("prob"),
    )


MON = """places AS (
  SELECT o_orderkey, o_orderdate, o_totalprice, o_orderstatus, c_custkey, n_name AS municipality, r_name AS cluster
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), mon AS (
  SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(l_linenumber AS VARCHAR)) AS mon_row_id,
    l_orderkey AS order_id, p_name AS name, l_extendedprice AS amount, o_orderdate AS released, l_shipdate AS monitored,
    CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS completed,
    CASE l_returnflag WHEN 'A' THEN 'Completed/ Fuctional' WHEN 'N' THEN 'On-going' ELSE 'For refund of full amount' END AS status,
    CASE WHEN l_linenumber = 7 THEN 'Delayed by typhoon' ELSE 'No remarks' END AS remarks,
    CASE WHEN p_type IN ('LARGE', 'STANDARD', 'MEDIUM') THEN 'Infrastructure' WHEN p_type IN ('SMALL', 'ECONOMY') THEN 'Non-Infrastructure' ELSE 'Unclassified' END AS project_type,
    municipality, cluster
  FROM lineitem JOIN places ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
)"""

SCORED = """places AS (
  SELECT o_orderkey, o_orderdate, o_totalprice, o_orderstatus, c_custkey, n_name AS municipality, r_name AS cluster
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), scored AS (
  SELECT 'PRJ_' || CAST(o_orderkey AS VARCHAR) AS project_key, o_orderkey AS order_id, o_totalprice AS amount, o_orderdate AS released,
    CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'On-going' ELSE 'Not Started' END AS status, municipality, cluster,
    CASE WHEN o_orderkey % 11 <> 0 THEN CAST((o_orderkey * 7919) % 1000 AS DOUBLE) / 1000.0 END AS prob
  FROM places
)"""
