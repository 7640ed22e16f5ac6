"""Queries of statistical series (C17, C18, E14, G2, H9, H10), over monthly means of orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import series
from .register import query
from .testbed import table

LONG = """long AS (
  SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, 'orders' AS series, o_totalprice AS value FROM orders WHERE month(o_orderdate) <> 2
  UNION ALL SELECT year(l_shipdate), month(l_shipdate), 'lines', l_extendedprice FROM lineitem WHERE month(l_shipdate) <> 5)"""


def long_rows(spark: SparkSession, d: str) -> DataFrame:
    part = lambda t, day, value, name, skip: table(spark, d, t).filter(F.month(day) != skip).select(F.year(day).alias("year"), F.month(day).alias("month"), F.lit(name).alias("series"), F.col(value).alias("value"))
    return part("orders", "o_orderdate", "o_totalprice", "orders", 2).unionByName(part("lineitem", "l_shipdate", "l_extendedprice", "lines", 5))


@query(f"WITH {LONG}, o AS (SELECT year, month, count(*) AS a FROM long WHERE series = 'orders' GROUP BY 1, 2), l AS (SELECT year, month, count(*) AS b FROM long WHERE series = 'lines' GROUP BY 1, 2) SELECT coalesce(o.year, l.year) AS year, coalesce(o.month, l.month) AS month, a, b FROM o FULL JOIN l ON o.year = l.year AND o.month = l.month")
def c17_series_outer_join(spark, d):
    rows = long_rows(spark, d)
    count = lambda name, out: rows.filter(F.col("series") == name).groupBy("year", "month").agg(F.count("*").alias(out))
    return count("orders", "a").join(count("lines", "b"), ["year", "month"], "full")


@query(
    """WITH s AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m, max(o_totalprice) AS v FROM orders WHERE month(o_orderdate) IN (1, 4, 8) GROUP BY 1),
r AS (SELECT o_orderkey, max(s.m) AS vintage FROM orders LEFT JOIN s ON s.m <= o_orderdate AND s.m > CAST(date_trunc('month', o_orderdate) AS DATE) - INTERVAL 12 MONTH GROUP BY o_orderkey)
SELECT o_orderkey, strftime(vintage, '%Y-%m-%d') AS vintage, v AS indicator FROM r LEFT JOIN s ON r.vintage = s.m"""
)
def c18_point_in_time(spark, d):
    orders = table(spark, d, "orders")
    indicator = orders.filter("month(o_orderdate) in (1, 4, 8)").groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("month_start")).agg(F.max("o_totalprice").alias("value"))
    return series.as_of(orders, indicator, "o_orderdate").select("o_orderkey", F.col("vintage").cast("string").alias("vintage"), "indicator")


@query(f"WITH {LONG} SELECT year, month, round(avg(value) FILTER (WHERE series = 'orders'), 4) AS orders, round(avg(value) FILTER (WHERE series = 'lines'), 4) AS lines FROM long GROUP BY year, month")
def e14_pivot_mean(spark, d):
    return series.wide(long_rows(spark, d), ["orders", "lines"]).withColumns({"orders": F.round("orders", 4), "lines": F.round("lines", 4)})


@query(f"WITH {LONG} SELECT year, month, series, min(value) AS value FROM long GROUP BY year, month, series")
def g2_distinct_subset(spark, d):
    return series.latest_only(long_rows(spark, d), ["year", "month", "series"], ["value"])


@query("SELECT n_nationkey, strftime(make_date(2020, m, 1), '%Y-%m-%d') AS month_start FROM nation, (SELECT unnest(generate_series(1, 12)) AS m) WHERE n_nationkey % 4 IN (0, 3) OR (n_nationkey % 4 = 1 AND m BETWEEN 4 AND 6) OR (n_nationkey % 4 = 2 AND m = 3)")
def h9_period_months(spark, d):
    period = F.expr("case n_nationkey % 4 when 0 then 'Annual' when 1 then 'Q2' when 2 then 'March' else '??' end")
    rows = table(spark, d, "nation").select("n_nationkey", F.lit(2020).alias("year"), period.alias("period"))
    return series.monthly(rows).select("n_nationkey", F.col("month_start").cast("string").alias("month_start"))


@query("SELECT n_name, CAST(n_regionkey AS DOUBLE) AS value FROM nation WHERE contains(n_name, '_1')")
def h10_region_detection(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_name").alias("geo_label"), F.col("n_regionkey").cast("string").alias("obs_value"))
    place, value = series.role_of(rows.columns, ["geo", "region"]), series.role_of(rows.columns, ["value", "amount"])
    return series.regional(rows, place, "_1").select(F.col(place).alias("n_name"), F.col(value).try_cast("double").alias("value"))
