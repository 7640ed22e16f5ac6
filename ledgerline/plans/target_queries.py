"""Queries of target construction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import target
from .register import query
from .testbed import FLOOR, MON, liquidation, monitoring

STEPS = f"""WITH {MON}, dedup AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name, amount, released, monitored ORDER BY mon_row_id) AS rn FROM mon) WHERE rn = 1
), started AS (
  SELECT *, coalesce(released, monitored) AS start, released IS NULL AND monitored IS NOT NULL AS start_is_proxy FROM dedup
), study AS (
  SELECT * FROM started WHERE start IS NULL OR start >= TIMESTAMP '{FLOOR} 00:00:00'
), direct AS (
  SELECT *, coalesce(completed <= start, false) AS direct_rejected, CASE WHEN completed > start THEN completed END AS direct FROM study
), link AS (SELECT l_orderkey AS order_id, max(l_shipdate) AS linked FROM lineitem GROUP BY l_orderkey
), base AS (
  SELECT direct.*, linked, greatest(monitored, linked) AS proxy FROM direct LEFT JOIN link ON direct.order_id = link.order_id
), lag AS (
  SELECT coalesce(median(CAST(date_diff('day', direct, proxy) AS DOUBLE)), 0.0) AS lag_days, count(*) AS lag_n FROM base WHERE direct IS NOT NULL AND proxy IS NOT NULL
), moved AS (
  SELECT base.*, lag_days, lag_n, epoch(proxy) - lag_days * 86400 AS moved_s, epoch(start) AS start_s, epoch(proxy) AS proxy_s FROM base, lag
), corrected AS (
  SELECT *, coalesce(moved_s <= start_s AND proxy_s > start_s, false) AS clamped FROM moved
), fixed AS (
  SELECT *, CASE WHEN clamped THEN start_s + 86400 ELSE moved_s END AS corrected_s FROM corrected
), usable AS (
  SELECT *, direct IS NULL AND lower(status) LIKE '%completed%' AND coalesce(corrected_s > start_s, false) AS recovered FROM fixed
), timed AS (
  SELECT *, CASE WHEN direct IS NOT NULL THEN epoch(direct) WHEN recovered THEN corrected_s END AS finished_s,
    CASE project_type WHEN 'Infrastructure' THEN 365 WHEN 'Non-Infrastructure' THEN 182 END AS standard_days,
    lower(remarks) LIKE '%typhoon%' AS extended FROM usable
), days AS (
  SELECT *, CAST(floor((finished_s - start_s) / 86400) AS BIGINT) AS actual_days FROM timed
), labelled AS (
  SELECT *, CASE WHEN standard_days IS NOT NULL AND actual_days IS NOT NULL THEN CASE WHEN actual_days > standard_days AND NOT extended THEN 1 ELSE 0 END END AS overrun,
    CASE WHEN standard_days IS NOT NULL AND actual_days IS NOT NULL THEN round_even((actual_days - standard_days) / CAST(standard_days AS DOUBLE) * 100, 1) END AS overrun_pct FROM days
)
"""


def linked_rows(spark: SparkSession, d: str) -> DataFrame:
    return monitoring(spark, d, target.linked_dates(liquidation(spark, d)))


def base(spark: SparkSession, d: str) -> DataFrame:
    return target.basis(linked_rows(spark, d), None, FLOOR)


def labelled(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    """Labelled rows with the columns in keep."""
    return target.build_target(linked_rows(spark, d), None, FLOOR, keep)


@query(STEPS + "SELECT mon_row_id, name, amount FROM dedup")
def d1_drop_duplicates(spark, d):
    return target.drop_duplicates(monitoring(spark, d)).select("mon_row_id", "name", "amount")


@query(STEPS + "SELECT mon_row_id, epoch(start) AS start_s, start_is_proxy FROM started")
def d2_start_date(spark, d):
    return target.with_start(target.drop_duplicates(monitoring(spark, d))).select("mon_row_id", F.unix_timestamp("start").cast("double").alias("start_s"), "start_is_proxy")


@query(STEPS + "SELECT year(start) AS y, count(*) AS n FROM study GROUP BY 1")
def d3_study_floor(spark, d):
    return target.within_study(target.with_start(target.drop_duplicates(monitoring(spark, d))), FLOOR).groupBy(F.year("start").cast("long").alias("y")).agg(F.count("*").alias("n"))


@query(STEPS + "SELECT mon_row_id, direct_rejected, epoch(direct) AS direct_s FROM direct")
def d4_direct_credibility(spark, d):
    return base(spark, d).select("mon_row_id", "direct_rejected", F.unix_timestamp("direct").cast("double").alias("direct_s"))


@query(STEPS + "SELECT lag_days, lag_n FROM lag")
def d5_lag_median(spark, d):
    return target.lag_median(base(spark, d))


@query(STEPS + "SELECT mon_row_id, clamped, CAST(corrected_s AS BIGINT) AS corrected_s FROM fixed")
def d6_corrected_proxy(spark, d):
    return target.calibrated(base(spark, d).select("mon_row_id", "start", "direct", "proxy")).select("mon_row_id", "clamped", F.unix_timestamp("corrected").alias("corrected_s"))


@query(STEPS + "SELECT recovered, clamped, count(*) AS n FROM usable GROUP BY 1, 2")
def d7_proxy_usable(spark, d):
    return labelled(spark, d).groupBy("recovered", "clamped").agg(F.count("*").alias("n"))


@query(STEPS + "SELECT mon_row_id, standard_days, actual_days FROM days")
def d8_durations(spark, d):
    return labelled(spark, d, "mon_row_id").select("mon_row_id", "standard_days", "actual_days")


@query(STEPS + "SELECT extended, count(*) AS n FROM timed GROUP BY 1")
def d9_extension_flag(spark, d):
    return labelled(spark, d).groupBy("extended").agg(F.count("*").alias("n"))


@query(STEPS + "SELECT mon_row_id, overrun, overrun_pct FROM labelled")
def d10_overrun_label(spark, d):
    return labelled(spark, d, "mon_row_id").select("mon_row_id", "overrun", "overrun_pct")


@query(
    STEPS
    + """SELECT project_type, cluster, count(*) AS n_rows, count(direct) AS n_direct, count(*) FILTER (WHERE direct_rejected) AS n_rejected,
  count(*) FILTER (WHERE recovered) AS n_recovered, count(*) FILTER (WHERE recovered AND clamped) AS n_clamped, count(*) FILTER (WHERE extended) AS n_extended,
  count(overrun) AS n_labelled, CAST(coalesce(sum(overrun), 0) AS BIGINT) AS n_overrun, round(avg(overrun), 6) AS overrun_rate,
  round(avg(overrun) FILTER (WHERE direct IS NOT NULL), 6) AS rate_direct, round(avg(overrun) FILTER (WHERE recovered), 6) AS rate_recovered
FROM labelled GROUP BY project_type, cluster"""
)
def d11_target_report(spark, d):
    return target.report(labelled(spark, d, "cluster", "direct_rejected"))


@query(STEPS + "SELECT overrun IS NOT NULL AS resolved, count(*) AS n, count(DISTINCT order_id) AS n_orders FROM labelled GROUP BY 1")
def d12_resolved_open(spark, d):
    return labelled(spark, d, "order_id").groupBy(F.col("overrun").isNotNull().alias("resolved")).agg(F.count("*").alias("n"), F.count_distinct("order_id").alias("n_orders"))


@query(STEPS + "SELECT mon_row_id, epoch(linked) AS linked_s, epoch(proxy) AS proxy_s FROM base")
def c9_linked_dates(spark, d):
    return base(spark, d).select("mon_row_id", F.unix_timestamp("linked").cast("double").alias("linked_s"), F.unix_timestamp("proxy").cast("double").alias("proxy_s"))
