"""Queries of the dashboard family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reports
from ..schema import WEEK_DAYS
from .register import query
from .testbed import SCORED, scored, table

TIER = "CASE WHEN prob IS NULL THEN NULL WHEN prob < 0.3 THEN 'Low' WHEN prob < 0.7 THEN 'Medium' WHEN prob < 0.9 THEN 'High' ELSE 'Critical' END"
PLAN = """plan AS (
  SELECT 'PRJ_' || CAST(o_orderkey AS VARCHAR) AS project_key, s_name AS inspector,
    CASE o_orderkey % 5 WHEN 0 THEN 'Monday' WHEN 1 THEN 'Tuesday' WHEN 2 THEN 'Wednesday' WHEN 3 THEN 'Thursday' ELSE 'Friday' END AS day,
    CAST(date_trunc('week', o_orderdate) AS DATE) AS week_of
  FROM orders JOIN supplier ON 1 + o_orderkey % 10 = s_suppkey WHERE o_orderstatus <> 'F'
)"""
REPORTS = """reports AS (
  SELECT event_id AS report_id, 'PRJ_' || CAST(user_id AS VARCHAR) AS project_key, ts AS observed_at, event_type, value, s_name AS inspector
  FROM events LEFT JOIN supplier ON event_id % 20 = s_suppkey
)"""


def plan(spark: SparkSession, d: str) -> DataFrame:
    """A schedule: each order that isn't completed, with one of ten inspectors."""
    day = F.element_at(F.array(*map(F.lit, WEEK_DAYS)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    orders = table(spark, d, "orders").filter("o_orderstatus <> 'F'")
    staff = table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("inspector"))
    return orders.join(staff, F.expr("1 + o_orderkey % 10 = s_suppkey")).select(F.concat(F.lit("PRJ_"), F.col("o_orderkey").cast("string")).alias("project_key"), "inspector", day.alias("day"), reports.week_monday("o_orderdate").alias("week_of"))


def feed(spark: SparkSession, d: str) -> DataFrame:
    """Field reports from the event table."""
    staff = F.broadcast(table(spark, d, "supplier").filter("s_suppkey < 20").select("s_suppkey", F.col("s_name").alias("inspector")))
    return table(spark, d, "events").join(staff, F.expr("event_id % 20 = s_suppkey"), "left").select(F.col("event_id").alias("report_id"), F.concat(F.lit("PRJ_"), F.col("user_id").cast("string")).alias("project_key"), F.col("ts").cast("timestamp").alias("observed_at"), "event_type", "value", "inspector")


def named(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).withColumn("project_name", F.concat_ws(" ", "cluster", "status", "municipality"))


@query(f"WITH {SCORED} SELECT project_key, {TIER} AS tier FROM scored")
def h7_tier(spark, d):
    return scored(spark, d).select("project_key", reports.tier("prob").alias("tier"))


@query(f"WITH {SCORED} SELECT project_key, amount FROM scored WHERE cluster || ' ' || status || ' ' || municipality ILIKE '%going nation_1%' AND cluster IN ('ASIA', 'EUROPE') AND prob >= 0.2 AND prob <= 0.95 AND amount <= 400000")
def b10_facet_filter(spark, d):
    known = {"cluster": ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")}
    return reports.facets(named(spark, d), "going nation_1", {"cluster": ["ASIA", "EUROPE", "NOWHERE"]}, {"prob": (0.2, 0.95), "amount": (None, 400000)}, known).select("project_key", "amount")


@query("SELECT c_custkey, CASE WHEN lat BETWEEN 10.0 AND 11.5 AND lng BETWEEN 121.8 AND 123.2 THEN lat END AS lat, CASE WHEN lat BETWEEN 10.0 AND 11.5 AND lng BETWEEN 121.8 AND 123.2 THEN lng END AS lng FROM (SELECT c_custkey, 9.5 + (c_custkey % 300) / 100.0 AS lat, 121.0 + (c_custkey % 270) / 100.0 AS lng FROM customer)")
def b15_bounding_box(spark, d):
    rows = table(spark, d, "customer").selectExpr("c_custkey", "cast(9.5 as double) + (c_custkey % 300) / 100.0D as lat", "cast(121.0 as double) + (c_custkey % 270) / 100.0D as lng")
    return reports.in_box(rows, (10.0, 121.8), (11.5, 123.2))


@query(
    f"""WITH {SCORED}, h AS (
  SELECT project_key, municipality, order_id, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(project_key, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, c: (a * 31 + c) % 4294967296) AS h FROM scored
), p AS (
  SELECT project_key, n_nationkey, h, CASE WHEN order_id % 4 = 0 THEN 10.5 END AS lat, CASE WHEN order_id % 4 = 0 THEN 122.5 END AS lng FROM h JOIN nation ON municipality = n_name
)
SELECT project_key, round(coalesce(lat, 10 + n_nationkey / 100.0 + 0.02 * sqrt((CAST(floor(h / 360) AS BIGINT) % 1000) / 1000.0) * sin((h % 360) * (3.141592653589793 / 180))), 6) AS pin_lat,
  round(coalesce(lng, 122 + n_nationkey / 100.0 + 0.02 * sqrt((CAST(floor(h / 360) AS BIGINT) % 1000) / 1000.0) * cos((h % 360) * (3.141592653589793 / 180))), 6) AS pin_lng FROM p"""
)
def b16_pin_fallback(spark, d):
    centres = table(spark, d, "nation").selectExpr("n_name as municipality", "10 + n_nationkey / 100.0D as town_lat", "122 + n_nationkey / 100.0D as town_lng")
    rows = scored(spark, d).withColumns({"lat": F.expr("case when order_id % 4 = 0 then 10.5D end"), "lng": F.expr("case when order_id % 4 = 0 then 122.5D end")})
    return reports.pins(rows, centres).select("project_key", F.round("pin_lat", 6).alias("pin_lat"), F.round("pin_lng", 6).alias("pin_lng"))


@query(f"WITH {PLAN} SELECT project_key, inspector, day FROM plan WHERE week_of = DATE '1997-05-26' AND day = 'Tuesday'")
def b20_week_filter(spark, d):
    return plan(spark, d).filter((F.col("week_of") == reports.week_monday(F.lit("1997-05-28").cast("date"))) & (F.col("day") == "Tuesday")).select("project_key", "inspector", "day")


@query(f"WITH {SCORED}, {PLAN} SELECT project_key, status FROM scored WHERE project_key IN (SELECT project_key FROM plan WHERE inspector = 'Supplier#000000003')")
def c14_row_visibility(spark, d):
    return reports.visible_to(scored(spark, d), plan(spark, d), "Supplier#000000003").select("project_key", "status")


@query(f"WITH {REPORTS}, {SCORED} SELECT report_id, reports.project_key, municipality, inspector FROM reports LEFT JOIN scored ON reports.project_key = scored.project_key")
def c15_star_lookup(spark, d):
    return feed(spark, d).join(scored(spark, d).select("project_key", "municipality"), "project_key", "left").select("report_id", "project_key", "municipality", "inspector")


@query(
    f"""WITH {PLAN}, r AS (
  SELECT CASE WHEN inspector > 'Supplier#000000015' THEN 'inspector' WHEN o_orderkey IS NULL THEN 'project' ELSE 'mapped' END AS outcome
  FROM plan LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') ON project_key = 'PRJ_' || CAST(o_orderkey AS VARCHAR)
) SELECT outcome, count(*) AS n FROM r GROUP BY outcome"""
)
def c16_slot_mapping(spark, d):
    staff = table(spark, d, "supplier").filter("s_name <= 'Supplier#000000015'").select(F.col("s_name").alias("inspector"), "s_suppkey")
    known = table(spark, d, "orders").filter("o_orderstatus <> 'P'").select(F.concat(F.lit("PRJ_"), F.col("o_orderkey").cast("string")).alias("project_key"), "o_orderkey")
    mapped = plan(spark, d).join(F.broadcast(staff.filter("s_suppkey < 20")), "inspector", "left").join(known, "project_key", "left")
    outcome = F.when(F.col("s_suppkey").isNull(), "inspector").when(F.col("o_orderkey").isNull(), "project").otherwise("mapped")
    return mapped.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query(f"WITH {SCORED}, t AS (SELECT {TIER} AS tier FROM scored) SELECT x.tier, count(t.tier) AS n FROM (VALUES ('Low'), ('Medium'), ('High'), ('Critical')) x(tier) LEFT JOIN t ON t.tier = x.tier GROUP BY x.tier")
def e3_tier_counts(spark, d):
    return reports.tier_counts(scored(spark, d))


@query(f"WITH {SCORED} SELECT municipality, count(*) FILTER (WHERE prob >= 0.7) AS n_risky, count(*) FILTER (WHERE prob IS NULL OR prob < 0.7) AS n_rest FROM scored GROUP BY municipality ORDER BY count(*) DESC, municipality LIMIT 10")
def e4_hot_places(spark, d):
    return reports.hot_places(scored(spark, d))


@query(
    f"""WITH {SCORED}, {PLAN}, a AS (SELECT count(*) AS active, count(*) FILTER (WHERE prob >= 0.9) AS critical FROM scored WHERE status = 'On-going'),
  p AS (SELECT count(DISTINCT project_key) AS scheduled FROM plan)
SELECT active, critical, scheduled, CASE WHEN active > 0 THEN round(100.0 * scheduled / active, 0) ELSE 0.0 END AS coverage FROM a, p"""
)
def e5_kpi_row(spark, d):
    return reports.kpis(scored(spark, d), plan(spark, d), ongoing="On-going")


@query(f"WITH {SCORED} SELECT DISTINCT municipality FROM scored WHERE municipality IS NOT NULL ORDER BY 1")
def e6_distinct_list(spark, d):
    return scored(spark, d).select("municipality").filter("municipality is not null").distinct().orderBy("municipality")


@query(f"WITH {SCORED} SELECT coalesce(floor(min(amount)), 0) AS low, coalesce(ceil(max(amount)), 0) AS high FROM scored")
def e7_bounds(spark, d):
    return scored(spark, d).agg(F.coalesce(F.floor(F.min("amount")), F.lit(0)).cast("double").alias("low"), F.coalesce(F.ceil(F.max("amount")), F.lit(0)).cast("double").alias("high"))


@query(f"WITH {SCORED} SELECT project_key, prob, (SELECT count(*) FROM scored) AS total FROM scored ORDER BY prob DESC NULLS LAST, project_key LIMIT 50 OFFSET 100")
def f4_paged_sort(spark, d):
    return reports.paged(scored(spark, d).select("project_key", "prob"), 3)


@query(f"WITH {SCORED} SELECT project_key, prob FROM scored WHERE prob IS NOT NULL ORDER BY prob DESC, project_key LIMIT 150")
def f5_top_by_risk(spark, d):
    return scored(spark, d).filter("prob is not null").orderBy(F.desc("prob"), "project_key").limit(150).select("project_key", "prob")


@query(f"WITH {REPORTS}, r AS (SELECT *, row_number() OVER (PARTITION BY project_key ORDER BY observed_at DESC, report_id DESC) AS k FROM reports) SELECT project_key, report_id, event_type, value FROM r WHERE k = 1")
def f7_latest_report(spark, d):
    return reports.latest_reports(feed(spark, d)).select("project_key", "report_id", "event_type", "value")


@query(f"WITH {PLAN} SELECT inspector, day, CAST(list_position(['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday'], day) AS BIGINT) AS day_no, string_agg(project_key, ',' ORDER BY project_key) AS projects, count(*) AS n FROM plan WHERE week_of = DATE '1997-05-26' GROUP BY inspector, day")
def f8_week_board(spark, d):
    return reports.board(plan(spark, d).filter("week_of = date'1997-05-26'"))


@query(f"WITH {REPORTS}, n AS (SELECT * FROM reports WHERE inspector = 'Supplier#000000007' ORDER BY observed_at DESC, report_id LIMIT 200), {SCORED} SELECT report_id, n.project_key FROM n LEFT JOIN scored ON n.project_key = scored.project_key WHERE cluster || ' ' || status || ' ' || municipality ILIKE '%asia%'")
def f9_audit_trail(spark, d):
    return reports.audit_trail(feed(spark, d), named(spark, d).select("project_key", "project_name"), "Supplier#000000007", "asia").select("report_id", "project_key")


@query("SELECT o_orderkey, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS monday, month(o_orderdate) AS m, quarter(o_orderdate) AS q, year(o_orderdate) AS y, strftime(o_orderdate, '%Y-%m-%d') AS iso, dayname(o_orderdate) AS day, date_diff('day', o_orderdate, TIMESTAMP '2000-01-01') AS days FROM orders")
def h3_date_functions(spark, d):
    o = F.col("o_orderdate")
    days = F.datediff(F.lit("2000-01-01").cast("date"), o.cast("date")).cast("long")
    as_long = lambda c, n: c.cast("long").alias(n)
    return table(spark, d, "orders").select("o_orderkey", reports.week_monday(o).cast("string").alias("monday"), as_long(F.month(o), "m"), as_long(F.quarter(o), "q"), as_long(F.year(o), "y"), F.date_format(o, "yyyy-MM-dd").alias("iso"), F.date_format(o, "EEEE").alias("day"), days.alias("days"))


@query(
    f"""WITH {SCORED}, n AS (SELECT 'PRJ_' || CAST(user_id AS VARCHAR) AS project_key, count(*) AS n FROM events GROUP BY 1), s AS (
  SELECT scored.project_key, date_diff('day', released, TIMESTAMP '1998-01-01') AS age, month(released) AS m, status, coalesce(n.n, 0) AS n FROM scored LEFT JOIN n ON n.project_key = scored.project_key
) SELECT project_key, age > 365 AS old, m IN (6, 7, 8, 9, 10, 11) AS wet, status = 'Not Started' AND age > 90 AS stalled, n = 0 AS unverified FROM s"""
)
def h8_indicator_panel(spark, d):
    counted = feed(spark, d).groupBy("project_key").agg(F.count("*").alias("n_reports"))
    rows = scored(spark, d).join(counted, "project_key", "left").withColumn("n_reports", F.coalesce("n_reports", F.lit(0)))
    flag = lambda k: F.col("panel")[k]["flagged"]
    return reports.indicators(rows, "1998-01-01").select("project_key", flag(0).alias("old"), flag(1).alias("wet"), flag(2).alias("stalled"), flag(3).alias("unverified"))
