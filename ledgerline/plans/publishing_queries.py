"""Queries of table maintenance and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, publish
from ..sources import readers, sinks
from ..sources.bucketed import BucketTable
from .register import query
from .reports_queries import PLAN, REPORTS, TIER, feed, named, plan
from .testbed import SCORED, scored, table


def staged(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{sinks.stage_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def a5_artifact_sink(spark, d):
    rows, path = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), staged(spark, "artifact")
    rows.write.json(path)
    return spark.read.schema(rows.schema).json(path)


@query(f"""WITH {SCORED} SELECT project_key AS "Key", municipality || ', "north"' AS "Place", printf('%.1f%%', prob * 100) AS "Risk" FROM scored WHERE prob IS NOT NULL AND cluster = 'ASIA'""")
def a6_csv_export(spark, d):
    rows = scored(spark, d).filter("prob is not null and cluster = 'ASIA'").withColumn("place", F.concat("municipality", F.lit(', "north"')))
    path = staged(spark, "export")
    sinks.write_csv(sinks.export_rows(rows, {"project_key": "Key", "place": "Place", "prob": "Risk"}, ["prob"]), path)
    return readers.read_sheet(spark, path, ["Key", "Place", "Risk"], "export")


@query("SELECT 'P' || CAST(c_custkey AS VARCHAR) AS project_key, c_name AS project_name, CAST(c_custkey % 100 AS DOUBLE) + 0.5 AS amount, CASE c_custkey % 3 WHEN 0 THEN 'Completed' WHEN 1 THEN 'Refunded' ELSE 'On-going' END AS status FROM customer WHERE c_custkey % 10 <> 0")
def a7_csv_import(spark, d):
    rows = table(spark, d, "customer").select(
        F.concat(F.lit(" P"), F.col("c_custkey").cast("string")).alias("project_key"),
        F.when(F.expr("c_custkey % 10 <> 0"), F.concat("c_name", F.lit("  "))).alias("project_name"),
        F.concat(F.lit("PHP "), F.expr("cast(c_custkey % 100 as string)"), F.lit(".50")).alias("amount"),
        F.expr("case c_custkey % 3 when 0 then 'COMPLETED' when 1 then 'for refund, full' else 'x' end").alias("status"),
    )
    path = staged(spark, "upload")
    sinks.write_csv(rows, path)
    upload = readers.read_import(spark, path, rows.schema).filter("_bad is null")
    return sinks.import_rows(upload, clean.status_exact("status", {"completed": "Completed"})).withColumn("amount", F.col("amount").cast("double"))


@query(f"WITH {SCORED} SELECT project_key, cluster || ' ' || status || ' ' || municipality AS project_name, round(amount, 2) AS amount, CASE status WHEN 'Completed' THEN 'completed' ELSE 'on_going' END AS status, strftime(released, '%Y-%m-%d') AS released_on, prob AS risk_probability, {TIER} AS risk_tier FROM scored")
def k1_publish_rows(spark, d):
    rows = named(spark, d)
    return publish.project_rows(rows.drop("prob"), rows.select("project_key", "prob")).withColumn("amount", F.col("amount").cast("double"))


def _old_new(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "orders")
    old = rows.filter("o_orderkey % 3 <> 0").select("o_orderkey", F.lit("old").alias("origin"), "o_totalprice")
    new = rows.filter("o_orderkey % 2 = 0").select("o_orderkey", F.lit("new").alias("origin"), (F.col("o_totalprice") * 2).alias("o_totalprice"))
    return old, new.unionByName(new.withColumn("origin", F.lit("older")))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE 'old' END AS origin, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 <> 0")
def k2_upsert(spark, d):
    """Old rows as a table in buckets, which the new ones change in place."""
    old, new = _old_new(spark, d)
    return BucketTable.create(old, staged(spark, "published"), "o_orderkey", 16).upsert(new, ["origin"]).read()


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 6 IN (2, 4)")
def k3_delete_stale(spark, d):
    old, new = _old_new(spark, d)
    return BucketTable.create(old, staged(spark, "published"), "o_orderkey", 16).keep_only(new).read().select("o_orderkey")


@query(
    f"""WITH {PLAN}, new AS (SELECT * FROM plan WHERE week_of = DATE '1997-05-26' AND day = 'Monday'),
  now AS (SELECT * FROM plan WHERE week_of <> DATE '1997-05-26' OR NOT EXISTS (SELECT 1 FROM new) UNION ALL SELECT * FROM new)
SELECT strftime(week_of, '%Y-%m-%d') AS week_of, count(*) AS n FROM now GROUP BY week_of"""
)
def k4_replace_week(spark, d):
    rows = plan(spark, d)
    made = BucketTable.create(rows, staged(spark, "schedule"), "project_key", 16)
    now = made.replace_where("week_of", rows.filter("week_of = date'1997-05-26' and day = 'Monday'"))
    return now.read().groupBy(F.col("week_of").cast("string").alias("week_of")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {SCORED}, {REPORTS}, r AS (
  SELECT project_key, CASE WHEN event_type = 'purchase' THEN 'Completed' ELSE 'On-going' END AS s, observed_at, row_number() OVER (PARTITION BY project_key ORDER BY observed_at DESC, report_id DESC) AS k FROM reports
) SELECT scored.project_key, coalesce(s, status) AS status, CASE WHEN s = 'Completed' THEN strftime(observed_at, '%Y-%m-%d') END AS completed_on FROM scored LEFT JOIN r ON r.project_key = scored.project_key AND k = 1"""
)
def k5_status_from_report(spark, d):
    reports = feed(spark, d).withColumn("status_observed", F.expr("case when event_type = 'purchase' then 'Completed' else 'On-going' end"))
    projects = scored(spark, d).select("project_key", "status", F.lit(None).cast("date").alias("completed_on"))
    return sinks.apply_reports(projects, reports).withColumn("completed_on", F.col("completed_on").cast("string"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 1 THEN n_name END AS n_name FROM nation")
def k6_schema_evolution(spark, d):
    rows, path = table(spark, d, "nation"), staged(spark, "evolving")
    rows.filter("n_nationkey % 2 = 0").select("n_nationkey").write.parquet(f"{path}/part=0")
    rows.filter("n_nationkey % 2 = 1").select("n_nationkey", "n_name").write.parquet(f"{path}/part=1")
    return sinks.merged_schema(spark, path).select("n_nationkey", "n_name")
