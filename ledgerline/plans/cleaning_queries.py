"""Queries of scans and cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import clean
from ..schema import STATUS_VOCABULARY
from ..sources import readers
from .register import query
from .testbed import MON, monitoring, table

#: Messy cells made of table columns by the key, the same in Spark and SQL.
MESSY = """messy AS (
  SELECT o_orderkey, CASE o_orderkey % 8
    WHEN 0 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 1 THEN CAST(date_diff('day', TIMESTAMP '1899-12-30', o_orderdate) AS VARCHAR)
    WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN strftime(o_orderdate, '%B ') || CAST(day(o_orderdate) AS VARCHAR) || strftime(o_orderdate, ', %Y')
    WHEN 4 THEN 'N/A' WHEN 5 THEN CAST(date_diff('day', TIMESTAMP '1899-12-30', o_orderdate) AS VARCHAR) || '.5'
    WHEN 6 THEN '2016' ELSE 'soon' END AS cell,
    CASE o_orderkey % 4 WHEN 0 THEN 'P ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || '.50' WHEN 1 THEN '(' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || ')' WHEN 2 THEN '1-2' ELSE '-' END AS money,
    o_orderdate, o_totalprice FROM orders
)"""


def messy(spark: SparkSession, d: str) -> DataFrame:
    o, k = F.col("o_orderdate"), F.col("o_orderkey")
    serial = F.datediff(o.cast("date"), F.lit("1899-12-30").cast("date")).cast("string")
    whole = F.floor("o_totalprice").cast("bigint").cast("string")
    cell = (
        F.when(k % 8 == 0, F.date_format(o, "MM/dd/yyyy"))
        .when(k % 8 == 1, serial)
        .when(k % 8 == 2, F.date_format(o, "yyyy-MM-dd"))
        .when(k % 8 == 3, F.date_format(o, "MMMM d, yyyy"))
        .when(k % 8 == 4, "N/A")
        .when(k % 8 == 5, F.concat(serial, F.lit(".5")))
        .when(k % 8 == 6, "2016")
        .otherwise("soon")
    )
    money = F.when(k % 4 == 0, F.concat(F.lit("P "), whole, F.lit(".50"))).when(k % 4 == 1, F.concat(F.lit("("), whole, F.lit(")"))).when(k % 4 == 2, "1-2").otherwise("-")
    return table(spark, d, "orders").select("o_orderkey", cell.alias("cell"), money.alias("money"), "o_orderdate")


WINDOW = ("1990-01-01", "1999-12-31")
DATED = MESSY + """, dated AS (
  SELECT *, CASE WHEN o_orderkey % 8 < 4 AND o_orderdate >= TIMESTAMP '1990-01-01' AND o_orderdate <= TIMESTAMP '1999-12-31' THEN CAST(o_orderdate AS DATE) END AS day,
    CASE o_orderkey % 4 WHEN 0 THEN floor(o_totalprice) + 0.5 WHEN 1 THEN floor(o_totalprice) END AS amount FROM messy
)"""


def dated(spark: SparkSession, d: str) -> DataFrame:
    return messy(spark, d).withColumn("day", clean.to_date("cell", WINDOW)).withColumn("amount", clean.to_amount("money"))


@query("SELECT s_suppkey, s_name FROM supplier")
def a1_checked_scan(spark, d):
    return readers.require(table(spark, d, "supplier"), ["s_suppkey", "s_name"], "supplier").select("s_suppkey", "s_name")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey % 3 <> 0")
def a2_prune_blank(spark, d):
    rows = table(spark, d, "nation")
    gone = F.expr("n_nationkey % 3 <> 0")
    rows = rows.select(*(F.when(gone, F.col(c)).alias(f" {c} ") for c in rows.columns), F.lit(None).cast("string").alias("empty"), F.lit(1).alias(" "))
    return readers.prune(rows)


@query("SELECT c_custkey AS id, c_name AS name, 'core' AS source_sheet FROM customer UNION ALL SELECT NULL, s_name, 'supplement' FROM supplier WHERE s_suppkey % 5 <> 0")
def a3_fold_in(spark, d):
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    extra = table(spark, d, "supplier").select(F.when(F.expr("s_suppkey % 5 <> 0"), F.col("s_name")).alias("s_name"), "s_acctbal")
    return readers.fold_in(base, extra, {"s_name": "name"}, "supplement", "name")


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand")
def a4_pruned_scan(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"))


@query(
    """SELECT c_custkey, dim.region, dim.year, CAST(c_custkey * 10 + dim.k AS DOUBLE) AS value FROM customer,
  (VALUES (0, 'north', '2020'), (1, 'north', '2021'), (2, 'north', '2022'), (3, 'south', '2020'), (4, 'south', '2021'), (5, 'south', '2022')) dim(k, region, year)"""
)
def a8_unravel_cube(spark, d):
    values = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.col("c_custkey") * 10 + k)
    payload = F.to_json(F.struct(F.expr("array('region', 'year')").alias("id"), F.expr("array(2, 3)").alias("size"), values.alias("value"), F.expr("named_struct('region', array('north', 'south'), 'year', array('2020', '2021', '2022'))").alias("label")))
    return readers.unravel_cube(table(spark, d, "customer").select("c_custkey", payload.alias("payload")), ["region", "year"])


@query(f"WITH {DATED} SELECT o_orderkey, strftime(day, '%Y-%m-%d') AS day FROM dated")
def b1_mixed_dates(spark, d):
    return dated(spark, d).select("o_orderkey", F.col("day").cast("string").alias("day"))


@query(f"WITH {DATED} SELECT o_orderkey, amount FROM dated")
def b2_currency(spark, d):
    return dated(spark, d).select("o_orderkey", "amount")


@query(
    f"""WITH {DATED}, f AS (
  SELECT 'cell' AS column_name, count(cell) AS n, count(*) FILTER (WHERE cell IS NOT NULL AND day IS NULL) AS failed FROM dated
  UNION ALL SELECT 'money', count(money), count(*) FILTER (WHERE money IS NOT NULL AND amount IS NULL) FROM dated
) SELECT column_name, n, failed, round(failed / CAST(n AS DOUBLE), 6) AS rate FROM f"""
)
def b3_failure_report(spark, d):
    return clean.failures(dated(spark, d), {"cell": "day", "money": "amount"})


@query(f"WITH {MON} SELECT CASE status WHEN 'Completed/ Fuctional' THEN 'Completed/Functional' WHEN 'On-going' THEN 'On-going' ELSE 'For Refund Of Full Amount' END AS term, count(*) AS n FROM mon GROUP BY 1")
def b4_vocabulary(spark, d):
    return monitoring(spark, d).groupBy(clean.to_vocabulary("status", STATUS_VOCABULARY).alias("term")).agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, lower('San ' || replace(s_name, '#', ' ')) AS place FROM supplier")
def b5_normalise_text(spark, d):
    raw = F.concat(F.lit("  Brgy.  San-"), F.regexp_replace("s_name", "#", " , "), F.lit(" "))
    return table(spark, d, "supplier").select("s_suppkey", text.place_name(raw).alias("place"))


NAMES = "CASE p_partkey % 4 WHEN 0 THEN 'Multi – Purpose Hall' WHEN 1 THEN 'Purchase of Chairs' WHEN 2 THEN 'Repair of Sound System' ELSE 'Unifform' END"


@query(f"SELECT kind, count(*) AS n FROM (SELECT CASE p_partkey % 4 WHEN 0 THEN 'Infrastructure' WHEN 1 THEN 'Non-Infrastructure' ELSE 'Unclassified' END AS kind FROM part) GROUP BY kind")
def b6_type_by_words(spark, d):
    return table(spark, d, "part").groupBy(clean.project_type(F.expr(NAMES)).alias("kind")).agg(F.count("*").alias("n"))


@query(f"WITH {MON} SELECT lower(status) LIKE '%functional%' OR lower(status) LIKE '%fuctional%' OR lower(status) LIKE '%completed%' AS hit, count(*) AS n FROM mon GROUP BY 1")
def b7_any_substring(spark, d):
    from ..operators.target import contains_any

    return monitoring(spark, d).groupBy(contains_any("status", ("completed", "functional", "fuctional")).alias("hit")).agg(F.count("*").alias("n"))


@query(f"WITH {MON} SELECT CASE WHEN lower(status) LIKE '%complet%' THEN 'completed' WHEN lower(status) LIKE '%refund%' THEN 'refunded' ELSE 'on_going' END AS s, count(*) AS n FROM mon GROUP BY 1")
def b8_ordered_status(spark, d):
    return monitoring(spark, d).groupBy(clean.status_in_order("status").alias("s")).agg(F.count("*").alias("n"))


@query(f"WITH {MON} SELECT CASE WHEN lower(status) = 'on-going' THEN 'On-going' WHEN lower(status) LIKE '%refund%' THEN 'Refunded' ELSE 'Completed/Functional' END AS s, count(*) AS n FROM mon GROUP BY 1")
def b9_exact_status(spark, d):
    return monitoring(spark, d).groupBy(clean.status_exact("status", STATUS_VOCABULARY).alias("s")).agg(F.count("*").alias("n"))


@query(f"WITH {MON} SELECT mon_row_id, name AS barangay, municipality FROM mon")
def b11_location_split(spark, d):
    place = F.concat_ws(", ", "name", F.lit("Purok 1"), "municipality")
    return monitoring(spark, d).select("mon_row_id", text.first_part(place).alias("barangay"), text.last_part(place).alias("municipality"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS balance, left(c_name, 12) AS name FROM customer")
def b12_missing_aware(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.when(F.expr("c_custkey % 7 = 0"), F.lit(float("nan"))).otherwise(F.col("c_acctbal")).alias("balance"), F.left("c_name", F.lit(12)).alias("name"))
    return clean.without_nan(rows)


@query("SELECT o_orderkey, abs(year(o_orderdate) - (1990 + o_orderkey % 10)) > 6 AS flagged FROM orders")
def b17_year_deviation(spark, d):
    return table(spark, d, "orders").select("o_orderkey", clean.year_deviates("o_orderdate", F.expr("1990 + o_orderkey % 10")).alias("flagged"))


@query(
    """SELECT 'size' AS rule, count(*) FILTER (WHERE p_size > 40) AS broken FROM part
UNION ALL SELECT 'type', count(*) FILTER (WHERE p_type = 'PROMO') FROM part UNION ALL SELECT 'price', count(*) FILTER (WHERE p_retailprice < 901) FROM part"""
)
def b18_constraints(spark, d):
    return clean.check_rules(table(spark, d, "part"), {"size": "p_size between 1 and 40", "type": "p_type in ('LARGE', 'STANDARD', 'MEDIUM', 'SMALL', 'ECONOMY')", "price": "p_retailprice >= 901"})


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def b18_foreign_keys(spark, d):
    return clean.orphans(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders"), "c_custkey", "o_custkey")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def b18_unique_keys(spark, d):
    return clean.repeated_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT kind, count(*) AS n FROM (SELECT CASE WHEN p_size > 30 THEN 'Infrastructure' WHEN p_size > 10 THEN 'Non-Infrastructure' ELSE 'Unclassified' END AS kind FROM part) GROUP BY kind")
def b19_reverse_one_hot(spark, d):
    rows = table(spark, d, "part").selectExpr("cast(p_size > 30 as int) as a", "cast(p_size > 10 as int) as b")
    return rows.groupBy(clean.first_set({"a": "Infrastructure", "b": "Non-Infrastructure"}).alias("kind")).agg(F.count("*").alias("n"))


@query(f"WITH {MON} SELECT project_type, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM mon), 4) AS share FROM mon GROUP BY project_type")
def e1_shares(spark, d):
    return clean.shares(monitoring(spark, d), "project_type")


@query("SELECT c_name AS name, c_acctbal AS balance, NULL AS kind FROM customer UNION ALL SELECT s_name, s_acctbal, 'supplier' FROM supplier")
def g1_union_by_name(spark, d):
    a = table(spark, d, "customer").selectExpr("c_name as name", "c_acctbal as balance")
    return a.unionByName(table(spark, d, "supplier").selectExpr("s_acctbal as balance", "'supplier' as kind", "s_name as name"), allowMissingColumns=True)


@query(f"WITH {MON} SELECT DISTINCT lower(status) AS status FROM mon WHERE lower(status) NOT IN ('completed/ fuctional', 'on-going')")
def g4_unmapped(spark, d):
    return clean.unmapped(monitoring(spark, d), "status", STATUS_VOCABULARY)


@query("SELECT p_partkey, upper(left(p_name, 1)) || substr(p_name, 2, position(' ' IN p_name) - 1) || upper(substr(p_name, position(' ' IN p_name) + 1, 1)) || substr(p_name, position(' ' IN p_name) + 2) AS title FROM part")
def h1_title_case(spark, d):
    return table(spark, d, "part").select("p_partkey", text.title("p_name").alias("title"))


@query("SELECT c_custkey, round(ln(1 + greatest(c_acctbal, 0)), 9) AS log, least(greatest(c_acctbal / 10000, 0), 1) AS clipped, abs(c_acctbal) AS size, floor(c_acctbal) AS low, ceil(c_acctbal) AS high FROM customer")
def h4_math(spark, d):
    b = F.col("c_acctbal")
    return table(spark, d, "customer").select("c_custkey", F.round(F.log1p(F.greatest(b, F.lit(0))), 9).alias("log"), F.least(F.greatest(b / 10000, F.lit(0)), F.lit(1)).cast("double").alias("clipped"), F.abs(b).alias("size"), F.floor(b).cast("double").alias("low"), F.ceil(b).cast("double").alias("high"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE event_type WHEN 'click' THEN 'Click' WHEN 'view' THEN 'View' END AS label FROM events")
def h6_map_json(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), text.lookup("event_type", {"click": "Click", "view": "View"}).alias("label"))


