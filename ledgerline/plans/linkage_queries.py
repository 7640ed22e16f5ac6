"""Queries of record linkage (C1-C8, C10, F1, F2), over two halves of the part table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import linkage
from ..operators.similarity import INDEL
from .register import query
from .testbed import table

SORTED = "array_to_string(list_sort(string_split({}, ' ')), ' ')"
SIDES = f"""a AS (SELECT p_partkey AS id, p_name AS name, p_brand AS brand, p_size AS year, {SORTED.format('p_name')} AS k FROM part WHERE p_partkey % 2 = 0
), b AS (SELECT p_partkey AS id, p_name AS name, p_brand AS brand, p_size AS year, {SORTED.format('p_name')} AS k FROM part WHERE p_partkey % 2 = 1
), an AS (SELECT *, row_number() OVER (PARTITION BY name, brand ORDER BY id) AS n FROM a), bn AS (SELECT *, row_number() OVER (PARTITION BY name, brand ORDER BY id) AS n FROM b
), exact AS (SELECT an.id AS left_id, bn.id AS right_id FROM an JOIN bn ON an.name = bn.name AND an.brand = bn.brand AND an.n = bn.n
), rest AS (SELECT * FROM a WHERE id NOT IN (SELECT left_id FROM exact)
), pairs AS (
  SELECT rest.id AS left_id, b.id AS right_id, rest.year AS y1, b.year AS y2, 100.0 * (1 - levenshtein(rest.k, b.k) / CAST(greatest(length(rest.k), length(b.k)) AS DOUBLE)) AS score FROM rest JOIN b ON rest.brand = b.brand
), top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY score DESC, right_id) AS r FROM pairs WHERE score >= 60 - 1e-9) WHERE r <= 5
), fuzzy AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY score DESC, right_id) AS r2 FROM top WHERE abs(y1 - y2) <= 10) WHERE r2 = 1
)"""


def sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_size").alias("year"))
    return rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1")


def fuzzy(spark: SparkSession, d: str) -> DataFrame:
    a, b = sides(spark, d)
    rest = linkage.residual(a, linkage.exact_links(a, b, ["name", "brand"]))
    return linkage.fuzzy_links(rest, b, "brand", cutoff=60, years=10)


def walk(spark: SparkSession, d: str) -> DataFrame:
    a, b = sides(spark, d)
    return linkage.crosswalk(a, linkage.exact_links(a, b, ["name", "brand"]), fuzzy(spark, d))


@query(f"WITH {SIDES} SELECT left_id, right_id FROM exact")
def c1_exact_link(spark, d):
    return linkage.exact_links(*sides(spark, d), ["name", "brand"]).select("left_id", "right_id")


PLACE = "CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_partkey % 4 // 2 AS VARCHAR) END"


@query(
    f"""WITH RECURSIVE l AS (SELECT p_partkey AS id, p_name AS name, p_brand AS brand, {PLACE} AS v, row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey) AS n FROM part WHERE p_partkey % 2 = 0
), r AS (SELECT p_name AS name, p_brand AS brand, list({{'id': p_partkey, 'v': {PLACE}}} ORDER BY p_partkey) AS free FROM part WHERE p_partkey % 2 = 1 GROUP BY p_name, p_brand
), t AS (
  SELECT name, brand, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS left_id, CAST(NULL AS BIGINT) AS right_id, free FROM r
  UNION ALL
  SELECT t.name, t.brand, l.n, l.id, hit.id, CASE WHEN hit IS NULL THEN free ELSE list_filter(free, lambda x: x.id <> hit.id) END
  FROM t JOIN l ON t.name = l.name AND t.brand = l.brand AND l.n = t.n + 1, LATERAL (SELECT list_filter(t.free, lambda x: l.v IS NULL OR x.v IS NULL OR x.v = l.v)[1] AS hit) h
) SELECT left_id, right_id, 100.0 AS match_score, 'exact' AS match_method FROM t WHERE right_id IS NOT NULL"""
)
def c2_exact_link_veto(spark, d):
    a, b = (x.withColumn("place", F.when(F.expr("id % 3 <> 0"), F.expr("cast(id % 4 div 2 as string)"))) for x in sides(spark, d))
    return linkage.exact_links_with_veto(a, b, ["name", "brand"], "place")


@query(f"WITH {SIDES} SELECT left_id, right_id, round(score, 6) AS match_score FROM fuzzy")
def c3_fuzzy_link(spark, d):
    return fuzzy(spark, d).select("left_id", "right_id", "match_score")


@query(f"WITH {SIDES} SELECT DISTINCT a.brand, a.k AS left_name, b.k AS right_name, round(100.0 * (1 - levenshtein(a.k, b.k) / CAST(greatest(length(a.k), length(b.k)) AS DOUBLE)), 6) AS score FROM a JOIN b ON a.brand = b.brand WHERE 100.0 * (1 - levenshtein(a.k, b.k) / CAST(greatest(length(a.k), length(b.k)) AS DOUBLE)) >= 70 - 1e-9")
def c4_similarity(spark, d):
    return linkage.scored_names(*sides(spark, d), "brand", 70).select("brand", F.col("_left").alias("left_name"), F.col("_right").alias("right_name"), F.round("score", 6).alias("score"))


#: Longest common subsequence by bit rows, in names of at most 62 letters: a bit for each letter of the left name.
COMMON = """len({0}) - bit_count(list_reduce(list_prepend((1::BIGINT << len({0})) - 1, list_transform(string_split({1}, ''), lambda c: CAST(list_sum(list_transform(range(0, len({0})),
  lambda i: CASE WHEN substr({0}, CAST(i + 1 AS INTEGER), 1) = c THEN 1::BIGINT << i ELSE 0 END)) AS BIGINT))), lambda v, m: ((v + (v & m)) & ((1::BIGINT << len({0})) - 1)) | (v - (v & m))))"""


@query(f"""WITH {SIDES}, n AS (SELECT DISTINCT a.brand, a.k AS l, b.k AS r FROM a JOIN b ON a.brand = b.brand), s AS (SELECT brand, l, r, 200.0 * ({COMMON.format('l', 'r')}) / (len(l) + len(r)) AS score FROM n)
SELECT brand, l AS left_name, r AS right_name, round(score, 6) AS score FROM s WHERE score >= 70 - 1e-9""")
def c4_indel_similarity(spark, d):
    return linkage.scored_names(*sides(spark, d), "brand", 70, INDEL).select("brand", F.col("_left").alias("left_name"), F.col("_right").alias("right_name"), F.round("score", 6).alias("score"))


@query("SELECT s_suppkey, n_name AS canonical FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def c5_canonical_name(spark, d):
    nation = table(spark, d, "nation").select(F.col("n_name").alias("name"), "n_nationkey")
    raw = table(spark, d, "supplier").join(nation, F.expr("s_nationkey = n_nationkey")).select("s_suppkey", F.concat(F.lit("Brgy. "), F.initcap("name")).alias("place"))
    return linkage.canonical(raw, "place", nation.select("name"), 95).select("s_suppkey", F.col("place_canonical").alias("canonical"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 3 THEN 'Unmapped' ELSE n_name END AS place FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def c5_resolved_place(spark, d):
    """Places written as address and name, as name alone, with a trailing comma, and as an address without a name."""
    nation = table(spark, d, "nation").select(F.col("n_name").alias("name"), "n_nationkey")
    ways = F.expr("case s_suppkey % 4 when 0 then concat(s_name, ', ', initcap(name)) when 1 then lower(name) when 2 then concat('Brgy. ', name, ', ,') else concat(s_name, ', Nowhere') end")
    raw = table(spark, d, "supplier").join(nation, F.expr("s_nationkey = n_nationkey")).select("s_suppkey", ways.alias("place"))
    return linkage.resolved(raw, "place", nation.select("name"), 95).select("s_suppkey", F.col("place_resolved").alias("place"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN n_name ELSE 'Nation_' || CAST(n_nationkey AS VARCHAR) END AS canonical FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def c6_scoped_canonical(spark, d):
    nation = table(spark, d, "nation").select(F.col("n_name").alias("name"), "n_nationkey", F.col("n_regionkey").alias("scope"))
    raw = table(spark, d, "supplier").join(nation, F.expr("s_nationkey = n_nationkey")).select("s_suppkey", F.lower("name").alias("place"), F.when(F.expr("s_suppkey % 2 = 0"), F.col("scope")).otherwise(F.lit(99)).alias("scope"))
    return linkage.canonical(raw, "place", nation.select("name", "scope"), 95, "scope").select("s_suppkey", F.col("place_canonical").alias("canonical"))


@query(f"WITH {SIDES} SELECT 'PRJ_' || CAST(a.id AS VARCHAR) AS project_key, a.id AS ft_row_id, exact.right_id AS liq_row_id, fuzzy.right_id AS mon_row_id FROM a LEFT JOIN exact ON a.id = exact.left_id LEFT JOIN fuzzy ON a.id = fuzzy.left_id")
def c7_crosswalk(spark, d):
    return walk(spark, d).select("project_key", "ft_row_id", "liq_row_id", "mon_row_id")


@query(f"WITH {SIDES}, w AS (SELECT exact.right_id IS NOT NULL OR fuzzy.right_id IS NOT NULL AS linked FROM a LEFT JOIN exact ON a.id = exact.left_id LEFT JOIN fuzzy ON a.id = fuzzy.left_id) SELECT count(*) AS n, count(*) FILTER (WHERE linked) AS linked, round(avg(CASE WHEN linked THEN 1.0 ELSE 0.0 END), 6) AS rate FROM w")
def c7_linkage_rate(spark, d):
    return linkage.linkage_rate(walk(spark, d))


@query(f"WITH {SIDES} SELECT id, name FROM rest")
def c8_residual(spark, d):
    a, b = sides(spark, d)
    return linkage.residual(a, linkage.exact_links(a, b, ["name", "brand"])).select("id", "name")


@query(f"WITH {SIDES}, f AS (SELECT right_id, min(left_id) AS l FROM fuzzy GROUP BY right_id) SELECT id, coalesce('PRJ_' || CAST(l AS VARCHAR), 'MON_ONLY_' || CAST(id AS VARCHAR)) AS project_key FROM b LEFT JOIN f ON b.id = f.right_id")
def c10_first_key(spark, d):
    return linkage.first_keys(sides(spark, d)[1], walk(spark, d)).select("id", "project_key")


@query("SELECT l_orderkey, min(concat_ws('-', CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR))) AS first_line FROM lineitem GROUP BY l_orderkey")
def f1_first_per_key(spark, d):
    from ..operators.target import first_rows

    rows = table(spark, d, "lineitem").select("l_orderkey", F.concat_ws("-", "l_partkey", "l_suppkey").alias("first_line"))
    return first_rows(rows, ["l_orderkey"], ["first_line"])


@query(f"WITH {SIDES} SELECT left_id, count(*) AS candidates, max(r) AS lowest FROM top GROUP BY left_id")
def f2_top_candidates(spark, d):
    a, b = sides(spark, d)
    rest = linkage.residual(a, linkage.exact_links(a, b, ["name", "brand"]))
    pairs = linkage.top_candidates(rest, b, "brand", 60, 5)
    return pairs.groupBy("left_id").agg(F.count("*").alias("candidates"), F.max("_k").cast("long").alias("lowest"))
