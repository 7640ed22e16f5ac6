"""Queries of features and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, sequences
from .register import query
from .target_queries import STEPS, labelled
from .testbed import MON, SCORED, known_clusters, monitoring, scored, table

BUCKET = "CAST(('0x' || substr(md5(CAST({} AS VARCHAR)), 1, 8))::UBIGINT % {} AS INTEGER)"
EVENTS = f"""ev AS (
  SELECT 'PRJ_' || CAST(user_id AS VARCHAR) AS project_key, CAST(CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END AS INTEGER) AS event_type, CAST(ts AS DATE) AS date, value AS amount
  FROM events
), keys AS (SELECT 'PRJ_' || CAST(user_id AS VARCHAR) AS project_key FROM events UNION SELECT 'PRJ_' || CAST(c_custkey AS VARCHAR) FROM customer
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY project_key ORDER BY date, event_type, amount) AS k, min(date) OVER (PARTITION BY project_key) AS first FROM ev
), seq AS (
  SELECT keys.project_key, k, event_type, date_diff('day', first, date) AS days, amount FROM keys LEFT JOIN ranked ON keys.project_key = ranked.project_key AND k <= 5
), real AS (SELECT * FROM seq WHERE k IS NOT NULL)"""


def raw_events(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.concat(F.lit("PRJ_"), F.col("user_id").cast("string")).alias("project_key"), F.col("ts").cast("date").alias("date"), F.col("value").alias("amount"), "event_type")
    kinds = {0: "event_type = 'signup'", 1: "event_type = 'purchase'", 2: "event_type not in ('signup', 'purchase')"}
    return sequences.events_of({k: rows.filter(sql) for k, sql in kinds.items()})


def sequence_rows(spark: SparkSession, d: str) -> DataFrame:
    """A history of each user with events, and an empty one of each customer without."""
    key = lambda name, column: table(spark, d, name).select(F.concat(F.lit("PRJ_"), F.col(column).cast("string")).alias("project_key"))
    keys = key("events", "user_id").union(key("customer", "c_custkey")).distinct()
    return sequences.assemble(keys, raw_events(spark, d))


def steps_long(df: DataFrame) -> DataFrame:
    real = df.select("project_key", F.posexplode(F.arrays_zip("steps", "mask")).alias("at", "x")).filter("x.mask")
    return real.select("project_key", (F.col("at") + 1).cast("long").alias("k"), F.col("x.steps.event_type").alias("event_type"), F.col("x.steps.days").alias("days"), F.col("x.steps.amount").alias("amount"))


@query(f"WITH {EVENTS} SELECT project_key, k, event_type, days, amount FROM real")
def a10_sequence_store(spark, d):
    from ..sources.sinks import reread

    return steps_long(reread(sequence_rows(spark, d), "sequences"))


@query("SELECT kept FROM (SELECT 'n_nationkey' AS kept, count(DISTINCT n_nationkey) AS n FROM nation UNION ALL SELECT 'n_regionkey', count(DISTINCT n_regionkey) FROM nation UNION ALL SELECT 'one', count(DISTINCT 1) FROM nation) WHERE n > 1")
def b14_zero_variance(spark, d):
    rows = table(spark, d, "nation").withColumn("one", F.lit(1))
    return spark.createDataFrame([(c,) for c in features.varying(rows, ["n_nationkey", "n_regionkey", "one"])], "kept string")


@query("SELECT o_orderkey, c_acctbal, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal >= 0")
def c11_dimension_join(spark, d):
    side = table(spark, d, "customer").filter("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_mktsegment")
    return table(spark, d, "orders").join(side, "o_custkey", "left").select("o_orderkey", "c_acctbal", "c_mktsegment")


LABELS = f"""lab AS (
  SELECT 'PRJ_' || CAST(o_orderkey AS VARCHAR) AS project_key, o_orderkey AS id, CAST(o_orderkey % 2 AS INTEGER) AS label, CASE WHEN {BUCKET.format("'PRJ_' || CAST(o_orderkey AS VARCHAR)", 100)} < 30 THEN 'test' ELSE 'train' END AS split FROM orders WHERE o_orderstatus <> 'O'
)"""


@query(f"WITH {EVENTS}, {LABELS} SELECT keys.project_key, label, coalesce(split, 'unresolved') AS split FROM keys LEFT JOIN lab ON keys.project_key = lab.project_key")
def c13_split_membership(spark, d):
    rows = table(spark, d, "orders").filter("o_orderstatus <> 'O'").select(F.concat(F.lit("PRJ_"), F.col("o_orderkey").cast("string")).alias("project_key"), F.expr("cast(o_orderkey % 2 as int)").alias("label"), F.col("o_orderkey").alias("id"))
    return sequences.with_labels(sequence_rows(spark, d), features.split(rows, "project_key"), "id").select("project_key", "label", "split")


@query(f"WITH {EVENTS}, c AS (SELECT project_key, count(k) AS n FROM seq GROUP BY project_key) SELECT count(*) AS n, count(*) FILTER (WHERE n = 0) AS n_empty, round(avg(n), 6) AS mean_steps FROM c")
def e15_sequence_coverage(spark, d):
    return sequences.coverage(sequence_rows(spark, d))


@query(f"WITH {SCORED}, s AS (SELECT project_key, CASE WHEN {BUCKET.format('project_key', 100)} < 30 THEN 'test' ELSE 'train' END AS split, status FROM scored) SELECT split, count(*) AS n FROM s WHERE status <> 'Completed' AND split = 'train' GROUP BY split")
def g3_membership_split(spark, d):
    rows = features.split(scored(spark, d), "project_key")
    done = rows.filter("status = 'Completed'").select("project_key")
    train = rows.filter("split = 'train'").select("project_key")
    return rows.join(done, "project_key", "left_anti").join(train, "project_key", "left_semi").groupBy("split").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, unnest(['Project Type: ' || p_type, p_brand || ' Rate', 'Release Month']) AS label FROM part")
def h2_feature_labels(spark, d):
    names = F.array(F.concat(F.lit("project_type_"), F.col("p_type")), F.concat(F.lower("p_brand"), F.lit("_rate")), F.lit("release_month"))
    return table(spark, d, "part").select("p_partkey", F.explode(names).alias("feature")).select("p_partkey", features.label_of("feature").alias("label"))


@query(f"WITH {EVENTS} SELECT keys.project_key, CAST(count(k) AS INTEGER) AS n_real, CAST(5 - count(k) AS INTEGER) AS n_pad FROM keys LEFT JOIN seq ON keys.project_key = seq.project_key GROUP BY keys.project_key")
def h5_array_functions(spark, d):
    rows = sequence_rows(spark, d)
    return rows.select("project_key", F.size(F.filter("mask", lambda m: m)).alias("n_real"), F.size(F.filter("steps", lambda s: s["days"] == -1)).alias("n_pad"))


def _impute_sql(rounds: int = 15) -> str:
    """The same rounds, each as two fits and a table."""
    out = """WITH g AS (SELECT s_suppkey, CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal END AS a, CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal * 0.5 + (s_suppkey % 13) * 100.0 END AS b FROM supplier),
g0 AS MATERIALIZED (SELECT s_suppkey, a, b, coalesce(a, (SELECT avg(a) FROM g)) AS fa, coalesce(b, (SELECT avg(b) FROM g)) AS fb FROM g)"""
    for k in range(1, rounds + 1):
        out += f""",\nh{k} AS MATERIALIZED (SELECT g{k - 1}.* EXCLUDE (fa), coalesce(a, s * fb + i) AS fa FROM g{k - 1}, (SELECT regr_slope(a, fb) AS s, regr_intercept(a, fb) AS i FROM g{k - 1}) f)
, g{k} AS MATERIALIZED (SELECT h{k}.* EXCLUDE (fb), coalesce(b, s * fa + i) AS fb FROM h{k}, (SELECT regr_slope(b, fa) AS s, regr_intercept(b, fa) AS i FROM h{k}) f)"""
    return out + f"\nSELECT s_suppkey, round(fa, 4) AS a_full, round(fb, 4) AS b_full FROM g{rounds}"


@query(_impute_sql())
def i1_imputation(spark, d):
    rows = table(spark, d, "supplier").selectExpr("s_suppkey", "case when s_suppkey % 5 <> 0 then s_acctbal end as a", "case when s_suppkey % 7 <> 0 then s_acctbal * 0.5 + (s_suppkey % 13) * 100.0 end as b", "1 as overrun")
    return features.impute(rows, ["a", "b", "overrun"], fit=features.least_squares).select("s_suppkey", F.round("a_full", 4).alias("a_full"), F.round("b_full", 4).alias("b_full"))


@query()
def i1_bayesian_imputation(spark, d):
    """Four columns of lines, three with gaps, by Bayesian ridge regression."""
    rows = table(spark, d, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_quantity as quantity", "case when l_orderkey % 5 <> 0 then l_extendedprice end as price",
        "case when l_orderkey % 7 <> 0 then l_extendedprice * (1 - l_discount) end as paid", "case when l_linenumber % 3 <> 0 then l_extendedprice * l_tax + 100 * l_discount end as tax",
    )
    made = features.impute(rows, ["quantity", "price", "paid", "tax"])
    return made.select("l_orderkey", "l_linenumber", *(F.round(f"{c}_full", 4).alias(c) for c in ("quantity", "price", "paid", "tax")))


@query(
    f"""WITH {MON}, q AS (
  SELECT project_type, count(*) AS n, quantile_cont(ln(1 + greatest(amount, 0)), 0.25) AS q1, quantile_cont(ln(1 + greatest(amount, 0)), 0.75) AS q3 FROM mon GROUP BY project_type
) SELECT mon_row_id, n >= 10 AND (ln(1 + greatest(amount, 0)) < q1 - 1.5 * (q3 - q1) OR ln(1 + greatest(amount, 0)) > q3 + 1.5 * (q3 - q1)) AS outlier FROM mon JOIN q ON mon.project_type = q.project_type"""
)
def i2_outlier_flag(spark, d):
    return features.outliers(monitoring(spark, d), "amount", "project_type").select("mon_row_id", "outlier")


@query("SELECT o_orderkey, month(o_orderdate) AS month, quarter(o_orderdate) AS quarter, date_diff('day', o_orderdate, TIMESTAMP '2000-12-31') AS days_to_horizon, CASE WHEN month(o_orderdate) BETWEEN 6 AND 11 THEN 1 ELSE 0 END AS wet_season FROM orders")
def i3_date_features(spark, d):
    return features.date_features(table(spark, d, "orders"), "o_orderdate", "2000-12-31").select("o_orderkey", "month", "quarter", "days_to_horizon", "wet_season")


@query("SELECT p_partkey, CASE WHEN p_type = 'LARGE' THEN 1 ELSE 0 END AS kind_LARGE, CASE WHEN p_type = 'SMALL' THEN 1 ELSE 0 END AS kind_SMALL, CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0 END AS kind_null FROM part")
def i4_one_hot(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.when(F.col("p_type") != "PROMO", F.col("p_type")).alias("kind"))
    return features.one_hot(rows, "kind", ["LARGE", "SMALL"], with_null=True).drop("kind")


@query(f"WITH {EVENTS} SELECT project_key, k, event_type, days, amount FROM real")
def i5_sequence_assembly(spark, d):
    return steps_long(sequence_rows(spark, d))


@query(f"WITH {SCORED} SELECT project_key, CASE WHEN {BUCKET.format('project_key', 100)} < 30 THEN 'test' ELSE 'train' END AS split FROM scored")
def i6_key_split(spark, d):
    return features.split(scored(spark, d), "project_key").select("project_key", "split")


SCALE = f"""{SCORED}, s AS (SELECT *, CASE WHEN {BUCKET.format('project_key', 100)} < 30 THEN 'test' ELSE 'train' END AS split FROM scored
), b AS (SELECT min(amount) AS a0, max(amount) AS a1, min(prob) AS p0, max(prob) AS p1 FROM s WHERE split = 'train'
), z AS (SELECT project_key, CASE WHEN amount IS NOT NULL THEN least(greatest((amount - a0) / (a1 - a0), 0), 1) END AS amount, CASE WHEN prob IS NOT NULL THEN least(greatest((prob - p0) / (p1 - p0), 0), 1) END AS prob, a0, a1, p0, p1 FROM s, b)"""


@query(f"WITH {SCALE} SELECT project_key, round(amount, 9) AS amount, round(prob, 9) AS prob FROM z")
def i7_min_max(spark, d):
    rows = features.split(scored(spark, d), "project_key")
    fitted = features.fit_scaler(rows.filter("split = 'train'"), ["amount", "prob"])
    return features.scale(rows, fitted, ["amount", "prob"]).select("project_key", F.round("amount", 9).alias("amount"), F.round("prob", 9).alias("prob"))


@query(f"WITH {SCALE} SELECT project_key, round(amount * (a1 - a0) + a0, 4) AS amount FROM z")
def i8_unscale(spark, d):
    rows = features.split(scored(spark, d), "project_key")
    fitted = features.fit_scaler(rows.filter("split = 'train'"), ["amount", "prob"])
    return features.unscale(features.scale(rows, fitted, ["amount", "prob"]), fitted, ["amount"]).select("project_key", F.round("amount", 4).alias("amount"))


@query(f"WITH {EVENTS}, b AS (SELECT min(days) AS d0, max(days) AS d1, min(amount) AS a0, max(amount) AS a1 FROM real) SELECT project_key, k, event_type, round(least(greatest((days - d0) / CAST(d1 - d0 AS DOUBLE), 0), 1), 9) AS days, round(least(greatest((amount - a0) / (a1 - a0), 0), 1), 9) AS amount FROM real, b")
def i9_masked_scaling(spark, d):
    rows = sequence_rows(spark, d)
    return steps_long(sequences.scale_steps(rows, rows)).withColumns({"days": F.round("days", 9), "amount": F.round("amount", 9)})


@query(STEPS + "SELECT overrun, count(*) AS n, round((SELECT count(*) FROM labelled WHERE overrun IS NOT NULL) / (2.0 * count(*)), 9) AS weight, round((SELECT count(*) FROM labelled WHERE overrun = 0) / CAST((SELECT count(*) FROM labelled WHERE overrun = 1) AS DOUBLE), 9) AS positive_ratio FROM labelled WHERE overrun IS NOT NULL GROUP BY overrun")
def i10_class_weights(spark, d):
    return features.class_weights(labelled(spark, d), "overrun").withColumns({"weight": F.round("weight", 9), "positive_ratio": F.round("positive_ratio", 9)})


@query(f"WITH r AS (SELECT o_orderkey, o_orderkey % 2 AS y, {BUCKET.format('o_orderkey', 256)} AS lane, md5(CAST(o_orderkey AS VARCHAR)) AS h FROM orders) SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY y ORDER BY lane, h, o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM r")
def i13_stratified_folds(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.expr("o_orderkey % 2").alias("y"))
    return features.stratified_folds(rows, "y", "o_orderkey").select("o_orderkey", "fold")


@query(f"WITH {SCORED} SELECT coalesce(CASE WHEN n_nationkey < 20 THEN r_name END, 'Unclustered') AS cluster, count(*) AS n FROM scored JOIN nation ON municipality = n_name JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def i22_cluster_lookup(spark, d):
    return features.clusters(scored(spark, d).drop("cluster"), known_clusters(spark, d)).groupBy("cluster").agg(F.count("*").alias("n"))
