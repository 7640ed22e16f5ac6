"""Queries of metrics, models, explanation and allocation."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import allocate, contributions, features, metrics, models
from ..operators.reports import tier
from .projects import PREPARE, STACK_FOLDS, folded, has_steps, projects, sequence_pipeline, sequences, trained
from .register import query
from .reports_queries import PLAN, TIER, plan
from .target_queries import STEPS, labelled
from .testbed import SCORED, known_clusters, scored, table

PRED = f"""{SCORED}, pred AS (SELECT project_key, CAST(order_id % 2 AS INTEGER) AS y, prob AS p FROM scored WHERE prob IS NOT NULL)"""


def predictions(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).filter("prob is not null").select("project_key", F.expr("cast(order_id % 2 as int)").alias("y"), F.col("prob").alias("p"))


@query("SELECT c_custkey, CAST(0 AS DOUBLE) AS x0, coalesce(CAST(c_acctbal AS DOUBLE), 0) AS x1, CAST(length(c_name) AS DOUBLE) AS x2 FROM customer")
def b13_feature_matrix(spark, d):
    """Numeric columns of customers but for keys, after one that they lack."""
    rows = table(spark, d, "customer").withColumn("name_length", F.length("c_name"))
    columns = ["absent", *models.feature_columns(rows, ["c_custkey", "c_nationkey"])]
    return models.feature_matrix(rows, "c_custkey", columns).select("c_custkey", *(F.col("x")[i].alias(f"x{i}") for i in range(3)))


@query(f"WITH {PRED}, b AS (SELECT project_key, CASE WHEN y = 0 AND p > 0.95 THEN 1 ELSE y END AS y FROM pred WHERE p > 0.1) SELECT (SELECT count(*) FROM pred WHERE p <= 0.1) AS only_left, 0 AS only_right, count(*) FILTER (WHERE pred.y <> b.y) AS differ FROM pred JOIN b ON pred.project_key = b.project_key")
def c12_prediction_alignment(spark, d):
    a = predictions(spark, d)
    b = a.filter("p > 0.1").select("project_key", F.expr("case when y = 0 and p > 0.95 then 1 else y end").alias("y"))
    return metrics.aligned(a, b)[1]


@query(STEPS + "SELECT recovered, count(*) AS n, round(avg(overrun), 6) AS rate FROM labelled WHERE overrun IS NOT NULL GROUP BY recovered")
def e2_label_rates(spark, d):
    return metrics.label_rates(labelled(spark, d), "recovered", "overrun")


CONF = f"""{PRED}, c AS (SELECT count(*) FILTER (WHERE y = 1 AND p >= 0.5) AS tp, count(*) FILTER (WHERE y = 0 AND p >= 0.5) AS fp, count(*) FILTER (WHERE y = 1 AND p < 0.5) AS fn, count(*) FILTER (WHERE y = 0 AND p < 0.5) AS tn FROM pred
), m AS (SELECT round((tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE), 4) AS accuracy, round(tp / CAST(tp + fp AS DOUBLE), 4) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 4) AS recall, round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 4) AS f1 FROM c
), u AS (SELECT (sum(CASE WHEN y = 1 THEN r END) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / (count(*) FILTER (WHERE y = 1) * CAST(count(*) FILTER (WHERE y = 0) AS DOUBLE)) AS auc
  FROM (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM pred))"""


@query(f"WITH {CONF} SELECT * FROM m")
def e8_binary_metrics(spark, d):
    return metrics.evaluate(predictions(spark, d))


@query(f"WITH {CONF} SELECT round(auc, 9) AS auc FROM u")
def e9_auc(spark, d):
    return metrics.auc(predictions(spark, d)).select(F.round("auc", 9).alias("auc"))


@query(f"WITH {CONF} SELECT * FROM c")
def e10_confusion(spark, d):
    return metrics.confusion(predictions(spark, d))


@query(f"WITH {SCORED} SELECT {TIER} AS tier, count(*) AS n FROM scored WHERE prob IS NOT NULL GROUP BY 1")
def e11_tier_distribution(spark, d):
    return scored(spark, d).filter("prob is not null").groupBy(tier("prob").alias("tier")).agg(F.count("*").alias("n"))


@query(f"WITH {CONF} SELECT 'meta' AS model, m.*, round(auc, 4) AS auc, c.* FROM m, u, c")
def e16_model_summary(spark, d):
    return metrics.summary({"meta": predictions(spark, d)})


POOL = f"""{SCORED}, open_rows AS (SELECT *, {TIER} AS tier FROM scored JOIN nation ON municipality = n_name WHERE n_nationkey < 20 AND prob IS NOT NULL AND lower(status) NOT LIKE '%complet%' AND lower(status) NOT LIKE '%refund%'
), pool AS (SELECT project_key, prob, cluster, tier, CASE WHEN tier = 'Critical' THEN 2.5 ELSE 1.0 END AS risk_weight FROM open_rows WHERE tier IN ('High', 'Critical') ORDER BY prob DESC, project_key LIMIT 150)"""


VISITS = f"""{POOL}, nth AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY cluster ORDER BY risk_weight DESC, prob DESC, project_key) - 1) / 3) AS BIGINT) AS block FROM pool
), blocks AS (SELECT cluster, block, sum(risk_weight) AS w FROM nth GROUP BY cluster, block), taken AS (SELECT * FROM blocks ORDER BY w DESC, cluster, block LIMIT 20
), slots AS (SELECT cluster, block, row_number() OVER (ORDER BY cluster, block) - 1 AS slot FROM taken
), visits AS (
  SELECT 'Inspector ' || CAST(slot // 4 + 1 AS VARCHAR) AS inspector, list_extract(['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday'], slot % 4 + 1) AS day, project_key, nth.cluster, tier, prob, risk_weight
  FROM nth JOIN slots ON nth.cluster = slots.cluster AND nth.block = slots.block
)"""


def pool(spark: SparkSession, d: str) -> DataFrame:
    """The pool of open projects; places of the last five nations have no cluster, so they can't be scheduled."""
    clustered = features.clusters(scored(spark, d).drop("cluster"), known_clusters(spark, d))
    return allocate.priority_projects(clustered.withColumn("tier", tier("prob")))


def schedule(spark: SparkSession, d: str) -> DataFrame:
    return allocate.assign_visits(pool(spark, d), [f"Inspector {i}" for i in range(1, 6)])


@query(f"WITH {VISITS} SELECT count(*) AS visits, count(DISTINCT project_key) AS projects, count(*) FILTER (WHERE tier = 'Critical') AS critical, count(DISTINCT cluster) AS clusters, (SELECT count(*) FROM pool) AS pool FROM visits")
def e12_schedule_summary(spark, d):
    return allocate.schedule_summary(schedule(spark, d), pool(spark, d))


@query(f"WITH {VISITS} SELECT inspector, day, count(*) AS n, count(DISTINCT cluster) AS clusters FROM visits GROUP BY inspector, day")
def e13_daily_loads(spark, d):
    return allocate.loads(schedule(spark, d))


@query(f"WITH {PRED}, w AS (SELECT project_key, (p - (SELECT avg(p) FROM pred)) * 2.0 AS a, (y - (SELECT avg(y) FROM pred)) * -0.5 AS b FROM pred), l AS (SELECT project_key, 'p' AS feature, a AS c FROM w UNION ALL SELECT project_key, 'y', b FROM w), r AS (SELECT *, row_number() OVER (PARTITION BY project_key ORDER BY abs(c) DESC, feature) AS rank FROM l) SELECT project_key, feature, round(c, 9) AS contribution, CASE WHEN c >= 0 THEN 'up' ELSE 'down' END AS direction FROM r WHERE rank = 1")
def f3_top_contributions(spark, d):
    rows = models.linear_contributions(predictions(spark, d), {"p": 2.0, "y": -0.5})
    return models.top_contributions(rows, 1).select("project_key", "feature", F.round("contribution", 9).alias("contribution"), "direction")


@query(f"WITH {POOL} SELECT project_key, prob, risk_weight FROM pool")
def f6_priority_pool(spark, d):
    return pool(spark, d).select("project_key", "prob", "risk_weight")


@query()
def i11_text_classifier(spark, d):
    """Names of parts with a known type: fitted on those of the train side, and applied to all; other types are ambiguous,
    so they are predicted and not learned from."""
    kind = F.expr("case when p_type in ('LARGE', 'STANDARD', 'MEDIUM') then 1 when p_type in ('SMALL', 'ECONOMY') then 0 end")
    rows = features.split(table(spark, d, "part").select("p_partkey", F.col("p_name").alias("text"), kind.alias("y")), "p_partkey")
    return models.classified_texts(rows, F.col("split") == "train").select("p_partkey", "split", "y", "p")


@query(f"WITH {SCORED} SELECT project_key, CASE WHEN status = 'Completed' THEN 'rule-label' WHEN prob >= 0.7 THEN 'model-label' END AS label, CASE WHEN status = 'Completed' THEN 'rule' WHEN prob >= 0.7 THEN 'model' ELSE 'none' END AS origin FROM scored")
def i12_gated_fallback(spark, d):
    rule = F.when(F.col("status") == "Completed", "rule-label")
    label, origin = models.gated(rule, F.lit("model-label"), F.col("prob"))
    return scored(spark, d).select("project_key", label.alias("label"), origin.alias("origin"))


@query()
def i14_out_of_fold(spark, d):
    """Overrun of each resolved project, by a forest that was fitted on the four other folds."""
    made = projects(spark, d, steps=False)
    rows = folded(made.known(), 5)
    return models.out_of_fold(rows, made.learners()["p1"], "p", 5, learned=made.cells(rows)).select("project_key", "y", "fold", "p")


def held_out(spark: SparkSession, d: str, learner) -> DataFrame:
    """Metrics on the test side of a tree learner fitted on the train side, and the share of the larger class there.

    Cells are of labels alone: folds would make some five times as many where rows are many, and nothing here reads them."""
    made = projects(spark, d, steps=False)
    train = models.with_weights(made.known().filter("split = 'train'"))
    fitted = made.tree_learner(learner).fit(made.cells(train, ["y"]))
    test = made.known().filter("split = 'test'")
    larger = test.agg(F.round(F.greatest(F.avg("y"), 1 - F.avg("y")), 4).alias("majority"))
    return metrics.evaluate(made.tree_scores(fitted, test)).crossJoin(larger)


@query()
def i15_random_forest(spark, d):
    return held_out(spark, d, models.forest())


@query()
def i16_boosted_trees(spark, d):
    return held_out(spark, d, models.boosted(100))


@query()
def i17_sequence_learner(spark, d):
    """Overrun from the steps of a project and their mask: fitted on the train side, and applied to all resolved projects with steps."""
    rows = sequences(spark, d)
    fitted = sequence_pipeline().fit(models.balanced(rows.filter("split = 'train'"), "project_key"))
    return models.probability(fitted.transform(rows), "p").select("project_key", "split", "y", "p")


@query()
def i18_stacker(spark, d):
    made = projects(spark, d)
    known = folded(made.known(), STACK_FOLDS)
    rows, meta = models.stack(known, made.learners(), STACK_FOLDS, PREPARE, "p3", has_steps(), learned=dict.fromkeys(("p1", "p2"), made.cells(known)))
    return models.probability(meta.transform(rows), "p").select("project_key", "y", "p1", "p2", "p3", "p")


@query()
def i19_score_open(spark, d):
    """All three learners and the stacker come from the train side; the rows scored are the open projects."""
    made = projects(spark, d)
    stack = trained(made)
    rows = made.rows.filter("y is null")
    out = models.score_open(rows, stack.base, stack.meta, tier, F.col("status").contains("refund"), "p3", has_steps())
    return out.select("project_key", "p1", "p2", "p3", "prob", "tier", "excluded")


@query(f"WITH {SCORED} SELECT project_key, coalesce(prob, ((order_id % 10) / 10.0 + (order_id % 7) / 10.0) / 2) AS p FROM scored")
def i20_missing_learner(spark, d):
    return scored(spark, d).select("project_key", models.fallback(F.expr("(order_id % 10) / 10.0D"), F.expr("(order_id % 7) / 10.0D"), F.col("prob")).alias("p"))


@query(f"WITH {PRED} SELECT project_key, 'p' AS feature, round((p - (SELECT avg(p) FROM pred)) * 2.0, 9) AS contribution FROM pred UNION ALL SELECT project_key, 'y', round((y - (SELECT avg(y) FROM pred)) * -0.5, 9) FROM pred")
def i21_linear_contributions(spark, d):
    return models.linear_contributions(predictions(spark, d), {"p": 2.0, "y": -0.5}).select("project_key", "feature", F.round("contribution", 9).alias("contribution"))


@query()
def i21_tree_contributions(spark, d):
    """Contributions of all features to the mean probability of both tree models, for every open project, against 100
    projects of the train side, on which the models are fitted too."""
    made = projects(spark, d, steps=False)
    train, learners = folded(made.known().filter("split = 'train'"), STACK_FOLDS), made.learners()
    learned = made.cells(train)
    fitted = models.fit_all({name: lambda name=name: learners[name]().fit(learned) for name in ("p1", "p2")})
    return contributions.tree_contributions(list(fitted.values()), made.rows.filter("y is null"), train, made.features).select("project_key", "feature", "contribution")


@query()
def i21_sampled_contributions(spark, d):
    """The estimate by sampled walks, which takes any model: a small forest on four components of the vectors, two
    permutations, 100 background rows, the first by hash of the key. Tree models have exact ones, above."""
    names = [f"f{i}" for i in range(4)]
    parts = (F.get("embedding", i).cast("double").alias(c) for i, c in enumerate(names))
    known = table(spark, d, "embeddings").filter("embedding is not null and label is not null")
    rows = models.with_weights(known.select(F.concat(F.lit("V_"), F.col("vec_id").cast("string")).alias("project_key"), F.expr("cast(label < 5 as int)").alias("y"), *parts))
    fitted = Pipeline(stages=[models.assembler(names), models.forest(5, 3)]).fit(rows)
    background = rows.orderBy(F.xxhash64("project_key"), "project_key").limit(100)
    return models.sampled_contributions(fitted, rows, background, names, 2)


@query(f"WITH {VISITS} SELECT inspector, day, project_key, cluster, tier, prob FROM visits")
def j1_visit_assignment(spark, d):
    return schedule(spark, d).select("inspector", "day", "project_key", "cluster", "tier", "prob")


@query(
    f"""WITH {VISITS} SELECT 'once' AS rule, project_key AS subject FROM visits GROUP BY project_key HAVING count(*) > 1
UNION ALL SELECT 'daily', inspector || '/' || day FROM visits GROUP BY inspector, day HAVING count(*) > 3
UNION ALL SELECT 'weekly', inspector FROM visits GROUP BY inspector HAVING count(*) > 12
UNION ALL SELECT 'one cluster', inspector || '/' || day FROM visits GROUP BY inspector, day HAVING count(DISTINCT cluster) > 1"""
)
def j2_constraint_audit(spark, d):
    return allocate.violations(schedule(spark, d))


@query(f"WITH {VISITS} SELECT sum(risk_weight) - 0.75 * count(DISTINCT inspector || '/' || cluster) AS objective FROM visits")
def j3_objective(spark, d):
    return allocate.objective(schedule(spark, d))


@query(
    f"""WITH {PLAN}, e AS (SELECT o_orderkey AS edit_id, 'PRJ_' || CAST(o_orderkey AS VARCHAR) AS project_key, CASE WHEN o_orderkey % 7 = 0 THEN 'Sunday' ELSE 'Monday' END AS day, CAST(date_trunc('week', o_orderdate) AS DATE) AS week_of FROM orders)
SELECT edit_id, CASE WHEN e.day = 'Sunday' THEN 'bad day' WHEN plan.project_key IS NOT NULL THEN 'duplicate' ELSE 'accepted' END AS verdict FROM e LEFT JOIN plan ON e.project_key = plan.project_key AND e.day = plan.day AND e.week_of = plan.week_of"""
)
def j4_manual_edits(spark, d):
    from ..operators.reports import week_monday

    edits = table(spark, d, "orders").select(F.col("o_orderkey").alias("edit_id"), F.concat(F.lit("PRJ_"), F.col("o_orderkey").cast("string")).alias("project_key"), F.expr("case when o_orderkey % 7 = 0 then 'Sunday' else 'Monday' end").alias("day"), week_monday("o_orderdate").alias("week_of"))
    return allocate.checked_edits(edits, plan(spark, d)).select("edit_id", "verdict")
