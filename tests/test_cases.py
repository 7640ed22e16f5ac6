"""Hand-derived cases of the rules, and properties of operators that SQL cannot express."""

from datetime import date, datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, CountVectorizer
from pyspark.sql import functions as F

from ledgerline.functions import text
from ledgerline.operators import allocate, clean, features, linkage, metrics, models, reports, sequences, series, target
from ledgerline.schema import STATUS_VOCABULARY
from ledgerline.sources import readers, sinks
from ledgerline.streaming import reports as stream


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("cell", "expected"),
    [("44927", date(2023, 1, 1)), ("2016", None), ("44927.5", None), ("N/A", None), ("", None), ("May 2, 2023", date(2023, 5, 2)), ("3-29-2021", date(2021, 3, 29)), ("06/21/2023", date(2023, 6, 21)), ("01/01/1955", None), ("13/05/2023", date(2023, 5, 13)), ("2016-05-01 00:00:00", date(2016, 5, 1)), ("2016-05-01T08:30:00", date(2016, 5, 1)), ("5/2/2023 10:30", date(2023, 5, 2)), ("2 May 2023", date(2023, 5, 2)), ("soon", None)],
)
def test_dates(spark, cell, expected):
    assert one(spark, clean.to_date(F.lit(cell))) == expected


@pytest.mark.parametrize(("cell", "expected"), [("₱1,234.50", 1234.5), ("(500)", 500.0), ("1-2", None), ("-", None)])
def test_money(spark, cell, expected):
    assert one(spark, clean.to_amount(F.lit(cell))) == expected


@pytest.mark.parametrize(("name", "kind"), [("Multi – Purpose Hall", "Infrastructure"), ("Purchase of Chairs", "Non-Infrastructure"), ("Repair of Sound System", "Unclassified"), ("Unifform", "Unclassified"), (None, "Unclassified")])
def test_types(spark, name, kind):
    assert one(spark, clean.project_type(F.lit(name))) == kind


def test_status_order_title_and_vocabulary(spark):
    assert one(spark, clean.status_in_order(F.lit("Completed, for refund"))) == "completed"
    assert one(spark, text.title(F.lit("completed/fuNctional o'neil 20%nta dueñas"))) == "Completed/Functional O'Neil 20%Nta Dueñas"
    assert one(spark, clean.to_vocabulary(F.lit(" ON-GOING "), STATUS_VOCABULARY)) == "On-going"


@pytest.mark.parametrize(("p", "tier"), [(0.2999, "Low"), (0.3, "Medium"), (0.7, "High"), (0.9, "Critical"), (None, None)])
def test_tiers(spark, p, tier):
    assert one(spark, reports.tier(F.lit(p).cast("double"))) == tier


def test_week_monday_of_a_sunday(spark):
    assert one(spark, reports.week_monday(F.lit("2026-11-29").cast("date"))) == date(2026, 11, 23)


def test_periods(spark):
    got = [one(spark, series.months_of(F.lit(p))) for p in ("Annual", "Q2", "March", "??")]
    assert got == [list(range(1, 13)), [4, 5, 6], [3], list(range(1, 13))]


LEDGER = "mon_row_id string, order_id long, name string, amount double, released timestamp, monitored timestamp, completed timestamp, status string, remarks string, project_type string, municipality string, cluster string"


def ledger(spark, *rows):
    day = lambda s: s and datetime.fromisoformat(s)
    full = [(str(i), i, f"n{i}", 1.0, day(a), day(b), day(c), status, "", kind, "m", "c") for i, (a, b, c, status, kind) in enumerate(rows)]
    return spark.createDataFrame(full, LEDGER), spark.createDataFrame([], "order_id long, submitted timestamp")


def labelled(spark, *rows):
    df, links = ledger(spark, *rows)
    return target.build_target(df, links, "2015-01-01").orderBy("mon_row_id").collect()


def test_direct_date_beats_status(spark):
    (r,) = labelled(spark, ("2024-01-01", None, "2025-01-11", "On-going", "Infrastructure"))
    assert (r.recovered, r.overrun, r.actual_days) == (False, 1, 376)


def test_recovered_date_uses_the_median_lag(spark):
    rows = [("2024-01-01", "2024-03-11", "2024-03-01", "x", "Infrastructure"), ("2024-01-01", "2024-03-21", "2024-03-01", "x", "Infrastructure"), ("2024-01-01", "2024-08-01", None, "Completed", "Non-Infrastructure")]
    r = labelled(spark, *rows)[2]
    assert (r.recovered, r.actual_days, r.overrun, r.lag_days, r.lag_n) == (True, 198, 1, 15.0, 2)


def test_clamp_and_invalid_proxy(spark):
    lag = [("2024-01-01", "2024-03-16", "2024-03-01", "x", "Infrastructure")]
    clamped, invalid, going, nothing = labelled(spark, *lag, ("2024-01-01", "2024-01-10", None, "Completed", "Infrastructure"), ("2024-01-01", "2023-12-15", None, "Completed", "Infrastructure"), ("2024-01-01", None, None, "On-going", "Infrastructure"), ("2024-01-01", None, None, "Completed", "Infrastructure"))[1:]
    assert (clamped.clamped, clamped.actual_days, clamped.overrun) == (True, 1, 0)
    assert (invalid.clamped, invalid.overrun) == (False, None)
    assert going.overrun is None and nothing.overrun is None


@pytest.mark.parametrize(("lags", "expected"), [([10, 20, 100], (20.0, 3)), ([10], (10.0, 1)), ([], (0.0, 0)), ([1, 2], (1.5, 2))])
def test_lag_median(spark, lags, expected):
    rows = [(datetime(2024, 1, 1), pd.Timestamp(2024, 1, 1) + pd.Timedelta(days=n)) for n in lags]
    df = spark.createDataFrame([(a, b.to_pydatetime()) for a, b in rows] + [(None, datetime(2024, 1, 1))], "direct timestamp, proxy timestamp")
    assert tuple(target.lag_median(df).first()) == expected


def test_exact_link_veto_and_residual(spark):
    cols = "id long, name string, year int, place string"
    left = spark.createDataFrame([(1, "a", 1, "x"), (2, "a", 1, "y"), (3, "a", 1, None), (4, None, 1, "x")], cols)
    right = spark.createDataFrame([(10, "a", 1, "y"), (11, "a", 1, "z"), (12, None, 1, "x")], cols)
    plain = {(r.left_id, r.right_id) for r in linkage.exact_links(left, right, ["name"]).collect()}
    veto = {(r.left_id, r.right_id) for r in linkage.exact_links_with_veto(left, right, ["name"], "place").collect()}
    assert plain == {(1, 10), (2, 11)} and veto == {(2, 10), (3, 11)}
    same = lambda df: df.withColumn("place", F.lit(None).cast("string"))
    assert {(r.left_id, r.right_id) for r in linkage.exact_links_with_veto(same(left), same(right), ["name"], "place").collect()} == plain
    assert {r.id for r in linkage.residual(left, linkage.exact_links(left, right, ["name"])).collect()} == {3, 4}


def test_fuzzy_link_falls_through_and_stops_at_five(spark):
    cols = "id long, name string, year int, block string"
    left = spark.createDataFrame([(1, "abcdefghij", 2000, "b")], cols)
    names = ["abcdefghij", "abcdefghix", "abcdefgxij", "abcdefxhij", "abcdexghij", "abcdxfghij"]
    ok = lambda good: spark.createDataFrame([(10 + i, n, 2000 if i == good else 1900, "b") for i, n in enumerate(names)], cols)
    link = lambda good: [r.right_id for r in linkage.fuzzy_links(left, ok(good), "block").collect()]
    assert link(1) == [11] and link(5) == []


def test_small_stratum_has_no_outlier(spark):
    rows = [("a", float(i)) for i in range(8)] + [("a", 1e9)] + [("b", float(100 + i)) for i in range(11)] + [("b", 1e9)]
    got = features.outliers(spark.createDataFrame(rows, "k string, v double"), "v", "k").filter("outlier").collect()
    assert [(r.k, r.v) for r in got] == [("b", 1e9)]


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, b double")
    got = features.scale(df, features.fit_scaler(df, ["a", "b"]), ["a", "b"]).collect()
    assert {(r.a, r.b) for r in got} == {(0.0, 0.0), (1.0, 0.0), (None, 0.0)}


def test_sequences_pad_and_order(spark):
    events = spark.createDataFrame([("p", 2, date(2024, 1, 1), 3.0), ("p", 0, date(2024, 1, 1), 1.0)], "project_key string, event_type int, date date, amount double")
    got = {r.project_key: r for r in sequences.assemble(spark.createDataFrame([("p",), ("q",)], "project_key string"), events).collect()}
    assert [s.event_type for s in got["p"].steps] == [0, 2, -1, -1, -1] and got["p"].mask == [True, True, False, False, False]
    assert [s.days for s in got["q"].steps] == [-1] * 5 and not any(got["q"].mask)


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "y int, p double")
    assert metrics.auc(df).first()["auc"] is None
    with pytest.raises(ValueError):
        metrics.summary({})


def pool(spark, n, clusters):
    rows = [(f"PRJ_{i}", f"C{i % clusters}", "Critical" if i % 3 else "High", 1 - i / 1000, 2.5 if i % 3 else 1.0) for i in range(n)]
    return spark.createDataFrame(rows, "project_key string, cluster string, tier string, prob double, risk_weight double")


@pytest.mark.parametrize(("n", "clusters", "staff"), [(30, 2, 3), (40, 3, 2), (25, 2, 3), (30, 3, 2), (20, 2, 2)])
def test_visits_keep_all_limits(spark, n, clusters, staff):
    rows = pool(spark, n, clusters)
    plan = allocate.assign_visits(rows, [f"I{i}" for i in range(staff)])
    assert allocate.violations(plan).count() == 0
    assert allocate.schedule_summary(plan, rows).first()["visits"] == plan.count() > 0


def test_empty_pool_is_an_error(spark):
    with pytest.raises(ValueError):
        allocate.assign_visits(pool(spark, 1, 1).limit(0), ["I"])


def test_priority_fallback_is_relative(spark):
    rows = spark.createDataFrame([(f"P{i:03}", "c", "High" if i < 9 else "Low", i / 1000, "On-going") for i in range(100)], "project_key string, cluster string, tier string, prob double, status string")
    got = allocate.priority_projects(rows)
    assert got.count() == 60 and got.filter("relative and risk_weight = 1.0").count() == 60
    assert allocate.priority_projects(rows, least=9).filter("not relative").count() == 9


def test_sampled_contributions_add_up(spark):
    from pyspark.ml import Pipeline

    rows = spark.createDataFrame([(f"k{i}", float(i % 5), float(i % 3), int(i % 5 > 2)) for i in range(40)], "project_key string, a double, b double, y int").withColumn("weight", F.lit(1.0))
    fitted = Pipeline(stages=[models.assembler(["a", "b"]), models.forest(5, 3)]).fit(rows)
    back, some = rows.limit(5), rows.filter("project_key in ('k1', 'k2')")
    got = {r.project_key: r.s for r in models.sampled_contributions(fitted, some, back, ["a", "b"]).groupBy("project_key").agg(F.sum("contribution").alias("s")).collect()}
    mean = models.probability(fitted.transform(back), "f").agg(F.avg("f")).first()[0]
    for r in models.probability(fitted.transform(some), "f").collect():
        assert abs(got[r.project_key] - (r.f - mean)) < 1e-9


def test_every_row_gets_sampled_contributions(spark, data):
    from ledgerline.plans import modelling_queries

    got = modelling_queries.i21_sampled_contributions(spark, data).groupBy("project_key").agg(F.count_distinct("feature").alias("n"), F.count("contribution").alias("m")).collect()
    rows = spark.read.parquet(f"{data}/embeddings.parquet").filter("embedding is not null and label is not null")
    keys = {f"V_{r.vec_id}" for r in rows.select("vec_id").collect()}
    assert len(keys) > 10 and {(r.project_key, r.n, r.m) for r in got} == {(k, 4, 4) for k in keys}


def test_out_of_fold_rows_are_predicted_once(spark):
    from pyspark.ml import Pipeline

    rows = spark.createDataFrame([(f"k{i}", float(i), i % 2, i % 3) for i in range(30)], "project_key string, a double, y int, fold int").withColumn("weight", F.lit(1.0))
    got = models.out_of_fold(rows, lambda: Pipeline(stages=[models.assembler(["a"]), models.stacker()]), "p", 3)
    assert got.count() == got.select("project_key").distinct().count() == 30


def test_required_columns_and_import(spark, tmp_path):
    with pytest.raises(ValueError, match="lacks columns: b"):
        readers.require(spark.createDataFrame([(1,)], "a int"), ["a", "b"])
    (tmp_path / "x.csv").write_text('project_key,project_name,amount,status\n P1 ,"a, b",PHP 5.50,completed\n,x,1,y\n')
    rows = readers.read_sheet(spark, str(tmp_path / "x.csv"), ["project_key"])
    assert [tuple(r) for r in sinks.import_rows(rows, F.col("status")).collect()][0][:2] == ("P1", "a, b")


def test_missing_score_is_an_error(spark):
    with pytest.raises(KeyError):
        stream.latest_score(spark.createDataFrame([("a", 1.0)], "project_key string, prob double"), "b")


def test_unclustered_places_are_not_scheduled(spark):
    rows = spark.createDataFrame([("a", "North", 0.95, "On-going"), ("b", "Nowhere", 0.99, "On-going"), ("c", None, 0.97, "On-going"), ("d", "North", 0.96, "Complete and in use"), ("e", "North", 0.92, "For REFUND")], "project_key string, municipality string, prob double, status string")
    table = spark.createDataFrame([("North", "Cluster 1")], "municipality string, cluster string")
    placed = features.clusters(rows, table).withColumn("tier", F.lit("Critical"))
    assert {r.project_key: r.cluster for r in placed.collect()} == {"a": "Cluster 1", "b": "Unclustered", "c": "Unclustered", "d": "Cluster 1", "e": "Cluster 1"}
    assert [r.project_key for r in allocate.priority_projects(placed, least=1).collect()] == ["a"]
    assert [r.project_key for r in allocate.priority_projects(placed, least=5).collect()] == ["a"]


def test_active_projects_are_the_on_going_ones(spark):
    rows = spark.createDataFrame([("a", "on_going", 0.95), ("b", "on_going", 0.1), ("c", "refunded", 0.99), ("d", "completed", 0.99), ("e", None, 0.99)], "project_key string, status string, prob double")
    plan = spark.createDataFrame([("a", date(2024, 1, 1))], "project_key string, week_of date")
    assert tuple(reports.kpis(rows, plan).first()) == (2, 1, 1, 50.0)


def test_a_week_is_replaced_only_by_rows(spark, tmp_path):
    rows = spark.createDataFrame([("a", date(2024, 1, 1)), ("b", date(2024, 1, 1)), ("c", date(2024, 1, 8))], "project_key string, week_of date")
    path = str(tmp_path / "weeks")
    assert sinks.replace_weeks(rows, path)
    assert sinks.replace_weeks(rows.filter("project_key = 'b'"), path)
    assert not sinks.replace_weeks(rows.filter("false"), path)
    assert sorted(r.project_key for r in spark.read.parquet(path).collect()) == ["b", "c"]


def test_area_under_the_curve_by_pairs(spark):
    import random

    rng = random.Random(7)
    rows = [(rng.randint(0, 1), rng.choice([rng.random(), 0.25, 1.0, 0.0, -1.0, 2.0])) for _ in range(300)]
    pairs = [(p > q) + (p == q) / 2 for y, p in rows if y for z, q in rows if not z]
    got = metrics.auc(spark.createDataFrame([*rows, (None, 0.5), (1, None)], "y int, p double")).first()["auc"]
    assert got == pytest.approx(sum(pairs) / len(pairs))


def test_query_modules_import_alone():
    import subprocess
    import sys

    for part in ("target", "features", "modelling"):
        subprocess.run([sys.executable, "-c", f"from ledgerline.plans import {part}_queries"], check=True)


def test_quartiles_are_exact_in_any_distribution(spark):
    draw = np.random.default_rng(1)
    values = {"spread": draw.normal(5, 3, 501), "narrow": 2 + draw.random(400) / 1000, "equal": np.full(50, 1.5), "two": np.array([1.0, 2.0]), "one": np.array([3.0])}
    rows = spark.createDataFrame([(k, float(v)) for k, x in values.items() for v in x] + [("null", None), (None, 1.0)], "k string, v double")
    found = {r["k"]: (r["n"], r["q1"], r["q3"]) for r in features.quartiles(rows, "v", "k").collect()}
    assert found.keys() == values.keys()
    for k, x in values.items():
        assert found[k] == pytest.approx((len(x), np.quantile(x, 0.25), np.quantile(x, 0.75)))


def test_chained_imputation_by_hand(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(60, 3)) @ np.array([[1, 0.5, 0.2], [0, 1, 0.4], [0, 0, 1]]) + [10, -3, 100]
    gone = draw.random(x.shape) < 0.25
    full = np.where(gone, (x * ~gone).sum(0) / (~gone).sum(0), x)
    for _ in range(4):
        for j in range(3):
            z = np.column_stack([np.ones(60), np.delete(full, j, 1)])
            fit = np.linalg.lstsq(z[~gone[:, j]], x[~gone[:, j], j], rcond=None)[0]
            full[gone[:, j], j] = (z @ fit)[gone[:, j]]
    rows = [(i, *(None if g else float(v) for v, g in zip(x[i], gone[i], strict=True)), None, 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, empty double, overrun double")
    out = features.impute(df, ["a", "b", "c", "empty", "overrun"], rounds=4, fit=features.least_squares).orderBy("id").toPandas()
    assert out[["a_full", "b_full", "c_full"]].to_numpy() == pytest.approx(full)
    assert out["empty_full"].isna().all() and "overrun_full" not in out


def evidence_ridge(x, y):
    """Bayesian ridge regression row by row: intercept and coefficients."""
    xm, ym = x.mean(0), y.mean()
    x, y = x - xm, y - ym
    noise, own, last = 1 / (y.var() + np.finfo(float).eps), 1.0, None
    for _ in range(300):
        w = np.linalg.solve(x.T @ x + own / noise * np.eye(x.shape[1]), x.T @ y)
        used = np.trace(np.linalg.solve(x.T @ x + own / noise * np.eye(x.shape[1]), x.T @ x))
        own, noise = (used + 2e-6) / (w @ w + 2e-6), (len(y) - used + 2e-6) / (((y - x @ w) ** 2).sum() + 2e-6)
        if last is not None and np.abs(last - w).sum() < 1e-3:
            break
        last = w
    w = np.linalg.solve(x.T @ x + own / noise * np.eye(x.shape[1]), x.T @ y)
    return ym - xm @ w, w


def test_bayesian_imputation_by_rows_and_with_two_jobs(spark):
    draw = np.random.default_rng(9)
    x = draw.normal(size=(80, 4)) @ draw.normal(size=(4, 4)) + [1000, 0, -50, 3]
    gone = draw.random(x.shape) < 0.2
    full = np.where(gone, (x * ~gone).sum(0) / (~gone).sum(0), x)
    for _ in range(15):
        for j in range(4):
            z = np.delete(full, j, 1)
            at, w = evidence_ridge(z[~gone[:, j]], x[~gone[:, j], j])
            full[gone[:, j], j] = (at + z @ w)[gone[:, j]]
    rows = [(i, *(None if g else float(v) for v, g in zip(x[i], gone[i], strict=True))) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, d double").cache()
    df.count()
    done = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("impute"))
    jobs = []
    for rounds in (1, 15):
        before = done()
        spark.sparkContext.setJobGroup("impute", "")
        out = features.impute(df, list("abcd"), rounds=rounds)
        jobs.append(done() - before)
    spark.sparkContext.setJobGroup("rest", "")
    assert jobs[0] == jobs[1]
    got = out.orderBy("id").select(*(f"{c}_full" for c in "abcd")).toPandas().to_numpy()
    assert got == pytest.approx(full, rel=1e-6) and (got[~gone] == x[~gone]).all()


def test_damped_counts_stay_in_the_jvm(spark):
    rows = spark.createDataFrame([("road road bridge", 1.0), ("road canal", 1.0), ("", 1.0), (None, 0.0)], "text string, y double")
    terms = models.Terms().transform(rows)
    counts = CountVectorizer(inputCol="w", outputCol="w_n").fit(terms)
    counted = counts.transform(terms)
    made = models.Damped("w").transform(IDF(inputCol="w_n", outputCol="w_i").fit(counted).transform(counted))
    assert "Python" not in made._jdf.queryExecution().executedPlan().toString()
    got = [dict(zip((counts.vocabulary[i] for i in v.indices), v.values, strict=True)) for v in (r.w_f for r in made.collect())]
    idf = lambda n: 1 + np.log((4 + 1) / (n + 1))
    raw = {"road": (1 + np.log(2)) * idf(2), "bridge": idf(1), "road road": idf(1), "road bridge": idf(1)}
    norm = np.sqrt(sum(v * v for v in raw.values()))
    assert got[0] == pytest.approx({k: v / norm for k, v in raw.items()}) and got[2] == got[3] == {}


@pytest.mark.parametrize("n", [1, 2, 7, 400])
def test_lag_median_with_times_of_day(spark, n):
    draw = np.random.default_rng(n)
    lags = draw.integers(-3 * 86400, 40 * 86400, n)
    df = spark.createDataFrame([(datetime(2024, 1, 1), datetime(2024, 1, 1) + pd.Timedelta(seconds=int(s)).to_pytimedelta()) for s in lags], "direct timestamp, proxy timestamp")
    got = target.lag_median(df).first()
    assert got.lag_n == n and got.lag_days == pytest.approx(np.median(lags / 86400))


def test_veto_takes_the_first_free_row_that_agrees(spark):
    draw = np.random.default_rng(3)
    side = lambda n: [(i, f"k{draw.integers(3)}", [None, "", "x", "y", "z"][draw.integers(5)]) for i in range(n)]
    a, b = side(60), side(50)
    free, expected = list(b), set()
    for i, k, v in a:
        hit = next((r for r in free if r[1] == k and (not v or not r[2] or v == r[2])), None)
        if hit:
            free.remove(hit)
            expected.add((i, hit[0]))
    frame = lambda rows: spark.createDataFrame(rows, "id long, k string, v string")
    found = linkage.exact_links_with_veto(frame(a), frame(b), ["k"], "v").collect()
    assert {(r["left_id"], r["right_id"]) for r in found} == expected


def test_canonical_names_against_all_pairs(spark):
    names, texts = ["San Jose", "San Juan", "Santa Ana", "Sta. Ana", "Lipa"], ["san jose", "SAN JOS", "Brgy San Juan", "santa anna", "lip", "", "Elsewhere", None]
    df, known = spark.createDataFrame([(t,) for t in texts], "place string"), spark.createDataFrame([(n,) for n in names], "name string")
    found = {r["place"]: r["place_canonical"] for r in linkage.canonical(df, "place", known, 80).collect()}
    pairs = df.join(known, how="cross").select("place", "name", text.levenshtein_ratio(text.place_name("place"), text.place_name("name")).alias("s")).filter("s >= 80").collect()
    for t in texts:
        best = min(((-r["s"], r["name"]) for r in pairs if r["place"] == t), default=None)
        assert found[t] == (best[1] if best else None if t is None else one(spark, text.title(F.lit(t))))


def test_text_terms_and_classifier(spark):
    words = F.array(F.lit("ab"), F.lit("cde"))
    assert one(spark, models.char_grams(words, 4)) == [" ab ", " cde"[0:4], "cde "]
    assert one(spark, models.word_grams(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 2)) == ["a b", "b c"]
    rows = spark.createDataFrame([("road concreting of the street", 1), ("roads and street lights", 1), ("streets roadd", 1), ("", 1), ("purchase of chairs", 0), ("chairs chairs and tables", 0), ("purchased tablets", 0), (None, 0)], "text string, y int")
    fitted = models.text_classifier(8).fit(models.with_weights(rows))
    new = models.probability(fitted.transform(spark.createDataFrame([("street road",), ("purchase chairs",)], "text string")), "p").collect()
    assert new[0]["p"] > 0.5 > new[1]["p"]


def test_stack_of_three_learners(spark):
    draw = np.random.default_rng(4)
    rows = spark.createDataFrame([(f"k{i}", int(i % 3 == 0), float(i % 3 == 0) + float(draw.normal()) / 3) for i in range(90)], "project_key string, y int, f double")
    folded = sinks.reread(models.with_weights(features.stratified_folds(rows, "y", "project_key", 3)), "t")
    make = lambda learner: lambda: Pipeline(stages=[models.assembler(["f"]), learner()])
    learners = {"p1": make(lambda: models.forest(3, 2)), "p2": make(lambda: models.boosted(2, 2)), "p3": make(lambda: models.sequence_learner(1, 20))}
    out, meta = models.stack(folded, learners, 3, {"p3": lambda x: models.balanced(x, "project_key")})
    scored = models.probability(meta.transform(out), "p").toPandas()
    assert sorted(scored["project_key"]) == sorted(f"k{i}" for i in range(90))
    assert ((scored["p"] > 0.5) == (scored["y"] == 1)).mean() > 0.8


def test_feature_labels_and_matrix(spark):
    cases = {"project_type_Infrastructure": "Project Type: Infrastructure", "Year": "Release Year", "days_to_horizon": "Days To Horizon", None: None}
    found = spark.createDataFrame([(c,) for c in cases], "c string").select("c", features.label_of("c").alias("x")).collect()
    assert {r["c"]: r["x"] for r in found} == cases
    assert models.feature_matrix(spark.createDataFrame([("k", 2, None)], "k string, a int, b double"), "k", ["b", "none", "a"]).first()["x"] == [0.0, 0.0, 2.0]


def test_outliers_do_not_gather_rows_by_stratum(spark, tmp_path):
    from ledgerline.operators import features

    spark.range(50_000).selectExpr("id", "cast(id % 1000 as double) as amount", "cast(id % 3 as string) as kind").write.parquet(f"{tmp_path}/rows")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "30k")
    try:
        out = features.outliers(spark.read.parquet(f"{tmp_path}/rows"), "amount", "kind")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert out.count() == 50_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_duplicates_go_last_and_only_wanted_columns_are_staged(spark, data):
    import io
    from contextlib import redirect_stdout

    from ledgerline.plans import target_queries

    text_ = io.StringIO()
    with redirect_stdout(text_):
        target_queries.base(spark, data).explain()
    lines = [x for x in text_.getvalue().splitlines() if "Window" in x or "Join" in x]
    assert "Window " in lines[0] and any("Join" in x for x in lines)  # no row is moved again for a join after the window
    rows = target_queries.labelled(spark, data, "mon_row_id")
    assert "mon_row_id" in rows.columns and not {"municipality", "cluster", "name", "amount"} & set(rows.columns)
    whole = target.build_target(target_queries.monitoring(spark, data), target_queries.liquidation(spark, data), target_queries.FLOOR)
    kept = ["mon_row_id", "direct", "proxy", "corrected", "overrun", "overrun_pct"]
    assert sorted(map(str, whole.select(*kept).collect())) == sorted(map(str, rows.select(*kept).collect()))


def test_text_classifier_reads_each_text_once(spark, data, monkeypatch):
    from ledgerline.plans import modelling_queries
    from ledgerline.plans.testbed import table

    read = {}

    def noted(df, name):
        out = sinks.reread(df, name)
        read[name] = out.count()
        return out

    monkeypatch.setattr(models, "reread", noted)
    out = modelling_queries.i11_text_classifier(spark, data)
    assert read["texts"] == table(spark, data, "part").select("p_name").distinct().count() < out.count() == table(spark, data, "part").count()
    rows = out.join(table(spark, data, "part").select("p_partkey", F.col("p_name").alias("text")), "p_partkey")
    train = rows.filter("split = 'train' and y is not null").drop("p")
    whole = models.probability(models.text_classifier(train.count()).fit(models.with_weights(train)).transform(rows.withColumnRenamed("p", "q")), "p")
    assert whole.agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0] < 1e-3


def test_frequencies_count_copies(spark):
    rows = spark.createDataFrame([(["a", "b", "a"], 3), (["b"], 1), (["c"], 0), ([], 2)], "w array<string>, copies int")
    one = rows.filter("copies > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "_i")
    pipe = Pipeline(stages=[CountVectorizer(inputCol="w", outputCol="w_n"), IDF(inputCol="w_n", outputCol="w_i")]).fit(one)
    want = dict(zip(pipe.stages[0].vocabulary, pipe.stages[1].idf, strict=True))
    counts, scaled, _ = models.Frequencies("w").fit(rows).stages
    assert dict(zip(counts.vocabulary, scaled.getScalingVec(), strict=True)) == pytest.approx(want)
    blank = models.Frequencies("w").fit(rows.withColumn("w", F.array().cast("array<string>"))).transform(rows)
    assert blank.count() == 4


def test_sequence_learner_makes_no_other_features(spark, data, monkeypatch):
    from ledgerline.plans import modelling_queries, projects
    from ledgerline.streaming import live

    made = projects.projects(spark, data)
    columns = ["project_key", "split", "y", *live.STEP_INPUTS]
    want = made.known().filter(projects.has_steps()).select(*columns)
    written = []
    monkeypatch.setattr(projects, "reread", lambda df, name: (written.append(sinks.reread(df, name)), written[-1])[1])
    out = modelling_queries.i17_sequence_learner(spark, data)
    assert [set(x.columns) for x in written] == [set(columns)]
    assert sorted(map(tuple, written[0].select(*columns).collect())) == sorted(map(tuple, want.collect()))
    assert out.count() == want.count() > 0 and out.filter("p is null or p < 0 or p > 1").count() == 0


def test_histories_are_the_first_steps_of_events(spark, tmp_path):
    from datetime import timedelta

    from ledgerline.plans import projects
    from ledgerline.streaming import live

    draw = np.random.default_rng(6)
    at = lambda: None if draw.random() < 0.1 else datetime(2001, 1, 1) + timedelta(days=int(draw.integers(12)))
    orders = [(i, None if draw.random() < 0.1 else int(draw.integers(9)), at(), float(draw.integers(5))) for i in range(120)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    steps = []
    for key, who, day, amount in orders:
        own = sorted((o for o in orders if o[1] == who and who is not None), key=lambda o: (o[2] is not None, o[2] or datetime.min, o[0]))[:5]
        steps += [(f"PRJ_{key}", day, 0, amount)] + [(f"PRJ_{key}", o[2], 1, o[3]) for o in own if o[2] and day and o[2] < day]
    want = live.stored_steps(spark.createDataFrame(steps, "project_key string, at timestamp, kind int, amount double"))
    found = projects.histories(spark, str(tmp_path)).select(projects.keyed(), "stored")
    rows = lambda df: sorted((r["project_key"], [tuple(x) for x in r["stored"]]) for r in df.collect())
    assert rows(found) == rows(want) and len(rows(found)) > 20


def test_tree_learners_make_no_steps_and_stage_orders_once(spark, data, monkeypatch):
    import os

    from ledgerline.plans import modelling_queries, projects
    from ledgerline.streaming import live

    written = {}
    monkeypatch.setattr(projects, "reread", lambda df, name: (written.setdefault(name, []).append(sinks.reread(df, name)), written[name][-1])[1])
    before = set(os.listdir(spark.conf.get("spark.checkpoint.dir")))
    learners = []
    monkeypatch.setattr(modelling_queries.metrics, "evaluate", lambda df: learners.append(df) or df.agg(F.count("*").alias("n")))
    got = modelling_queries.held_out(spark, data, models.forest(3, 3)).first()
    made = projects.projects(spark, data, steps=False)
    assert not {"stored", *live.STEP_INPUTS} & set(made.rows.columns) and all("fold" not in x.columns for x in written["cells"])
    train, test = (made.known().filter(f"split = '{x}'") for x in ("train", "test"))
    assert got["n"] == test.count() and learners[0].filter("y = 1").count() == test.filter("y = 1").count()
    cells = models.cells(models.with_weights(train), made.features, made.cuts, ["y"])
    assert len(written["orders"]) == 2 and abs(cells.agg(F.sum("weight")).first()[0] - train.count()) < 1e-6
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(spark.conf.get("spark.checkpoint.dir"))) - before}
    assert not left & {"target-base", "orders", "projects"}  # gone once read
    fitted = made.tree_learner(models.forest(3, 3)).fit(cells)
    by_rows = sorted(r.p for r in models.probability(fitted.transform(test), "p").collect())
    alike = sorted(r.p for r in made.tree_scores(fitted, test).collect())
    assert np.allclose(alike, by_rows, atol=1e-12)


def test_fits_of_rows_run_one_at_a_time(spark):
    import threading

    running, most, lock = set(), [], threading.Lock()

    def job(key):
        def run():
            with lock:
                running.add(key)
                most.append(sum(k[1] == "p3" for k in running))
            threading.Event().wait(0.05)
            with lock:
                running.discard(key)
            return key

        return run

    keys = [(fold, name) for fold in (0, 1, None) for name in ("p1", "p3")]
    done = models.fit_all({key: job(key) for key in keys}, 4, [key for key in keys if key[1] == "p3"])
    assert done == {key: key for key in keys} and max(most) == 1


def test_shuffle_files_go_with_a_staged_write(spark):
    left = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    rows = spark.range(20_000).repartition(3, "id")
    before = left()
    staged = sinks.reread(rows, "rows")
    assert left() <= before and staged.count() == sinks.reread(rows, "rows").count() == 20_000
    assert spark.conf.get(sinks.CLEANUP) == "false"
    sinks.discard(staged)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(staged.saved_at)
