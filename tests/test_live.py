"""Report streams: sequence state, scores by stored models, delivery, against finished tables and plain versions."""

import random
from datetime import datetime, timedelta
from itertools import combinations
from math import comb
from pathlib import Path

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from ledgerline.operators import contributions, features, models
from ledgerline.sources import bucketed, sinks
from ledgerline.streaming import delivery, live, visits

REPORT = "report_id long, project_key string, observed_at timestamp, status_observed string, amount_spent double, reason string"
NAMES = ["amount", "days_since_release", "status_A", "status_B"]
STATUSES = {"Done": "status_A", "Going": "status_B", "Odd": "status_C"}


def feed(seed=1, n=60):
    rng = random.Random(seed)
    at = lambda: datetime(2024, 1, 1) + timedelta(hours=rng.randrange(900))
    return [(i, f"p{rng.randrange(7)}", at(), rng.choice(["Done", "Going", "Odd", None]), rng.choice([None, float(i)]), "bad" if i % 17 == 0 else None) for i in range(n)]


def splits(rows):
    """In order of time, in order of ids by halves, and shuffled a few at a time with some delivered again."""
    rng = random.Random(4)
    timed = sorted(rows, key=lambda r: (r[2], r[0]))
    mixed = rng.sample(rows, len(rows))
    return {"timed": [timed[:25], timed[25:]], "halves": [rows[::2], rows[1::2]], "mixed": [mixed[i : i + 12] + mixed[:3] for i in range(0, len(mixed), 12)]}


@pytest.fixture(scope="module")
def projects(spark):
    rng = np.random.default_rng(3)
    rows, steps = [], []
    for i in range(80):
        key = f"p{i}"
        rows.append((key, i == 5, datetime(2023, 1 + i % 12, 1), float(rng.normal()), float(rng.random()), i % 2, 1 - i % 2, int(rng.random() < 0.4 + 0.4 * (i % 2))))
        steps += [(key, datetime(2023, 1, 1 + k), k % 2, float(rng.random() * 9)) for k in range(i % 4)]
    stored = live.stored_steps(spark.createDataFrame(steps, "project_key string, at timestamp, kind int, amount double"))
    df = spark.createDataFrame(rows, "project_key string, resolved boolean, released timestamp, amount double, days_since_release double, status_A int, status_B int, y int")
    return sinks.reread(df.join(stored, "project_key", "left").withColumn("stored", F.coalesce("stored", F.array().cast(visits.STEPS))), "t")


@pytest.fixture(scope="module")
def stack(spark, projects, tmp_path_factory):
    rows = live.with_inputs(projects.withColumn("steps", F.col("stored")))
    rows = sinks.reread(models.with_weights(features.stratified_folds(rows, "y", "project_key", 2)), "t")
    make = lambda columns, learner: lambda: Pipeline(stages=[models.assembler(columns), learner()])
    learners = {"p1": make(NAMES, lambda: models.forest(5, 3)), "p2": make(NAMES, lambda: models.boosted(3, 2)), "p3": make(live.STEP_INPUTS, lambda: models.sequence_learner(len(live.STEP_INPUTS), 10))}
    out, meta = models.stack(rows, learners, 2, {}, "p3", F.size("stored") > 0)
    lone = out.filter("size(stored) = 0").selectExpr("max(abs(p3 - (p1 + p2) / 2)) as gap", "count(*) as n").first()
    assert lone.gap < 1e-12 and lone.n > 10
    made = models.Stack({name: make().fit(rows) for name, make in learners.items()}, meta, 0.0, 400.0)
    path = str(tmp_path_factory.mktemp("stack"))
    made.save(path)
    loaded = models.Stack.load(path)
    a, b = (sorted(tuple(r) for r in m.score(rows, F.size("stored") > 0).select("project_key", "p1", "p2", "p3", "prob").collect()) for m in (made, loaded))
    assert a == b and (loaded.low, loaded.high, list(loaded.base)) == (0.0, 400.0, ["p1", "p2", "p3"])
    return loaded


def run(spark, tmp_path, name, parts, plan, sink, schema=REPORT, mode="update"):
    path = str(tmp_path / f"in-{name}")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(path)
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(path)
    job = plan(rows).writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / f"c-{name}")).foreachBatch(sink).trigger(availableNow=True).start()
    job.awaitTermination()
    return job


def test_sequences_are_those_of_the_finished_table(spark, tmp_path):
    rows, start = feed(), datetime(2023, 5, 5)
    stored = F.when(F.col("project_key") == "p1", F.array(F.struct(F.lit(start).alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("report_id"), F.lit(3.0).alias("amount")))).otherwise(F.array()).cast(visits.STEPS)
    expect = {(r.project_key, r.report_id): str(r.steps) for r in visits.sequences_as_of(spark.createDataFrame(rows, REPORT).withColumn("stored", stored)).collect()}
    newest = {}
    for i, p, t, *_ in rows:
        newest[p] = max(newest.get(p, (t, i)), (t, i))
    visits.keyed_state(spark)
    for name, parts in splits(rows).items():
        got = {}
        job = run(spark, tmp_path, name, parts, lambda x: visits.visit_sequences(x.withColumn("stored", stored)), lambda batch, _, got=got: got.update({(r.project_key, r.report_id): str(r.steps) for r in batch.collect()}))
        assert set(got) == set(expect)
        for p, (_, i) in newest.items():
            assert got[p, i] == expect[p, i], name
        if name == "timed":
            assert got == expect
        assert "rocksdbCommitCheckpointLatency" in str(job.lastProgress) or "rocksdb" in str(job.lastProgress)
    for r in visits.sequences_as_of(spark.createDataFrame(rows, REPORT).withColumn("stored", stored)).collect():  # by hand
        own = sorted((t, 2, i) for i, p, t, *_ in rows if p == r.project_key and (t, i) <= (r.observed_at, r.report_id))
        assert [(s.at, s.kind, s.report_id) for s in r.steps] == [*([(start, 0, None)] if r.project_key == "p1" else []), *own][:5]


def test_a_finished_project_expires(spark, tmp_path):
    visits.keyed_state(spark)
    row = lambda i, day, status: (i, "p", datetime(2024, 1, day), status, 1.0, None)
    got = []
    parts = [[row(1, 1, "Going")], [row(2, 2, "Completed")], [(9, "other", datetime(2024, 1, 1), "Going", 1.0, None)], [row(3, 3, "Going")]]
    run(spark, tmp_path, "expiry", parts, lambda x: visits.visit_sequences(x.withColumn("stored", F.array().cast(visits.STEPS)), grace_ms=1), lambda batch, _: got.extend((r.report_id, [s.report_id for s in r.steps]) for r in batch.collect()))
    assert got == [(1, [1]), (2, [1, 2]), (9, [9]), (3, [3])]


def test_scores_are_those_of_the_finished_table(spark, projects, stack, tmp_path):
    rows, flags = feed(2, 40) + [(900, "nobody", datetime(2024, 1, 1), "Done", 1.0, None)], ["status_A", "status_B"]
    columns = ["project_key", "report_id", "p1", "p2", "p3", "prob", "tier", "fallback"]
    table = live.score_table(spark.createDataFrame(rows, REPORT), projects.drop("y"), stack, STATUSES, flags)
    every = {(r.project_key, r.report_id): tuple(r) for r in table.select(*columns).collect()}
    assert not {k for k in every if k[0] in ("p5", "nobody")} and {x[-1] for x in every.values()} == {True, False}
    assert all(abs(x[4] - (x[2] + x[3]) / 2) < 1e-12 for x in every.values() if x[-1])
    valid = {(p, (t, i)) for i, p, t, _, _, reason in rows if reason is None and (p, i) in every}
    expect = {p: every[p, max(x for q, x in valid if q == p)[1]] for p, _ in valid}
    visits.keyed_state(spark)
    for name, parts in splits(rows).items():
        at = bucketed.BucketTable.create(spark.createDataFrame([], live.SCORE), str(tmp_path / f"t-{name}"), "project_key", 4)
        run(spark, tmp_path, name, parts, lambda x: live.score_stream(x, projects.drop("y"), stack, STATUSES, flags), live.score_sink(at, every=2))
        got = {r.project_key: tuple(r) for r in live.latest(at.now()).select(*columns).collect()}
        assert got == expect, name
        one = next(iter(expect))
        assert [tuple(r) for r in at.now().look_up(one, live.newest).select(*columns).collect()] == [expect[one]]


def test_observed_status_and_days(spark, stack):
    cols = "project_key string, observed_at timestamp, released timestamp, status_observed string, days_since_release double, status_A int, status_B int"
    day = datetime(2024, 1, 11)
    rows = [("a", day, datetime(2024, 1, 1), "Done", 0.5, 0, 1), ("b", day, None, "Odd", 0.5, 0, 1), ("c", day, datetime(2020, 1, 1), None, 0.5, 1, 0), ("d", day, datetime(2025, 1, 1), "Going", 0.5, 1, 0)]
    got = live.observed(spark.createDataFrame(rows, cols), stack, STATUSES, ["status_A", "status_B"]).select("days_since_release", "status_A", "status_B").collect()
    assert [tuple(r) for r in got] == [(10 / 400, 1, 0), (0.5, 0, 1), (1.0, 1, 0), (0.0, 0, 1)]


def test_each_report_is_delivered_once(spark, tmp_path):
    visits.keyed_state(spark, evolving=False)
    when = lambda text: datetime.fromisoformat(text) if text else None
    batches = [[(1, "2026-06-01"), (2, None), (1, "2026-06-01")], [(3, "2026-01-01"), (2, None)], [(1, "2026-06-01"), (4, "2020-01-01")], [(3, "2026-01-01"), (4, "2020-01-01"), (5, "2019-01-01")]]
    parts = [[(i, "a", when(t)) for i, t in part] for part in batches]
    schema = "report_id long, project_key string, observed_at timestamp"
    for keep in ("1 hour", "0 seconds"):  # known from state; known from the table of ids alone
        sink = delivery.Once(spark, str(tmp_path / keep.replace(" ", "")), schema)
        seen = []

        def both(batch, number, sink=sink, seen=seen):
            batch = batch.persist()
            sink(batch, number)
            sink(batch, number)  # a batch that is run again
            seen.append(number)

        job = run(spark, tmp_path, keep.replace(" ", ""), parts, lambda x, keep=keep: delivery.recent(x, keep), both, schema, "append")
        assert sorted(r.report_id for r in sink.delivered().collect()) == [1, 2, 3, 4, 5] and len(seen) >= 4
        state = job.lastProgress["stateOperators"][0]
        assert state["numRowsTotal"] <= (5 if keep == "1 hour" else 3) and "rocksdb" in str(state["customMetrics"]).lower()
    files = [f for f in sink.ids(["2026-01-01"], 99).inputFiles()]
    assert files and all("_slot=2026-01-01/" in f for f in files) and sink.ids(["1999-01-01"], 99) is None


# ---------------------------------------------------------------- contributions of tree models


def shapley(f, x, background):
    """By all subsets of features."""
    n = len(x)
    value = {}
    for r in range(n + 1):
        for s in combinations(range(n), r):
            rows = background.copy()
            rows[:, list(s)] = x[list(s)]
            value[s] = f(rows).mean()
    return np.array([sum((value[tuple(sorted((*s, i)))] - value[s]) / (n * comb(n - 1, len(s))) for s in value if i not in s) for i in range(n)])


@pytest.mark.parametrize("learner", [lambda: models.forest(4, 4), lambda: models.boosted(4, 3)])
def test_tree_contributions_are_shapley_values(spark, learner):
    rng = np.random.default_rng(6)
    names = ["a", "b", "c", "d"]
    data = [(f"k{i}", *map(float, r), int(r[0] + r[1] * r[2] > rng.normal() / 4)) for i, r in enumerate(rng.normal(size=(200, 4)).round(1))]
    df = models.with_weights(spark.createDataFrame(data, "project_key string, a double, b double, c double, d double, y int"))
    fitted = Pipeline(stages=[models.assembler(names), learner()]).fit(df)
    paths = contributions.paths_of(fitted)
    x = np.array([r[1:5] for r in data])
    own = {r.project_key: r.p for r in models.probability(fitted.transform(df), "p").collect()}
    p = paths.probabilities(paths.margins(x))
    assert np.allclose(p, [own[r[0]] for r in data], atol=1e-9)
    back = x[:40]
    got = contributions.contributions(paths, x[40:60], back)
    assert np.allclose(got.sum(1), p[40:60] - p[:40].mean(), atol=1e-9)
    if not paths.link:
        for i in range(20):
            assert np.allclose(got[i], shapley(lambda r: paths.margins(r), x[40 + i], back), atol=1e-9)
    else:  # a margin's values are exact for each pair of rows, and go over to the probability in proportion
        for i in range(5):
            pairs = []
            for z in range(40):
                phi, gap = shapley(lambda r: paths.margins(r), x[40 + i], back[z : z + 1]), paths.margins(x[40 + i : 41 + i])[0] - paths.margins(back[z : z + 1])[0]
                pairs.append(phi * ((p[40 + i] - p[z]) / gap if abs(gap) > 1e-12 else 2 * p[40 + i] * (1 - p[40 + i])))
            assert np.allclose(got[i], np.mean(pairs, 0), atol=1e-9)
    table = contributions.tree_contributions([fitted], df, df, names, most=30).groupBy("project_key").agg(F.sum("contribution").alias("s"), F.count("*").alias("n")).collect()
    chosen = [r.project_key for r in df.orderBy(F.xxhash64("project_key"), "project_key").limit(30).collect()]
    mean = np.mean([own[k] for k in chosen])
    assert len(table) == 200 and all(r.n == 4 and abs(r.s - (own[r.project_key] - mean)) < 1e-9 for r in table)


def test_small_classes_are_refused_and_categories_found(spark):
    df = spark.createDataFrame([(i, int(i < 2), "x" if i % 2 else None, f"c{i % 3}") for i in range(20)], "k int, y int, a string, b string")
    with pytest.raises(ValueError, match="1 \\(2\\)"):
        features.stratified_folds(df, "y", "k", 3)
    assert features.stratified_folds(df, "y", "k", 2).count() == 20
    made, names = features.one_hot_frame(df, ["a", "b"], with_null=["a"])
    assert names == ["a_x", "a_null", "b_c0", "b_c1", "b_c2"]
    assert made.select(F.min(F.expr("a_x + a_null")), F.max(F.expr("b_c0 + b_c1 + b_c2"))).first() == (1, 1)


def test_feed_has_three_batches_however_many_files(spark, data, tmp_path):
    from ledgerline.plans import streams_queries

    spark.read.parquet(f"{data}/events.parquet").repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")  # a task for each file
    try:
        out = streams_queries.run(streams_queries.stream(spark, str(tmp_path)))
        assert {r.batch for r in out.select("batch").distinct().collect()} == {0, 1, 2}
        assert out.count() == spark.read.parquet(f"{data}/events.parquet").count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_known_ids_are_not_broadcast(spark, tmp_path):
    from ledgerline.streaming import delivery, reports

    rows = spark.range(50).selectExpr("id as report_id", "'p' as project_key", "'x' as status_observed", "1.0D as percent_complete", "1.0D as amount_spent", "timestamp '2024-01-01 10:00:00' as observed_at")
    sink = delivery.Once(spark, str(tmp_path), reports.SCHEMA)
    sink(rows, 0)
    sink(rows.union(rows.withColumn("report_id", rows.report_id + 50)), 1)
    assert sorted(r.report_id for r in sink.delivered().collect()) == list(range(100))
    known = rows.withColumn("_slot", delivery.slot()).join(sink.ids(["2024-01-01"], 2), ["_slot", "report_id"], "left_anti")
    assert "Broadcast" not in known._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("learner", [lambda: models.forest(4, 4), lambda: models.boosted(4, 3)])
def test_learners_of_cells_and_their_contributions(spark, learner):
    rng = np.random.default_rng(8)
    data = [(f"k{i}", None if i % 97 == 0 else float(rng.normal()), i % 3, i % 2) for i in range(3000)]
    data = [(k, a, b, int((a or 2.0) + b > rng.normal() + 1), fold) for k, a, b, fold in data]
    df = models.with_weights(spark.createDataFrame(data, "project_key string, a double, b int, y int, fold int"))
    cuts = models.cut_points(df, ["a"], 8)
    cells = models.cells(df, ["a", "b"], cuts).cache()
    n, total = cells.agg(F.count("*"), F.sum("weight")).first()
    assert len(cuts["a"]) == 7 and n <= 9 * 3 * 2 * 2 and abs(total - 3000) < 1e-6  # all rows count, few are read
    fitted = Pipeline(stages=[*models.binned(["a", "b"], cuts), learner()]).fit(cells)
    scored = {r.project_key: r.p for r in models.probability(fitted.transform(df), "p").collect()}
    assert len(scored) == 3000
    paths, known = contributions.paths_of(fitted), [r for r in data if r[1] is not None]
    x = np.array([r[1:3] for r in known], float)
    assert np.allclose(paths.probabilities(paths.margins(x)), [scored[r[0]] for r in known], atol=1e-9)
    table = contributions.tree_contributions([fitted], df.filter("a is not null"), df.filter("a is not null"), ["a", "b"], most=20).collect()
    got = {(r.project_key, r.feature): (r.contribution, r.raw_value) for r in table}
    back = np.array([[r.a, r.b] for r in df.filter("a is not null").orderBy(F.xxhash64("project_key"), "project_key").limit(20).collect()])
    want = contributions.contributions(paths, x, back)
    assert len(got) == len(table) == 2 * len(known)
    for r, w in zip(known, want, strict=True):
        assert np.allclose([got[r[0], "a"][0], got[r[0], "b"][0]], w, atol=1e-12) and (got[r[0], "a"][1], got[r[0], "b"][1]) == r[1:3]


def test_feed_is_packed_and_resolved_projects_are_not_moved(spark, data, projects, stack, tmp_path):
    import io
    from contextlib import redirect_stdout

    from ledgerline.plans import streams_queries

    streams_queries.stream(spark, data)
    path = max((p for p in Path(spark.conf.get("spark.checkpoint.dir")).glob("feed-*")), key=lambda p: p.stat().st_mtime)
    files = [p.name for p in path.iterdir() if p.name.startswith("part-")]
    assert files and all(x.endswith(".json.gz") for x in files)
    text = io.StringIO()
    with redirect_stdout(text):
        steps = visits.sequences_as_of(live.known_open(spark.createDataFrame([], REPORT), projects))
        live.scored(steps, projects, stack, STATUSES, ["status_A", "status_B"]).explain()
    assert text.getvalue().count("NOT resolved") >= 2
