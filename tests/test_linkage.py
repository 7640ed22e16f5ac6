"""Similarity scores and their index against plain versions over all pairs; place resolver."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import text
from ledgerline.operators import linkage, similarity


def common(x, y):
    row = [0] * (len(y) + 1)
    for a in x:
        last = 0
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], last + 1 if a == b else max(row[j], row[j - 1])
    return row[-1]


def edits(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


SCORES = {
    "levenshtein": (similarity.LEVENSHTEIN, lambda x, y: 100.0 * (1 - edits(x, y) / max(len(x), len(y))) if x or y else 100.0),
    "indel": (similarity.INDEL, lambda x, y: 200.0 * common(x, y) / (len(x) + len(y)) if x or y else 100.0),
}


def fuzzed(rng, n, longest, alphabet="abcdeé𝒳 "):
    out = [""]
    while len(out) < n:
        if rng.random() < 0.5:
            out.append("".join(rng.choice(alphabet) for _ in range(rng.randrange(longest))))
        else:
            chars = list(rng.choice(out))
            for _ in range(rng.randrange(1, 4)):
                at = rng.randrange(len(chars) + 1)
                chars[at : at + rng.randrange(2)] = rng.choice(["", rng.choice(alphabet)])
            out.append("".join(chars))
    return out


@pytest.mark.parametrize("name", SCORES)
def test_scores_are_exact_and_native(spark, name):
    kind, plain = SCORES[name]
    rng = random.Random(2)
    rows = list(zip(fuzzed(rng, 150, 20) + fuzzed(rng, 40, 200, "ab "), fuzzed(rng, 150, 20) + fuzzed(rng, 40, 200, "ab "), strict=True))
    rows += [("a" * 62, "a" * 62), ("a" * 63, "a" * 125), ("ab" * 31, "ba" * 62), ("x" * 124, "y"), ("", "a"), ("a", "")]
    df = spark.createDataFrame([(*r, None) for r in rows] + [(None, "a", None), ("a", None, None)], "a string, b string, c string").withColumn("s", kind(F.col("a"), F.col("b")))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    for r in df.collect():
        assert r.s is None if r.a is None or r.b is None else r.s == pytest.approx(plain(r.a, r.b), abs=1e-9), (r.a, r.b)


@pytest.mark.parametrize("name", SCORES)
@pytest.mark.parametrize("cutoff", [30, 60, 82, 95])
def test_the_index_finds_all_pairs(spark, name, cutoff):
    kind, plain = SCORES[name]
    rng = random.Random(cutoff)
    sides = [{(rng.choice("pq"), x) for x in [*fuzzed(rng, 90, 14), *fuzzed(rng, 30, 60, "abcdefghij ")]} for _ in range(2)]
    sides[1] |= {x for x in sides[0] if rng.random() < 0.3}
    a, b = (spark.createDataFrame(sorted(x), f"block string, {n} string") for x, n in zip(sides, ("_left", "_right"), strict=True))
    found = {(r[0], r[1], r[2]) for r in similarity.pairs(a, b, "block", cutoff, kind).collect()}
    assert found == {(p, x, y) for p, x in sides[0] for q, y in sides[1] if p == q and plain(x, y) >= cutoff - 1e-9}


def test_candidates_grow_with_the_names_and_not_with_their_pairs(spark):
    """One block holds all names; each has one near copy on the other side."""
    words = ["road", "bridge", "water", "system", "school", "repair", "canal", "market", "plaza", "light", "barangay", "street", "north", "south", "upper", "lower", "rehabilitation", "concreting"]
    counts = {}
    for n in (500, 2000):
        rng = random.Random(n)
        names = sorted({f"{' '.join(rng.sample(words, 4))} {rng.randrange(10**6)}" for _ in range(n)})
        a = spark.createDataFrame([("b", x) for x in names], "block string, _left string")
        b = spark.createDataFrame([("b", x[:5] + "z" + x[6:]) for x in names], "block string, _right string")
        met = similarity.candidates(a, b, "block", 82).select("_left", "_right").cache()
        counts[n] = met.count()
        assert met.filter("substr(_left, 7) = substr(_right, 7)").count() >= n
        met.unpersist()
    assert counts[2000] < 0.02 * 2000**2 and counts[2000] / counts[500] < 16, counts


def test_resolver_takes_the_last_part_then_the_whole_text(spark):
    names = spark.createDataFrame([("San Jose",), ("Sto. Tomas",), ("Janiuay",)], "name string")
    texts = {
        "Brgy. Sto. Tomas, Janiuay": "Janiuay",
        "Brgy. Sto. Tomas": "Sto. Tomas",
        "san jose , ": "San Jose",
        "San, Jose": "San Jose",
        "Janiuay, Elsewhere": "Unmapped",
        "somewhere": "Unmapped",
        " , ,": "Unmapped",
        "": "Unmapped",
        None: "Unmapped",
        "JANIUAI": "Janiuay",
    }
    df = spark.createDataFrame([(t,) for t in texts] * 2, "place string")
    got = linkage.resolved(df, "place", names, 80).collect()
    assert len(got) == 2 * len(texts) and {r.place: r.place_resolved for r in got} == texts


def test_resolver_keeps_digits_at_the_ends_of_parts(spark):
    names = spark.createDataFrame([("Zone 2",), ("Zone 20",), ("Zone 1",), ("Zone 11",), ("0 Point",)], "name string")
    texts = {"zone 20": "Zone 20", "Market, Zone 11": "Zone 11", "Market, Hall, Zone 2": "Zone 2", "x, Zone 1 ,": "Zone 1", "0 point": "0 Point", "Market 0, Nowhere 1": "Unmapped"}
    df = spark.createDataFrame([(t,) for t in texts], "place string")
    assert {r.place: r.place_resolved for r in linkage.resolved(df, "place", names, 95).collect()} == texts


def test_scored_names_of_awkward_tables(spark):
    cols = "id long, name string, brand string"
    empty = spark.createDataFrame([], cols)
    rows = spark.createDataFrame([(1, None, "x"), (2, "a b", None), (3, "...", "x"), (4, "b a", "x"), (4, "b a", "x")], cols)
    assert linkage.scored_names(empty, rows, "brand", 70).count() == linkage.scored_names(rows, empty, "brand", 70).count() == 0
    for kind in (similarity.LEVENSHTEIN, similarity.INDEL):
        assert sorted((r._left, r._right, r.score) for r in linkage.scored_names(rows, rows, "brand", 70, kind).collect()) == [("", "", 100.0), ("a b", "a b", 100.0)]
    assert [r.s for r in spark.range(1).select(text.levenshtein_ratio(F.lit(""), F.lit("")).alias("s")).collect()] == [100.0]


def test_candidates_of_rows_with_one_name_are_not_multiplied(spark):
    n = 40_000  # products of rows would be 400 million
    rows = spark.range(n).select("id", F.concat(F.lit("big ring"), F.when(F.col("id") % 3 == 0, "s").otherwise("")).alias("name"), F.lit("x").alias("brand"), (F.col("id") % 40).cast("int").alias("year"))
    left, right = rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1")
    late = threading.Timer(90, spark.sparkContext.cancelAllJobs)
    late.start()
    got = {r.left_id: (r.right_id, r.match_score) for r in linkage.fuzzy_links(left, right, "brand", 60, 5, 10).collect()}
    pairs = linkage.top_candidates(left, right, "brand", 60, 5).count()
    late.cancel()
    assert pairs == 5 * n // 2
    names = {i: "big rings" if i % 3 == 0 else "big ring" for i in range(n)}
    want = {}
    for i in range(0, n, 2):
        top = sorted((-100.0 * (names[i] == names[j]) - 100.0 * (1 - 1 / 9) * (names[i] != names[j]), j) for j in range(1, 40, 2))[:5]
        near = [(j, -s) for s, j in top if abs(i % 40 - j % 40) <= 10]
        if near:
            want[i] = (near[0][0], pytest.approx(near[0][1], abs=1e-6))
    assert got == want
