"""Merkle manifests and fill-in-the-middle against plain versions."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import infill, merkle, registry

ROW = "doc_id long, text string, lang string, source string, n_chars long, leaf string, key int, size int, pos string, n string, output int, form int"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(spec):
    return [(i, text, lang, source, None if text is None else len(text), "x", 1, 2, "y", "z", 3, 4) for i, text, lang, source in spec]


@pytest.fixture(scope="module")
def spec():
    rng = random.Random(3)
    out = []
    for source, n in ((None, 4), ("a", 1), ("é", 30), ("hot", 200), ("Z", 9), ("", 2), ("z" * 40, 27)):
        for _ in range(n):
            text = rng.choice([None, "", "one line", "two\nlines\n", "\n", "日本\n\n語\r\n𝒳 end", "x" * 2000 + "\ny"])
            out.append((len(out) * 7 + 1, text, rng.choice([None, "en"]), source))
    rng.shuffle(out)
    return out


def plain_manifest(spec, arity=3):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, t, lang, s: sha("".join(map(field, (i, s, lang, None if t is None else len(t), t))))

    def climb(nodes):
        sides = [[] for _ in nodes]
        at, level = list(range(len(nodes))), nodes
        while len(level) > 1:
            for k, p in enumerate(at):
                run = p - p % arity
                sides[k].append((level[run:p], level[p + 1 : run + arity]))
            level = [sha("".join(level[i : i + arity])) for i in range(0, len(level), arity)]
            at = [p // arity for p in at]
        return level[0], sides

    groups = defaultdict(list)
    for row in spec:
        groups[row[3]].append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    done = {s: climb([leaf(*r) for r in sorted(groups[s], key=lambda r: (r[0], leaf(*r)))]) for s in order}
    root, upper = climb([done[s][0] for s in order])
    out = {}
    for s, above in zip(order, upper, strict=True):
        for r, sides in zip(sorted(groups[s], key=lambda r: (r[0], leaf(*r))), done[s][1], strict=True):
            i, t, lang, _ = r
            ways = [*sides, *above]
            text = t.replace("\n", "") if t is not None and zlib.crc32(str(i).encode()) % 2 == 0 else t
            digest = sha("".join(map(field, (i, s, lang, None if t is None else len(t), text))))
            for a, b in ways:
                digest = sha("".join([*a, digest, *b]))
            out[i] = (leaf(*r), done[s][0], root, sha("".join(x for a, b in ways for x in a + b)), digest, digest == root)
    return out


@pytest.mark.parametrize("depth", [1, 2, 6])
def test_manifest_by_brute_force(spark, spec, depth):
    docs = spark.createDataFrame(rows_of(spec), ROW)
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = {"text": F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    got = merkle.manifest(docs, FIELDS, changed, with_nodes=True, depth=depth).collect()
    expect = plain_manifest(spec)
    assert len(got) == len(spec)
    for r in got:
        assert (r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) == expect[r.doc_id], r.doc_id
        assert r.copied[0] == r.new_leaf and r.copied[-1] == r.folded_root and len(r.copied) == len(r.siblings) + 1
    assert {r.verified for r in got} == {True, False}


def test_a_version_shares_all_but_its_ancestors():
    tree = merkle.Tree([sha(str(i)) for i in range(25)])
    before = [list(level) for level in tree.levels]
    a, b = merkle.Version(tree, 7, sha("new")), merkle.Version(tree, 24, sha("other"))
    assert tree.levels == before and len(a.copied) == len(tree.levels)
    for version, at, new in ((a, 7, "new"), (b, 24, "other")):
        rebuilt = merkle.Tree([sha(new) if i == at else sha(str(i)) for i in range(25)])
        for level, nodes in enumerate(rebuilt.levels):
            assert nodes == [version.node(level, i) for i in range(len(nodes))]
            assert sum(x != y for x, y in zip(nodes, tree.levels[level], strict=True)) == 1
        assert version.root == rebuilt.root == merkle.folded(sha(new), tree.sides(at))


def test_manifest_of_awkward_tables(spark):
    empty = spark.createDataFrame([], ROW)
    assert merkle.manifest(empty, FIELDS).count() == 0
    one = merkle.manifest(spark.createDataFrame(rows_of([(5, None, None, None)]), ROW), FIELDS).collect()[0]
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == sha("") and one.verified
    same = [(1, "a\n", None, "s")] * 3 + [(1, "b", None, "s"), (None, "c", None, "s"), (2, None, None, None)]
    got = merkle.manifest(spark.createDataFrame(rows_of(same), ROW), FIELDS).collect()
    assert len(got) == 6 and all(r.verified for r in got) and len({r.root for r in got}) == 1
    again = merkle.manifest(spark.createDataFrame(rows_of(same[::-1]), ROW), FIELDS).collect()
    assert sorted(r.proof_sha256 for r in got) == sorted(r.proof_sha256 for r in again)
    moved = merkle.manifest(spark.createDataFrame(rows_of(same), ROW), FIELDS, {"lang": F.lit("en")}).collect()
    assert not any(r.verified for r in moved)


def plain_infill(i, text, seed=7, percent=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest, n = sha(f"{seed}:{'' if i is None else i}"), len(units)
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_infill_by_brute_force(spark):
    rng = random.Random(11)
    line = lambda: "".join(rng.choice(["a", "Z", " ", "\r", "$1", "\\", "<", "P>", "é", "𝒳", " ", "\\E", "{2}"]) for _ in range(rng.randrange(12)))
    texts = [None, "", "\n", "\n\n\n", "no end", "<P>", "x<M>y", "a<S", "<", "$0\\"] + ["\n".join(line() for _ in range(rng.randrange(9))) for _ in range(300)]
    texts += ["word and word\n" * 60_000, "x" * 1_000_000, "\n" * 100_000]
    spec = [(None if k % 50 == 3 else k * 11, t, None, None) for k, t in enumerate(texts)]
    spec += spec[:3]
    docs = spark.createDataFrame(rows_of(spec), ROW)
    for percent, spm in ((100, 50), (60, 0), (0, 100)):
        got = infill.fill_in_middle(docs, percent=percent, spm_percent=spm).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
        key = lambda x: tuple(map(str, x))
        expect = [(i, *plain_infill(i, t, percent=percent, spm=spm), t or "") for i, t, _, _ in spec]
        assert sorted(map(tuple, got), key=key) == sorted(expect, key=key)


def test_infill_stays_in_the_jvm_and_checks_marks(spark):
    docs = spark.createDataFrame(rows_of([(1, "a\nb\nc", None, None)]), ROW)
    plan = infill.fill_in_middle(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    other = infill.fill_in_middle(docs, marks=("$1", "\\E", "(?")).select(infill.restored(F.col("output"), F.col("form"), ("$1", "\\E", "(?"))).first()[0]
    assert other == "a\nb\nc"
    for marks in (("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("aba", "q", "z"), ("", "a", "b"), ("<P>", "P", "<M>")):
        with pytest.raises(ValueError):
            infill.fill_in_middle(docs, marks=marks)
    assert infill.fill_in_middle(spark.createDataFrame([], ROW)).count() == 0


@pytest.mark.parametrize("name", ["op12_merkle_manifest", "op13_fill_in_middle"])
def test_queries_match_sql(spark, data, name):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    ours, theirs = registry.QUERIES[name](spark, data).toPandas(), db.sql(registry.ORACLES[name]).df()
    assert len(ours) and sorted(ours.columns) == sorted(theirs.columns)
    ours, theirs = (df[sorted(df.columns)].sort_values("doc_id", ignore_index=True).astype(object) for df in (ours, theirs))
    assert ours.where(ours.notna(), None).equals(theirs.where(theirs.notna(), None))
