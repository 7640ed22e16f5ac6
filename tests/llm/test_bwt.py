"""Transforms built column by column, and the removal of shared byte strings, against brute force."""

import hashlib
import random

import numpy as np
import pytest

from ledgerline.llm import bwt

SCHEMA = "doc_id long, text string, n_bytes int, n_spans string, kept binary, string string, key int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", b"y", "z", 2) for i, t in rows], SCHEMA)


def brute(rows, length):
    first = {}
    for i, t in rows:
        if i is not None:
            raw = (t or "").encode()
            for s in range(len(raw) - length + 1):
                w = raw[s : s + length]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        if i is not None:
            for s in range(len(raw) - length + 1):
                if first[raw[s : s + length]] < i:
                    gone[s : s + length] = True
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        turns = np.flatnonzero(np.diff(np.concatenate([[0], gone[:-1].astype(int), [0]])))
        out.append((i, len(raw), int(gone.sum()), len(turns) // 2, hashlib.sha256(kept).hexdigest(), kept, [tuple(x) for x in turns.reshape(-1, 2).tolist()]))
    return out


def ours(df):
    return [(r[0], r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept), [(x.first, x.end) for x in r.spans]) for r in df.collect()]


def same(got, expect):
    key = lambda r: (r[0] is None, r[0] or 0, r[4], r[2])
    assert sorted(got, key=key) == sorted(expect, key=key)


def plain(strings):
    """Transform, common prefixes and owners of all suffixes; ends differ and come before all bytes, in the order of strings."""
    suffixes = sorted(([*((1, b) for b in s[k:]), (0, i)], i, k) for i, s in enumerate(strings) for k in range(len(s) + 1))
    transform = [strings[i][k - 1] + 1 if k else 0 for _, i, k in suffixes]
    common = [0]
    for (a, _, _), (b, _, _) in zip(suffixes, suffixes[1:], strict=False):
        n = 0
        while a[n] == b[n]:
            n += 1
        common.append(n)
    return transform, common


@pytest.mark.parametrize("alphabet", [b"a", b"ab", bytes(range(0xF5))])
def test_columns_make_the_transform_and_common_prefixes(alphabet):
    rng = random.Random(len(alphabet))
    for _ in range(20):
        strings = [bytes(rng.choice(alphabet) for _ in range(rng.randrange(1, 20))) for _ in range(rng.randrange(1, 12))]
        strings += strings[:1]
        made = bwt.Collection(np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings], np.uint8))
        rounds = 0
        while made.insert():
            rounds += 1
            made = bwt.Collection.read(made.rounds, *made.written())
            short = [s[-rounds:] for s in strings]  # the transform so far is that of the ends, but for what stands before them
            assert made.lcp.tolist() == plain(short)[1]
        transform, common = plain(strings)
        assert rounds == max(map(len, strings)) and made.bwt.tolist() == transform and made.lcp.tolist() == common
        for length in (1, 3):
            got = {}
            for who, nth, kind in zip(*made.windows(length), strict=True):
                got.setdefault(int(kind), set()).add(strings[who][nth : nth + length])
            assert all(len(x) == 1 for x in got.values()) and len(got) == len({s[k : k + length] for s in strings for k in range(len(s) - length + 1)})


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "été", "日本", "the", "of", "and", "zeta", "\n", "\0"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [text(rng.choice([2, 20, 80])) for _ in range(30)]
    passage, phrase = text(25), "a phrase that very many of these texts have "
    texts = [None, "", "x", "a" * 49, "a" * 50, "a" * 300, "b" + "a" * 120, "ab" * 200, "y" * 50 + "a" * 60, *base, *base[:5]]
    texts += [b[:40] + passage + b[40:] for b in base[10:20]] + [f"{text(3)} {phrase} {text(3)}" for _ in range(60)]
    texts += [base[3] + base[3], base[4] + "!" + base[5], text(3000), "q" * 40_000]
    texts += [texts[-2][5000:9000]]
    ids = rng.sample(range(-50, 500), len(texts))
    out = list(zip(ids, texts, strict=True))
    return out + [out[40], (out[41][0], base[7]), (None, base[0]), (None, None), (7000, base[0])]


@pytest.mark.parametrize("length", [24, 50, 77])
def test_shared_strings_go_as_by_brute_force(spark, rows, length):
    same(ours(bwt.remove_shared(frame(spark, rows), length)), brute(rows, length))


@pytest.mark.parametrize("hot, shard, columns", [(3, 500, 7), (0, 200, 200), (20, 4000, 31)])
def test_hot_anchors_small_collections_and_passes(spark, rows, hot, shard, columns):
    same(ours(bwt.remove_shared(frame(spark, rows), 50, hot=hot, shard_bytes=shard, columns=columns)), brute(rows, 50))


def test_awkward_tables(spark, rows):
    assert bwt.remove_shared(frame(spark, [])).count() == 0
    same(ours(bwt.remove_shared(frame(spark, [(None, None), (1, None), (2, "")]))), brute([(None, None), (1, None), (2, "")], 50))
    equal = [(1, rows[20][1] * 3), (1, rows[20][1] * 3), (1, rows[20][1] * 2), (2, rows[20][1] * 3)]
    same(ours(bwt.remove_shared(frame(spark, equal))), brute(equal, 50))
    assert "kept" not in bwt.remove_shared(frame(spark, equal), with_text=False).columns
    for bad in ({"length": 10}, {"id_col": "text"}):
        with pytest.raises(ValueError):
            bwt.remove_shared(frame(spark, equal), **bad)


def test_words_of_a_colliding_form_stay_apart(spark):
    word = lambda a, b: "".join(b if bin(i).count("1") % 2 else a for i in range(1024))
    twins = [(1, word("a", "b")), (2, word("b", "a")), (3, word("c", "d")), (4, f"{word('d', 'c')} {word('c', 'd')}")]
    same(ours(bwt.remove_shared(frame(spark, twins))), brute(twins, 50))


def test_the_query(spark, data):
    got = bwt.op11_suffix_array_dedup(spark, data).toPandas().sort_values("doc_id", ignore_index=True)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    expect = sorted(brute([(r.doc_id, r.text) for r in docs], 50))
    assert list(map(tuple, got[["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]].itertuples(index=False))) == [x[:5] for x in expect]


def test_places_are_dealt_and_matched_as_arrays():
    rng = np.random.default_rng(5)
    key, name, own = (rng.integers(-(2**63), 2**63 - 1, 500) for _ in range(3))
    name[250:] = name[:250]  # names of different strings that fall together
    prints, place = rng.integers(-(2**31), 2**31 - 1, 500), rng.integers(0, 2**40, 500)
    held = [tuple(x[part] for x in (key, name, own, prints, place)) for part in (slice(0, 200), slice(200, 500))]
    batch = bwt.dealt(held, 8)
    assert not held and batch.num_rows <= 256 and sum(batch.column(1).to_pylist()) == 500
    got = []
    for segment, n, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
        rows = list(zip(*(x.tolist() for x in bwt.unpacked(raw, n)), strict=True))
        assert {(k % 2**64) >> 56 for k, *_ in rows} == {segment}
        got += rows
    assert sorted(got) == sorted(zip(*(x.tolist() for x in (key, name, own, prints, place)), strict=True))
    table = np.stack([key, name, own])[:, np.lexsort((key, name))]
    assert table[2][bwt.matches(table, key, name)].tolist() == own.tolist()


def test_no_string_is_joined_as_a_row(spark, data):
    import io
    from contextlib import redirect_stdout

    text_ = io.StringIO()
    with redirect_stdout(text_):
        bwt.op11_suffix_array_dedup(spark, data).explain()
    plan = text_.getvalue()
    assert "Aggregate" not in plan and plan.count("Join") == 1  # of texts with their places alone
