"""The corpus operators against brute force, the libraries they follow, and awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import common, graph, jaccard, licenses, neighbours, packing, pieces, registry, sharding, substrings, topk, toxicity, warc

WORD_FILE, PIECE_FILE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXT = "doc_id long, text string, lang string, source string, n_chars long, start int, size string, score string, n_words int, component_id string"


def table(spark, texts, first=0):
    """Documents with further columns whose names clash with results."""
    return spark.createDataFrame([(first + i, t, None, None, None, 7, "x", "y", 3, "z") for i, t in enumerate(texts)], TEXT)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "the", "of", "été", "日本"]
    base = [" ".join(rng.choice(words) for _ in range(rng.choice([3, 25, 60, 150]))) for _ in range(40)]
    texts = [None, "", " \t\n ", "one", "the the"] + base + base[:6] * 3
    for t in base[:15]:
        w = t.split()
        for k in range(0, len(w), 29):
            w[k] = rng.choice(words)
        texts.append(" ".join(w))
    passage = " ".join(rng.choice(words) for _ in range(30))
    texts += [f"{b} {passage} {b[:20]}" for b in base[20:30]] + ["The  " + base[0].upper(), "word " * 200]
    return texts


@pytest.fixture(scope="module")
def frame(spark, docs):
    return table(spark, docs).cache()


def words_of(t):
    return WORD.findall(t or "")


# ---------------------------------------------------------------- packing


def test_packing_holds_every_token_once(spark, docs, frame):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(WORD_FILE)
    got = packing.pack(frame, WORD_FILE, capacity=256).toPandas()
    for doc_id, part in got.groupby("doc_id"):
        ids = model.encode(docs[doc_id] or "", add_special_tokens=False).ids + [2]
        part = part.sort_values("start")
        assert part["start"].tolist() == [0, *np.cumsum(part["length"])[:-1]] and part["length"].sum() == len(ids)
        assert [i for x in part["ids"] for i in x] == ids and (part["doc_tokens"] == len(ids)).all()
        assert part["ids_crc32"].tolist() == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in part["ids"]]
    assert set(got["doc_id"]) == set(range(len(docs)))
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert part["offset"].tolist() == [0, *np.cumsum(part["length"])[:-1]] and part["length"].sum() <= 256


def test_packing_pads_little():
    for capacity in (256, 4096):
        for n in range(1, 3 * capacity, 37):
            got = list(packing.cut(n, capacity))
            assert sum(length for length, _ in got) == n and all(length * k <= capacity for length, k in got)
    waste = [sum(4096 / k - length for length, k in packing.cut(n, 4096)) for n in range(500, 4096, 7)]
    assert np.mean(waste) < 20


def test_fuzzed_texts_encode_as_the_libraries_do():
    import pyarrow as pa
    import sentencepiece
    from tokenizers import Tokenizer

    rng = random.Random(1)
    bits = ["the", "The", " ", "  ", "\n", "é", "日本", "▁", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'start", "%'t", "É", "ÀB", "ß", "ﬁ", "İ", "Σ", "&&", "a.b", ",", "...", " ", "́", "x" * 40, "<s>", "12", "I'LL", "\x00"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    model, own = Tokenizer.from_file(WORD_FILE), packing.WordEncoder(WORD_FILE)
    data, offsets = common.buffers(pa.array(texts))
    ids, ends = own(data, offsets)
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [model.encode(t, add_special_tokens=False).ids for t in texts]
    library, own = sentencepiece.SentencePieceProcessor(model_file=PIECE_FILE), pieces.Pieces(PIECE_FILE)
    for t, (ids, begins, ends) in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == library.encode(t, add_bos=True, add_eos=True)
        assert ends[-1] == len(t.encode()) and (begins <= ends).all() and (begins[1:-1] == ends[:-2]).all()


# ---------------------------------------------------------------- pieces


def test_pieces_round_trip(docs, frame):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_FILE)
    got = pieces.encode(frame, PIECE_FILE).toPandas().set_index("doc_id")
    for i, t in enumerate(docs):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        row = got.loc[i]
        assert list(row["ids"]) == ids and row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def compiled_map(rules):
    """A character map blob: a double-array trie, laid out by hand, over replacement strings."""
    strings, values = b"", {}
    for key, put in rules.items():
        values[key] = len(strings)
        strings += put + b"\0"
    units, free = {0: 0}, [256]

    def lay(node, prefix):
        labels = sorted({k[len(prefix)] if len(k) > len(prefix) else 0 for k in values if k.startswith(prefix)})
        if not labels:
            return
        base = free[0]
        free[0] += 256
        units[node] |= (base ^ node) << 10
        for c in labels:
            at = base ^ c
            if c == 0:
                units[at] = 1 << 31 | values[prefix]
                units[node] |= 1 << 8
            else:
                units[at] = c
                lay(at, prefix + bytes([c]))

    lay(0, b"")
    out = np.zeros(free[0] + 256, "<u4")
    for at, u in units.items():
        out[at] = u
    raw = out.tobytes()
    return len(raw).to_bytes(4, "little") + raw + strings


def test_longest_prefix_normalisation_keeps_the_source():
    blob = compiled_map({b"A": b"a", "ﬁ".encode(): b"fi", b"AB": b"x", b"\t": b" "})
    spec = pieces._varint(2 << 3 | 2) + pieces._varint(len(blob)) + blob + pieces._varint(3 << 3) + b"\1" + pieces._varint(4 << 3) + b"\1" + pieces._varint(5 << 3) + b"\1"
    norm, source = pieces.Normaliser(spec)("  AAB\t  ﬁ ")
    assert norm.decode() == "▁ax▁fi"
    assert source.tolist() == [2, 2, 2, 2, 3, 5, 5, 5, 8, 8, 11]


# ---------------------------------------------------------------- substrings


def removed(texts, length):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        w = words_of(t)
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - length + 1):
            key = tuple(w[s : s + length])
            if key in seen:
                gone[s : s + length] = True
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


@pytest.mark.parametrize("length", [3, 20, 50])
def test_repeats_are_removed_as_by_brute_force(docs, frame, length):
    want = removed(docs, length)
    got = substrings.remove_repeats(frame, length).collect()
    assert len(got) == len(docs) and sum(r.n_removed for r in got) > 0
    assert all((r.n_words, r.n_removed, r.kept_sha256, r.kept_text) == want[r.doc_id] for r in got)


def test_index_gives_matching_statistics():
    rng = np.random.default_rng(3)
    runs = [rng.integers(0, 4, rng.integers(5, 12)).astype(np.uint64) for _ in range(60)]
    index = substrings.FMIndex(runs)
    symbols = np.concatenate(runs)
    inside = {tuple(r[i : i + k].tolist()) for k in range(1, 6) for r in runs for i in range(len(r) - k + 1)}
    times = Counter(tuple(r[i : i + k].tolist()) for k in range(1, 6) for r in runs for i in range(len(r) - k + 1))
    start = np.arange(len(symbols) - 4)
    matched, lo, hi = index.matching(index.codes(symbols), start, 5)
    for p, n, width in zip(start.tolist(), matched.tolist(), (hi - lo).tolist(), strict=True):
        part = tuple(symbols[p + 5 - n : p + 5].tolist())
        if n < 5:  # one symbol more is found once at most
            more = tuple(symbols[p + 4 - n : p + 5].tolist())
            assert (n == 0 or times[part] > 1) and times[more] <= 1
        else:
            assert part in inside and times[part] == width > 1
    seven = index.matching(index.codes(np.full(5, 7, np.uint64)), np.zeros(1, int), 5)
    assert seven[0].tolist() == [0]


def test_hot_anchors_are_cut_into_windows(spark, docs, frame, monkeypatch):
    monkeypatch.setattr(substrings, "HOT_RUNS", 3)
    for length in (5, 20):
        want = removed(docs, length)
        got = substrings.remove_repeats(frame, length).collect()
        assert all((r.n_words, r.n_removed, r.kept_sha256, r.kept_text) == want[r.doc_id] for r in got)


def test_text_ids_are_taken_in_their_order(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [("b", " ".join(words)), ("a", " ".join(words[:30])), (None, " ".join(words)), ("c", None)]
    got = {r.doc_id: r.n_removed for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"a": 0, "b": 30, None: 0, "c": 0}


# ---------------------------------------------------------------- Jaccard join


def sets_of(texts, words):
    low = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "") for t in texts]
    split = [words_of(t) for t in low]
    return [{tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set() for w in split]


def components_of(sets, percent):
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = label[i], label[j]
                label = [min(x, y) if v in (x, y) else v for v in label]
    return label


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80), (2, 60), (1, 51)])
def test_similar_documents_link_as_by_brute_force(docs, frame, words, percent):
    sets = sets_of(docs, words)
    want = components_of(sets, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar(frame, words, percent).collect()}
    assert got == {i: (len(s), want[i]) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("words", "percent"), [(5, 80), (4, 85)])
def test_texts_that_were_appended_to_or_cut_off_link(spark, words, percent):
    texts = []
    for k in range(90):
        w = [f"w{k}x{i}" for i in range(99 + words)]
        n = percent + k % 3 + words - 2  # just below, at and just above
        texts += [" ".join(w), " ".join(w[:n] if k % 2 else w[-n:])]
    sets = sets_of(texts, words)
    got = {r.doc_id: r.component_id for r in jaccard.similar(table(spark, texts), words, percent).collect()}
    assert got == dict(enumerate(components_of(sets, percent))) and len(set(got.values())) == 120


def test_frequent_tokens_link_by_pairs():
    rng = np.random.default_rng(4)
    frequent = np.sort(rng.integers(-(2**62), 2**62, 400))
    for trial in range(200):
        a = np.sort(rng.choice(frequent, 60, replace=False))
        b = np.sort(np.union1d(rng.choice(a, 57, replace=False), rng.choice(frequent, rng.integers(0, 4), replace=False)))
        same = len(np.intersect1d(a, b))
        if 100 * same >= 80 * (len(a) + len(b) - same):
            keys = [set(jaccard.index_keys(x, frequent, 80)[0].tolist()) for x in (a, b)]
            assert keys[0] & keys[1], trial


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in graph.components(links).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


# ---------------------------------------------------------------- WARC


def test_archives_round_trip_and_name_revisits(spark):
    big = "x" * 120 + "P*M\x18\0\0\0\0" + "é"
    rows = [(5, "u", big, 1), (3, "u", big, 1), (9, None, big, 1), (1, "u", "s", 1), (2, "u", "s", 1), (4, "u", None, 1), (6, "", "", 1), (7, "a\r\nb", big + "1" * 3_000_000, 2), (None, "u", big, 1), (None, None, None, 1)]
    path = common.scratch(spark, "warc")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string, record_type int"), path)
    read = warc.read(spark, path).collect()
    assert sorted((r.payload_bytes, r.record_type, r.refers_to) for r in read if r.page_id is None) == [(0, "response", None), (len(big.encode()), "response", None)]
    got = {r.page_id: r for r in read}
    for page_id, _, html, _ in rows[:-2]:
        raw, r = (html or "").encode(), got[page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 3) if page_id in (5, 9) else ("response", None))
        assert r.payload is None if page_id in (5, 9) else bytes(r.payload) == raw
    assert len(read) == len(rows) and len(got) == len(rows) - 1


def test_a_plain_reader_reads_an_archive(spark):
    import zstandard

    path = common.scratch(spark, "warc")
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<html>{'hello world ' * 40}{i}</html>") for i in range(200)], "page_id long, url string, html string").coalesce(1)
    warc.write(pages, path)
    content = bytes(spark.read.format("binaryFile").load(path).filter("length > 0").first()["content"])
    (magic, raw), *rest = list(warc.frames(content))
    assert magic == warc.DICTIONARY_FRAME and raw[:4] == (0xEC30A437).to_bytes(4, "little")
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    records = [reader.decompress(frame) for magic, frame in rest if not magic]
    assert len(records) == 200 and all(r.startswith(b"WARC/1.1\r\n") for r in records)


# ---------------------------------------------------------------- licences


def test_licence_lines(spark):
    rows = [None, "", "MIT", "a long opening line with words of its own\nreleased under the  MIT license!\nand another line that ends the text", "Licensed under CC BY-NC 4.0.", "The MIT road was licensed in spring and the bridge was released under heavy rain."]
    got = {r.doc_id: (r.n_matches, r.licenses, r.best_dice) for r in licenses.scan(table(spark, rows)).collect()}
    assert got[3][:2] == (1, "MIT") and got[4][0] >= 1 and "CC-BY-NC-4.0" in got[4][1] and got[4][2] == 1.0
    assert all(got[i] == (0, "", None) for i in (0, 1, 2, 5))


def licences_in(text, least=0.8):
    """(template, name, best Dice) of each template with a window that matches, window by window, but for those whose
    best window overlaps a better one of another licence."""
    w, out = licenses.words_of(text or ""), []
    for k, t in enumerate(licenses.templates(licenses.NOTICES, least)):
        theirs, best, at, most = set(t.pairs), 0, 0, 0
        for s in range(len(w) - 1):
            if f"{w[s]} {w[s + 1]}" in theirs:
                window = w[s : s + t.length]
                own = {f"{a} {b}" for a, b in zip(window, window[1:], strict=False)}
                if (dice := 2 * len(own & theirs) / (len(own) + len(theirs))) > best:
                    best, at, most = dice, s, len(own & theirs)
        if best >= least - 1e-9:
            out.append((k, t.name, best, at, at + t.length - 1, most))
    worse = lambda x, y: x[1] != y[1] and (y[5] > x[5] or y[5] == x[5] and y[2] > x[2] + 1e-12) and y[3] < x[4] and x[3] < y[4]
    return [x[:3] for x in out if not any(worse(x, y) for y in out)]


def wrapped(text, width=60, lead="# "):
    import textwrap

    return "\n".join(lead + line for line in textwrap.wrap(text, width))


def test_licences_by_brute_force(spark):
    rng = random.Random(4)
    notices = [n for ns in licenses.NOTICES.values() for n in ns]
    filler = ["river", "market", "software", "the", "license", "copy", "of", "to", "apache", "mit", "version", "2.0"]
    texts = [None, "", "MIT", "\n\n"]
    for k in range(120):
        words = rng.choice(notices).split()
        for _ in range(rng.randrange(len(words) // 4 + 1)):
            i = rng.randrange(len(words))
            words[i : i + 1] = rng.choice([[], [rng.choice(filler)], [words[i].upper(), rng.choice(filler)]])
        around = lambda: " ".join(rng.choice(filler) for _ in range(rng.choice([0, 5, 40])))
        texts.append(f"{around()} {wrapped(' '.join(words) or 'x', 40 + k % 50, rng.choice(['', '# ', ' * ']))}\n{around()}")
    got = {r.doc_id: (r.n_matches, r.licenses, r.best_dice) for r in licenses.scan(table(spark, texts)).collect()}
    hits = 0
    for i, text in enumerate(texts):
        want = licences_in(text)
        hits += bool(want)
        assert got[i] == (len(want), ",".join(sorted({n for _, n, _ in want})), round(max((d for *_, d in want)), 6) if want else None), text
    assert 40 < hits < len(texts)


def test_whole_and_wrapped_licences_and_rows_by_themselves(spark):
    full = {name: max(licenses.NOTICES[name], key=len) for name in ("MIT", "BSD-3-Clause", "ISC", "Unlicense", "Zlib")}
    rows = [(i, f"Copyright (c) 2020 A. Person\n\n{wrapped(text, 78, '')}\n\nimport os\n" + "x = 1\n" * 300) for i, text in enumerate(full.values())]
    header = "int main;\n" + wrapped(licenses.NOTICES["MIT"][1], 70, " * ") + "\nand more text that follows the header\n"
    rows += [(70, header), (70, "plain"), (None, header), (None, None), (71, "so it is released under the MIT license, as said")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_matches, r.licenses) for r in licenses.scan(df).collect()]
    assert [g[2] for g in got[:5]] == ["MIT", "BSD-3-Clause", "ISC", "Unlicense", "Zlib"]
    assert got[5:] == [(70, 1, "MIT"), (70, 0, ""), (None, 1, "MIT"), (None, 0, ""), (71, 1, "MIT")]


def test_versions_report_themselves_alone(spark):
    texts, names = [], []
    for name, notices in licenses.NOTICES.items():
        for notice in notices:
            texts.append(f"some words before it\n{wrapped(notice, 70)}\nand some behind it")
            names.append(name)
    got = {r.doc_id: r.licenses for r in licenses.scan(table(spark, texts)).collect()}
    same = {"0BSD", "ISC"}  # a grant in common
    assert [(got[i], n) for i, n in enumerate(names) if got[i] != n and not {got[i], n} <= same] == []
    both = " ".join([licenses.NOTICES["GPL-2.0"][-1], "filler words between " * 20, licenses.NOTICES["LGPL-3.0"][-1]])
    assert licenses.scan(table(spark, [both])).first().licenses == "GPL-2.0,LGPL-3.0"


def test_bundles_of_notices_take_time_in_proportion(spark):
    import time

    mit = max(licenses.NOTICES["MIT"], key=len)
    took = {}
    for copies in (5, 400):
        df = table(spark, [f"Copyright {copies}\n\n{mit}\n\n" * copies])
        begin = time.time()
        assert licenses.scan(df).first().licenses == "MIT"
        took[copies] = time.time() - begin
    assert took[400] < 30 + took[5], took


# ---------------------------------------------------------------- toxicity


def test_features_are_all_gapped_subsequences():
    rng = random.Random(6)
    for _ in range(40):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(3, 12))) for _ in range(2))

        def direct(u):
            out = Counter()
            for i in range(len(u)):
                for j in range(i + 1, len(u)):
                    for k in range(j + 1, len(u)):
                        if k - i < toxicity.SPAN:
                            out[u[i] + u[j] + u[k]] += toxicity.DECAY ** (k - i + 1)
            return out

        x, y = direct(a), direct(b)
        rows, seen = toxicity.dense([a, b])
        want = sum(x[s] * y[s] for s in x)
        # lengths are of subsequences one by one, which needs no table of those that repeat
        scale = [np.sqrt(sum((toxicity.DECAY ** (k - i + 1)) ** 2 for i in range(len(u)) for j in range(i + 1, len(u)) for k in range(j + 1, len(u)) if k - i < toxicity.SPAN)) for u in (a, b)]
        assert len(seen) == len(set(x) | set(y))
        assert float(rows[0] @ rows[1]) == pytest.approx(want / scale[0] / scale[1], rel=1e-4)


def test_the_machine_is_its_kernel_expansion():
    rng = np.random.default_rng(2)
    x = np.hstack([rng.normal(size=(80, 5)), np.ones((80, 1))])
    y = np.where(x[:, 0] + 0.3 * x[:, 1] > 0.2, 1.0, -1.0)
    w = toxicity.hinge(x, y, np.full(80, 10.0), rounds=2000)
    loss = lambda v: 0.5 * v @ v + 10 * np.maximum(0, 1 - y * (x @ v)).sum()
    assert all(loss(w) <= loss(w + d) + 1e-6 * loss(w) + 0.05 for d in rng.normal(size=(300, 6)) * 0.05)


def test_insults_are_found_with_gaps(spark):
    rng = random.Random(2)
    filler = ["river", "market", "paper", "window", "garden", "silver", "doctor", "letter", "mountain", "summer", "winter", "station"]
    insults = ["scumbag", "numskull", "blockhead"]
    texts, toxic = [], []
    for i in range(400):
        w = [rng.choice(filler) + rng.choice(["", "s", "ly", "er"]) for _ in range(40)]
        if i % 5 == 0:
            w[rng.randrange(40)] = rng.choice(insults)
        texts.append(" ".join(w) + ".")
        toxic.append(i % 5 == 0)
    labels = spark.createDataFrame([(i, int(y)) for i, y in enumerate(toxic)] + [(5000, None), (5001, 1)], "doc_id long, toxic int")
    frame = table(spark, texts)
    machine = toxicity.train(frame, labels)
    got = toxicity.score(frame, machine).join(frame.select("doc_id", toxicity.held_out().alias("h")), "doc_id").collect()
    held = [r for r in got if r.h]
    assert held and all(r.predicted == int(toxic[r.doc_id]) for r in held)
    odd = ["you n.u.m.s.k.u.l.l there", "a b l o c k h e a d by the river", "such a scumxbag", "river market paper", "", None]
    marks = [r.predicted for r in toxicity.score(table(spark, odd), machine).orderBy("doc_id").collect()]
    assert marks[:2] == [1, 1] and marks[3:] == [0, 0, 0]
    none = toxicity.train(frame, labels.filter("toxic = 0"))
    assert toxicity.score(frame, none).select("score").distinct().count() == 1


# ---------------------------------------------------------------- vectors


def vectors(seed, n, dim=64, near=40):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in range(near):
        x[n - 1 - i] = x[i % 10] + rng.normal(size=dim) * 0.05
    return x


def test_near_duplicates_and_recall(spark):
    x = vectors(1, 900)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = u @ u.T >= 0.95
    np.fill_diagonal(linked, False)
    df = spark.createDataFrame([(i, [float(v) for v in row], 1) for i, row in enumerate(x)], "vec_id long, embedding array<double>, kept int")
    got = {r.vec_id: r for r in neighbours.near_duplicates(df).collect()}
    found = sum(r.n_links for r in got.values())
    assert linked.sum() > 100 and linked.sum() >= found >= 0.9 * linked.sum()
    assert all(r.n_links <= linked[i].sum() and r.kept == (r.component_id == i) for i, r in got.items())


def test_vectors_that_take_no_part(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.99, 0.01]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [0.0, 1.0]), (8, [None, 1.0]), (9, [2.0]), (10, []), (11, [1e308, 1e308])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 9: (3, 1), **{i: (0, i) for i in (4, 5, 6, 7, 8, 10, 11)}}


def test_top_k_is_exact_with_ties(spark):
    x = np.round(vectors(2, 300, 16), 1)
    x[50:80] = x[20]
    df = spark.createDataFrame([(i, [float(v) for v in row], 1) for i, row in enumerate(x)] + [(900, None, 1), (950, [None] * 16, 1)], "vec_id long, embedding array<double>, rank int")
    w = np.floor(256 * x).astype(int)
    got = topk.top_k(df, F.col("vec_id") % 50 == 0).toPandas()
    for q, part in got.groupby("query_id"):
        score = w @ w[q]
        best = [j for j in np.lexsort((np.arange(len(x)), -score)) if j != q][:5]
        part = part.sort_values("rank")
        assert part["vec_id"].tolist() == best and part["score"].tolist() == score[best].tolist() and part["rank"].tolist() == [1, 2, 3, 4, 5]
    assert set(got["query_id"]) == {0, 50, 100, 150, 200, 250}


def test_queries_are_chosen_by_any_column(spark):
    rows = [(i, [float(i), 1.0], "q" if i == 3 else "other" if i else None, i % 2) for i in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, kind string, class int")
    for condition, ids in ((F.col("kind") == "q", {3}), (F.col("class") == 1, {1, 3, 5}), (F.col("vec_id") > 4, {5})):
        got = topk.top_k(df, condition, k=2).collect()
        assert {r.query_id for r in got} == ids and len(got) == 2 * len(ids) and all(r.vec_id != r.query_id for r in got)


def test_top_k_of_large_components(spark):
    rng = np.random.default_rng(8)
    sizes = [1.0, 2.0**15, 2.0**21, 3e6, 1e17, 1e300, 1e307]
    x = [[float(v) for v in rng.normal(size=4) * sizes[i % 7 if i % 3 else 0]] for i in range(120)] + [[1.0], [3e6], [2e6], [-3e6], [0.0], []]
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    w = [[*topk.integers(np.array(v, float)), 0, 0, 0, 0][:4] for v in x]
    assert w[121] == [768_000_000, 0, 0, 0]
    got = {}
    for r in topk.top_k(df, F.expr("vec_id % 10 = 0 or vec_id > 119")).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    for q, ranks in got.items():
        score = [sum(a * b for a, b in zip(w[q], v, strict=True)) for v in w]
        best = sorted((j for j in range(len(w)) if j != q), key=lambda j: (-score[j], j))[:5]
        assert [ranks[r] for r in range(1, 6)] == [(j, score[j] if abs(score[j]) < 2**63 else None) for j in best]
    assert len(got) == 18


def test_a_block_stops_only_on_proof():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 24))
    x[200:220] = x[7] + rng.normal(size=(20, 24)) * 0.02
    small = np.arange(3000, dtype=np.int32)
    block = topk.Block(small, x, small, *topk.postings_of(topk.whole(x)))
    w = np.floor(256 * x).astype(int)
    for q, found in zip((7, 205, 9, 2000), block.best([7, 205, 9, 2000], x[[7, 205, 9, 2000]], 5, np.full(4, -np.inf)), strict=True):
        score = w @ w[q]
        assert found == [(j, score[j]) for j in np.lexsort((small, -score)) if j != q][:5]
    c, _ = block.possible(topk.whole(x[[7]]), 5, (np.zeros(0, int), np.zeros(0, int)), np.full(1, -np.inf))
    assert len(c) < 3000 * topk.FEW


# ---------------------------------------------------------------- sharding


def test_shards_are_whole_groups_and_even(docs, frame):
    got = sharding.shard_by_bytes(frame).toPandas()
    assert len(got) == len(docs)
    by_text = {}
    for r in got.itertuples():
        t = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(t) + 1, zlib.crc32(t))
        by_text.setdefault(t, set()).add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    groups = Counter()
    for t in docs:
        groups[t or ""] += len((t or "").encode()) + 1
    loads = got.groupby("shard")["size"].sum().reindex(range(8), fill_value=0)
    assert max(groups.values()) < loads.min() and loads.max() - loads.min() <= 0.01 * loads.mean()


@pytest.mark.parametrize(("most", "spread"), [(600, 0.005), (100, 0.5)])
def test_levels_of_lumps_leave_shards_even(spark, monkeypatch, most, spread):
    rng = random.Random(3)
    texts = ["x" * rng.randint(1, 300) + str(i) for i in range(3000)] + ["y" * 40_000, "z" * 30_000, *["c" * 500] * 40]
    monkeypatch.setattr(sharding, "BUCKET", 100)
    got = sharding.shard_by_bytes(table(spark, texts), most=most, fine=64).toPandas()
    loads = got.groupby("shard")["size"].sum()
    assert len(got) == len(texts) and loads.sum() == sum(len(t) + 1 for t in texts) and loads.max() - loads.min() <= spread * loads.mean()
    assert got[got["doc_id"] >= 3002]["shard"].nunique() == 1


def test_differencing_of_few_items_is_near_the_best():
    rng, worse = np.random.default_rng(1), 0
    for _ in range(60):
        sizes = rng.integers(1, 100, 9)
        loads = np.bincount(sharding.difference(sizes, 2), weights=sizes, minlength=2)
        best = min(abs(2 * int(sum(s for b, s in enumerate(sizes) if mask >> b & 1)) - int(sizes.sum())) for mask in range(512))
        worse += abs(loads[0] - loads[1]) - best
        assert abs(loads[0] - loads[1]) >= best
    assert worse / 60 <= 4
    loads = np.bincount(sharding.difference(np.array([4, 5, 6, 7, 8]), 2), weights=[4, 5, 6, 7, 8])
    assert sorted(loads) == [14, 16]  # the known result of differencing here


def test_differencing_beats_greedy_order():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 10_000, 400)
    loads = np.bincount(sharding.difference(sizes, 8), weights=sizes, minlength=8)
    assert loads.sum() == sizes.sum() and loads.max() - loads.min() <= 5


# ---------------------------------------------------------------- all of them


def test_very_long_texts(spark):
    from tokenizers import Tokenizer

    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 8))) for _ in range(900)]
    long = " ".join(rng.choice(vocabulary) for _ in range(60_000))
    notice = max(licenses.NOTICES["MIT"], key=len)
    near = long.split()
    near[500:600], near[30_000] = [], "changed"
    texts = ["short text of words", long, " ".join(near), long[:150_000] + " " + wrapped(notice) + " " + long[200_000:], "z" * 3_000_000]
    df = table(spark, texts)
    model = Tokenizer.from_file(WORD_FILE)
    packed = packing.pack(df.filter("doc_id < 4"), WORD_FILE).toPandas()
    for i in range(4):
        ids = [x for part in packed[packed["doc_id"] == i].sort_values("start")["ids"] for x in part]
        assert ids == [*model.encode(texts[i], add_special_tokens=False).ids, 2]
    want = removed(texts, 20)
    assert all((r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id][:3] for r in substrings.remove_repeats(df, 20).collect())
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_FILE)
    for r in pieces.encode(df.filter("doc_id < 4"), PIECE_FILE).collect():
        assert list(r.ids) == library.encode(texts[r.doc_id], add_bos=True, add_eos=True)
    found = {r.doc_id: r.licenses for r in licenses.scan(df).collect()}
    assert found == {0: "", 1: "", 2: "", 3: "MIT", 4: ""}
    sets = sets_of(texts, 5)
    assert {r.doc_id: r.component_id for r in jaccard.similar(df).collect()} == dict(enumerate(components_of(sets, 80)))
    machine = toxicity.fit(["you numskull there", "a paper window"] * 12, np.array([True, False] * 12))
    parts = table(spark, [long, "numskull", f"{long} numskull"])
    marks = [r.score for r in toxicity.score(parts, machine).orderBy("doc_id").collect()]
    assert marks[2] == max(marks[:2]) and marks[1] > marks[0]
    got = {r.doc_id: (r["size"], r.text_crc32) for r in sharding.shard_by_bytes(df).collect()}
    assert got == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in enumerate(texts)}


def test_empty_tables_and_repeated_rows(spark):
    empty, labels = table(spark, []), spark.createDataFrame([], "doc_id long, toxic int")
    machine = toxicity.train(empty, labels)
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    path = common.scratch(spark, "warc")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    for df in (packing.pack(empty, WORD_FILE), pieces.encode(empty, PIECE_FILE), substrings.remove_repeats(empty), jaccard.similar(empty), sharding.shard_by_bytes(empty), licenses.scan(empty), toxicity.score(empty, machine), neighbours.near_duplicates(none), topk.top_k(none, F.lit(True)), warc.read(spark, path)):
        assert df.count() == 0
    twice = table(spark, ["a b c d e f g"] * 2, 1).withColumn("doc_id", F.lit(1).cast("long"))
    for df in (packing.pack(twice, WORD_FILE), pieces.encode(twice, PIECE_FILE), substrings.remove_repeats(twice, 3), jaccard.similar(twice), sharding.shard_by_bytes(twice), licenses.scan(twice), toxicity.score(twice, machine)):
        assert df.count() == 2
    assert [r.n_removed for r in substrings.remove_repeats(twice, 3).collect()] == [0, 0]


def test_registered_queries(spark, data):
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES) == list(range(1, 14))


def test_oracles(spark, data):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    for name, sql in registry.ORACLES.items():
        ours, theirs = registry.QUERIES[name](spark, data).toPandas(), db.sql(sql).df()
        key = list(ours.columns)
        same = lambda df: Counter(tuple(None if pd.isna(v) else v for v in r) for r in df[key].astype(object).itertuples(index=False))
        assert same(ours) == same(theirs), name


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline as pipeline

    rng = random.Random(9)
    filler = ["river", "market", "paper", "window", "garden", "silver", "doctor", "letter", "mountain", "summer", "winter", "station"]
    say = lambda n: [rng.choice(filler) + rng.choice(["", "s", "ly", "er", "ing", "ed"]) for _ in range(n)]
    texts, toxic = [], []
    for i in range(150):
        w = say(80)
        if i % 5 == 0:
            w[rng.randrange(80)] = "numskull"
        texts.append(" ".join(w))
        toxic.append(i % 5 == 0)
    copy = texts[1].split()
    copy[3] = "changed"
    passage = " ".join(say(60))
    texts += [" ".join(copy), " ".join([*say(200), passage]), " ".join([*say(200), passage]), texts[2]]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(y)) for i, y in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(pipeline.STAGES[:-1]):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}.parquet")
        now = spark.read.parquet(f"{tmp_path}/{k}.parquet")
        assert now.columns == pipeline.COLUMNS
        kept.append({r.doc_id: r.text for r in now.collect()})
    assert set(kept[0]) == {i for i in range(len(texts)) if i >= 150 or not toxic[i]}
    assert set(kept[0]) - set(kept[1]) == {150, 153}
    assert set(kept[2]) == set(kept[1]) and passage in kept[2][151] and passage not in kept[2][152]
    assert all(kept[2][i] == kept[1][i] for i in kept[2] if i != 152)
    packed = pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(packed["doc_id"]) == set(kept[2]) and packed.groupby("sequence_id")["length"].sum().max() <= 4096


def test_pipeline_stages_take_awkward_tables(spark, tmp_path):
    import corpus_pipeline as pipeline

    kind = "doc_id long, text string, lang string, source string, n_chars long, score double, class string"
    same = " ".join(f"w{i}" for i in range(120))
    rows = [(1, None), (2, ""), (3, same), (3, same), (4, same), (None, same), (None, None), (5, "z" * 400_000), (6, "a few words")]
    for name, part in (("empty", []), ("odd", rows)):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame([(i, t, None, None, None, 0.5, "x") for i, t in part], kind).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, None, None), (3, 0, 1), (3, 0, 0)] if part else [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        now = spark.read.parquet(f"{folder}/documents.parquet")
        for k, (_, stage) in enumerate(pipeline.STAGES[:-1]):
            stage(spark, now, folder).write.parquet(f"{folder}/{k}.parquet")
            now = spark.read.parquet(f"{folder}/{k}.parquet")
            assert now.columns == pipeline.COLUMNS
        ids = sorted(r.doc_id for r in now.collect() if r.doc_id is not None)
        assert ids == ([1, 2, 3, 3, 5, 6] if part else [])
        assert now.filter("doc_id is null").count() == (2 if part else 0)
        packed = pipeline.STAGES[-1][1](spark, now, folder)
        assert packed.select("doc_id").distinct().count() == (6 if part else 0)
