"""Words that collide under every polynomial modulo 2**64: operators must tell them apart."""

import hashlib

import numpy as np
import public_tokenizers
import pytest

from ledgerline.llm import common, jaccard, packing, pieces, substrings, toxicity

WORD_FILE, PIECE_FILE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def twins(n):
    return thue_morse(n), thue_morse(n, "b", "a")


@pytest.fixture(scope="module")
def texts():
    out = []
    for n in (64, 1024, 2048):
        for x in twins(n):
            filler = " ".join(f"w{i}" for i in range(30))
            out += [x, f"{filler} {x} {filler}"]
    long, other = twins(1024)
    out += [" ".join(["so", *[long] * 20, "it", "ends"]), " ".join(["but", *[other] * 20, "that", "stays"])]
    out += [" ".join(long), " ".join(other), "", None]
    return out


@pytest.fixture(scope="module")
def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").cache()


def test_hashes_of_twins_differ():
    for n in (2, 8, 16, 63, 64, 65, 128, 1024, 2048, 4096):
        a, b = twins(n)
        data = np.frombuffer(f"{a} {b}".encode(), np.uint8)
        first, end = np.array([0, n + 1]), np.array([n, 2 * n + 1])
        h = common.span_hashes(data, first, end)
        assert h[0] != h[1] and not common.same_spans(data, first[:1], end[:1], first[1:], end[1:])[0]
        assert common.same_spans(data, first, end, first, end).all()
        words = common.words_in(np.frombuffer(" ".join(f"{a}{b}").encode(), np.uint8), np.array([0, 4 * n - 1]))[0]
        whole = common.sequence_hashes(words, np.array([0, n]), np.array([n, n]))
        assert whole[0] != whole[1]
        assert len(set(common.sequence_hashes(words, np.zeros(2 * n, np.int64), np.arange(1, 2 * n + 1)).tolist())) == 2 * n


def test_equal_spans_hash_alike():
    data = np.frombuffer("Ab ab AB\0 AB x".encode() + b"q" * 70 + b" " + b"Q" * 70, np.uint8)
    h, _, first, end = common.words_in(data, np.array([0, len(data)]), lower=True)
    assert h[0] == h[1] == h[3] != h[2] and len(h) == 6


def test_known_tells_spans_of_one_hash_apart():
    known = common.Known(lambda words: [[ord(c) for c in w] for w in words])
    data = np.frombuffer(b"ab cd ab ef cd", np.uint8)
    first = np.arange(0, 14, 3)
    for _ in range(2):
        ids, upto = known(data, np.zeros(5, np.uint64), first, first + 2)
        assert bytes(ids.astype(np.uint8)) == b"abcdabefcd" and upto.tolist() == [0, 2, 4, 6, 8, 10]


def test_packing(spark, texts, frame):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(WORD_FILE)
    got = packing.pack(frame, WORD_FILE).toPandas().sort_values(["doc_id", "start"])
    for doc_id, part in got.groupby("doc_id"):
        assert [i for x in part["ids"] for i in x] == model.encode(texts[doc_id] or "", add_special_tokens=False).ids + [2]


def test_pieces(texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_FILE)
    own = pieces.coder(PIECE_FILE)
    for text, (ids, _, _) in zip(texts, own.encode([t or "" for t in texts]), strict=True):
        assert ids.tolist() == library.encode(text or "", add_bos=True, add_eos=True)


def test_substrings(spark, texts, frame):
    got = substrings.remove_repeats(frame, length=20).toPandas().set_index("doc_id")
    seen, expect = set(), {}
    for i, t in enumerate(texts):
        w = (t or "").split()
        gone = set()
        for s in range(len(w) - 19):
            window = tuple(w[s : s + 20])
            gone |= set(range(s, s + 20)) if window in seen else set()
            seen.add(window)
        expect[i] = [x for k, x in enumerate(w) if k not in gone]
    for i, kept in expect.items():
        assert got.loc[i, "kept_sha256"] == hashlib.sha256(" ".join(kept).encode()).hexdigest(), i


def test_similar(spark, texts, frame):
    got = jaccard.similar(frame, words=4, percent=85).toPandas().set_index("doc_id")
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set())
    low = list(range(len(sets)))
    for _ in sets:
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if x and y and 100 * len(x & y) >= 85 * len(x | y):
                    low[i] = low[j] = min(low[i], low[j])
    assert got["component_id"].sort_index().tolist() == low
    assert got["n_shingles"].sort_index().tolist() == [len(x) for x in sets]


def test_toxicity():
    """Texts scored together score as each alone does."""
    some = [*twins(1024), *twins(2048), " ".join(twins(1024)), "ab ba"]
    machine = toxicity.fit([f"{a} {a}" for a in ("abba", "abab", "baba", "bbaa")] * 10, np.array([1, 0, 0, 1] * 10))
    alone = [machine.scores(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x)]))[0] for x in some]
    together = machine.scores(np.frombuffer("".join(some).encode(), np.uint8), np.cumsum([0, *map(len, some)]))
    assert np.allclose(alone, together, rtol=0, atol=1e-12)
