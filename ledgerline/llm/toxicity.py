"""Toxicity by a support vector machine on a gapped subsequence kernel of words, with Nyström landmarks.

A unit is a word with marks left out, or a row of single letters joined, so "i.d.i.o.t" and "i d i o t" are "idiot".
Its features are the subsequences of three symbols within SPAN symbols, each with weight DECAY ** (symbols spanned);
the kernel of two units is the product of their features, both at unit length. An insult with a symbol put in or left
out keeps most of its subsequences at a lower weight.

The machine is linear in the kernel values to landmark units. Together these are one weight for each subsequence, so
a text is scored by look-ups however many landmarks there are. A sentence is as toxic as its worst unit, and a text as
its worst sentence."""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffers, give_back, save, slices, span_hashes, text_of, words_in

SPAN = 7
DECAY = 0.7
SYMBOLS = 64
#: Labelled texts of each class that the machine is fitted on at most, those with the smallest hash of their id.
SAMPLE = 2000
LANDMARKS = 160
#: Texts with at least this score count as toxic.
THRESHOLD = 0.7

_CODE = np.zeros(256, np.int64)  # 0: left out
for _b in range(26):
    _CODE[65 + _b] = _CODE[97 + _b] = 1 + _b
for _b in range(10):
    _CODE[48 + _b] = 27 + _b
_CODE[128:] = 37 + np.arange(128) % 27


def units_in(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Units of rows that lie side by side in data: (symbols, row, first symbol, end symbol)."""
    _, row, first, end = words_in(data, offsets)
    code = _CODE[data]
    upto = np.concatenate([[0], np.cumsum(code > 0)])
    symbols = code[code > 0]
    a, b = upto[first], upto[end]
    full = a < b
    row, a, b = row[full], a[full], b[full]
    if len(row):
        single = b - a == 1
        joins = np.concatenate([[False], single[1:] & single[:-1] & (row[1:] == row[:-1])])
        a = a[~joins]
        b = b[np.append(~joins[1:], True)]
        row = row[~joins]
    return symbols, row, a, b


def gaps() -> list[tuple[int, int, float]]:
    return [(i, j, DECAY ** (j + 1)) for i in range(1, SPAN - 1) for j in range(i + 1, SPAN)]


def features(symbols: np.ndarray, first: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(unit, subsequence, weight) for each pair of gaps, over all units."""
    size = end - first
    unit = np.repeat(np.arange(len(first)), size)
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    at, left = np.repeat(first, size) + place, np.repeat(size, size) - place
    for i, j, weight in gaps():
        ok = left > j
        p = at[ok]
        yield unit[ok], (symbols[p] * SYMBOLS + symbols[p + i]) * SYMBOLS + symbols[p + j], weight


def lengths(n: np.ndarray) -> np.ndarray:
    """Norm of a unit of n symbols, by its subsequences one by one."""
    return np.sqrt(sum(np.maximum(n - j, 0) * w * w for _, j, w in gaps()))


def encoded(units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = [_CODE[np.frombuffer(u.encode("latin-1"), np.uint8)] for u in units]
    size = np.array([len(c) for c in codes], np.int64)
    end = np.cumsum(size)
    return (np.concatenate(codes) if codes else np.zeros(0, np.int64)), end - size, end


def dense(units: list[str], seen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features of units at unit length, as rows over given subsequences, or over those that they have; and these."""
    symbols, first, end = encoded(units)
    if seen is None:
        seen = np.unique(np.concatenate([code for _, code, _ in features(symbols, first, end)]))
    out = np.zeros((len(units), len(seen)), np.float32)
    for unit, code, weight in features(symbols, first, end):
        at = np.minimum(np.searchsorted(seen, code), max(len(seen) - 1, 0))
        known = seen[at] == code if len(seen) else np.zeros(len(code), bool)
        np.add.at(out, (unit[known], at[known]), weight)
    return out / np.maximum(lengths(end - first), 1e-9)[:, None].astype(np.float32), seen


@dataclass
class Machine:
    """Weight of each subsequence, bias, and the curve from a margin to a score."""

    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, symbols: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.zeros(len(first))
        for unit, code, weight in features(symbols, first, end):
            out += weight * np.bincount(unit, weights=self.weight[code], minlength=len(first))
        return out / np.maximum(lengths(end - first), 1e-9) + self.bias

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Score of each row; one without units is scored as one with a unit of no known subsequence."""
        symbols, row, first, end = units_in(data, offsets)
        worst = np.full(len(offsets) - 1, self.bias)
        if len(row):
            h = span_hashes(symbols.astype(np.uint8), first, end)
            _, at, back = np.unique(h, return_index=True, return_inverse=True)
            np.maximum.at(worst, row, self.margins(symbols, first[at], end[at])[back])
        return 1 / (1 + np.exp(-np.clip(self.slope * worst + self.shift, -50, 50)))


def hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 60, seed: int = 1) -> np.ndarray:
    """Linear support vector machine by dual coordinate descent; the last column of x is the bias."""
    rng, a, w = np.random.default_rng(seed), np.zeros(len(x)), np.zeros(x.shape[1])
    square = (x * x).sum(1) + 1e-12
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(x)):
            new = min(max(a[i] - (y[i] * (x[i] @ w) - 1) / square[i], 0.0), cost[i])
            if new != a[i]:
                w += (new - a[i]) * y[i] * x[i]
                moved = max(moved, abs(new - a[i]))
                a[i] = new
        if moved < 1e-3:
            break
    return w


def spelled(symbols: np.ndarray, first: np.ndarray, end: np.ndarray) -> list[str]:
    """Units as strings of one character per symbol."""
    table = np.zeros(SYMBOLS, np.uint8)
    for b in (*range(97, 123), *range(48, 58), *range(128, 155)):
        table[_CODE[b]] = b
    text = table[symbols].tobytes().decode("latin-1")
    return [text[a:b] for a, b in zip(first.tolist(), end.tolist(), strict=True)]


def sentences(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?])\s+|\n+", text) if s.strip()]


def fit(texts: list[str], toxic: np.ndarray) -> Machine:
    """Fit on labelled texts by their sentences.

    Which sentence of a toxic text is the toxic one isn't labelled. At first it is the one with the unit that is found
    most surely in toxic texts; then, three times, a machine is fitted to these units against the worst units of the
    sentences of clean texts, and the toxic sentence is chosen anew.

    So the kernel compares the units of sentences, not sentences as one string: long texts between would drown a word
    of seven letters in gaps. Besides the sample of texts these bounds hold, at any size of the table: LANDMARKS units
    as landmarks; as examples up to 1,500 units of toxic texts, those met most often (at first those met twice, if
    there are twenty), and up to 2,500 against, the highest of three from each clean text and 4,000 drawn from all;
    units of up to two symbols have no subsequence of three and are left out."""
    if not toxic.any() or toxic.all():
        return Machine(np.zeros(SYMBOLS**3), -1.0, 1.0, 0.0)
    index: dict[str, int] = {}
    own: list[np.ndarray] = []  # the different units of each text's sentences
    for text in texts:
        data, offsets = buffers(pa.array(sentences(text), pa.string()))
        symbols, _, first, end = units_in(data, offsets)
        units = {u for u in spelled(symbols, first, end) if len(u) > 2}
        own.append(np.array(sorted(index.setdefault(u, len(index)) for u in units), np.int64))
    known = list(index)
    p, n = toxic.sum(), (~toxic).sum()
    if not known:
        return Machine(np.zeros(SYMBOLS**3), -1.0, 1.0, 0.0)
    in_texts = lambda which: np.bincount(np.concatenate([o for o, y in zip(own, toxic, strict=True) if y == which]), minlength=len(known))
    sure = np.log((in_texts(True) + 0.1) / (p + 1)) - np.log((in_texts(False) + 1.0) / (n + 1))
    symbols, first, end = encoded(known)
    rng, weight, bias = np.random.default_rng(3), np.zeros(SYMBOLS**3), 0.0
    score = sure
    clean_best = lambda s, k: [o[np.argsort(-s[o], kind="stable")[:k]] for t, o in enumerate(own) if not toxic[t] and len(o)]
    for turn in range(3):
        witness = [o[np.argmax(score[o])] for t, o in enumerate(own) if toxic[t] and len(o)]
        found = Counter(int(w) for w in witness if turn == 0 or score[w] > -0.5)
        if turn == 0:
            found = Counter({w: c for w, c in found.items() if c > 1 or len(found) < 20}) or found
        against = np.concatenate(clean_best(score, 3) + [rng.choice(len(known), min(len(known), 4000))]) if known else np.zeros(0, np.int64)
        against = np.array(sorted(set(against.tolist()) - set(found)), np.int64)
        positive = np.array([w for w, _ in found.most_common()], np.int64)
        if not len(positive) or not len(against):
            break
        against = against[np.argsort(-score[against], kind="stable")][:2500]
        chosen = np.concatenate([positive[: LANDMARKS * 2 // 3], against[: LANDMARKS // 4], against[:: max(1, len(against) // (LANDMARKS // 12))][: LANDMARKS // 12]])
        chosen = np.array(list(dict.fromkeys(chosen.tolist())), np.int64)
        positive = positive[:1500]
        marks, seen = dense([known[i] for i in chosen])
        rows, _ = dense([known[i] for i in np.concatenate([positive, against])], seen)
        values, vectors = np.linalg.eigh(marks @ marks.T + 1e-3 * np.eye(len(chosen)))
        root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
        x = np.hstack([rows @ marks.T @ root, np.ones((len(positive) + len(against), 1))])
        y = np.repeat([1.0, -1.0], [len(positive), len(against)])
        times = np.array([found[int(w)] for w in positive], float)
        cost = np.concatenate([10 * np.minimum(times, 5), np.full(len(against), 10.0)])
        w = hinge(x, y, cost)
        alpha = root @ w[:-1]
        weight = np.zeros(SYMBOLS**3)
        weight[seen] = alpha @ marks
        bias = float(w[-1])
        score = Machine(weight, bias, 1, 0).margins(symbols, first, end)
    margin = np.array([max([bias, *score[o]]) if len(o) else bias for o in own])
    slope, shift = curve(margin, toxic)
    return Machine(weight, bias, slope, shift)


def curve(margin: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Logistic curve from margins to scores, by Newton steps on smoothed labels."""
    p, n = toxic.sum(), (~toxic).sum()
    target = np.where(toxic, (p + 1) / (p + 2), 1 / (n + 2))
    weight = np.where(toxic, 0.5 / p, 0.5 / n) * len(toxic)
    x, w = np.stack([margin, np.ones(len(margin))], 1), np.array([2.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (weight * (q - target)) + 1e-3 * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 1e-3), float(w[1])


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """Fit, in one task, on at most SAMPLE labelled texts of each class that aren't held out. Null labels and texts are
    left out; with none of a class left every text gets the same score. Of labels that conflict for an id toxic holds,
    and of texts that repeat an id the smallest is learned from."""
    known = labels.filter(F.col(label_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("_id"), (F.col(label_col) == 1).alias("_toxic")).groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    present = known.join(docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id")), "_id", "left_semi")
    first = lambda rows: rows.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)
    taken = save(first(present.filter("_toxic")).union(first(present.filter("not _toxic"))), "labelled")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(taken), "_id").filter("_text is not null").groupBy("_id", "_toxic").agg(F.min("_text").alias("_text"))

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = pd.concat(list(batches), ignore_index=True).sort_values("_id", ignore_index=True)
        made = pickle.dumps(fit(x["_text"].tolist(), x["_toxic"].to_numpy(bool)))
        del x
        give_back()
        yield pd.DataFrame({"machine": [made]})

    if rows.isEmpty():
        return fit([], np.zeros(0, bool))
    return pickle.loads(rows.repartition(1).mapInPandas(fitted, "machine binary").first()["machine"])


def score(df: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of each row by its whole text; predicted is 1 from THRESHOLD on.

    Null texts count as empty; a text without a word has the score of one without any known subsequence. Repeated
    rows are scored alike. An empty table gives an empty result; extra columns, labels among them, are never read."""
    shared = df.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for i, j in slices(offsets):
                at = offsets[i : j + 1]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(shared.value.scores(data[at[0] : at[-1]], at - at[0]))], names=[id_col, "score"])
        give_back()

    id_type = df.schema[id_col].dataType.simpleString()
    scored = df.select(F.col(id_col), text_of(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {id_type}, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from labelled ones that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    machine = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, machine).select("doc_id", held_out().alias("held_out"), "score", "predicted")
