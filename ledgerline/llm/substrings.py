"""Removal of passages that occur earlier, by compressed FM-indexes over word sequences.

A shard cannot hold all text, and streaming all documents against all shards would grow with their product. So equal
windows are first brought to one shard: in a window of `length` words the word 6-gram with the smallest hash is its
anchor, which equal windows share. Neighbouring windows with one anchor form a run of words. Runs whose anchor occurs
twice or more are dealt to shards by anchor, different runs once each. Every shard builds an FM-index of its runs, of
which only the wavelet matrix is kept, and streams the documents' runs against it in their order: backward search
gives the matching statistic of each window's end and the suffix interval. A window whose statistic reaches `length`
starts earlier elsewhere if its interval was met before.

An anchor with more than HOT_RUNS different runs, such as a common phrase amid other words each time, would be too much
for a shard. Its runs are cut into single windows, of which equal ones come together by a hash of all their words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffers, discard, give_back, grams, mix, row_bounds, save, sequence_hashes, slices, small_side, text_of, words_in

#: The filter of repeated anchors has at most so many 64-bit words (128 MB); with more anchors more runs pass needlessly.
FILTER_WORDS = 1 << 24
#: Words of different runs in a shard, about, and different runs of one anchor at most.
SHARD_WORDS = 500_000
HOT_RUNS = 1_000
#: Different runs that a task holds at a time before it hands them on.
HELD_RUNS = 20_000


class Bits:
    """A bit vector with rank, in words of 64 bits and a running count for each."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.frombuffer(packed.tobytes() + bytes(8 + -len(packed) % 8), "<u8")
        self.count = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))]).astype(np.int64)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = i >> 6
        below = self.words[word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.count[word] + np.bitwise_count(below)


class FMIndex:
    """FM-index of word sequences: the transform of their text in a wavelet matrix; text and suffixes aren't kept."""

    def __init__(self, runs: list[np.ndarray]):
        sizes = np.array([len(r) for r in runs], np.int64)
        begin = np.cumsum(sizes + 1) - sizes - 1
        flat = np.concatenate(runs)
        self.alphabet, codes = np.unique(flat, return_inverse=True)
        self.n = len(flat) + len(runs)
        text = np.zeros(self.n, np.int64)  # 0 ends a run
        inside = np.ones(self.n, bool)
        inside[begin + sizes] = False
        text[inside] = codes + 1
        rank = text + len(runs)
        rank[~inside] = np.arange(len(runs))
        bwt = text[self._sorted(rank) - 1]
        self.sigma = len(self.alphabet) + 1
        self.before = np.concatenate([[0], np.cumsum(np.bincount(bwt, minlength=self.sigma))])
        self.levels: list[tuple[int, Bits, int]] = []
        for bit in range(max(1, int(self.sigma - 1).bit_length()) - 1, -1, -1):
            ones = (bwt >> bit & 1).astype(bool)
            self.levels.append((bit, Bits(ones), len(ones) - int(ones.sum())))
            bwt = np.concatenate([bwt[~ones], bwt[ones]])
        self.origin = self._down(np.arange(self.sigma), np.zeros(self.sigma, np.int64))

    def _sorted(self, rank: np.ndarray) -> np.ndarray:
        """Suffixes in order, by doubling; each run ends in a symbol of its own, so all differ within a run's length."""
        step = 1
        _, rank = np.unique(rank, return_inverse=True)
        while True:
            key = rank * (self.n + 1)
            key[: self.n - step] += rank[step:] + 1
            order = np.argsort(key, kind="stable")
            new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            rank = np.empty(self.n, np.int64)
            rank[order] = new
            step *= 2
            if new[-1] == self.n - 1 or step >= self.n:
                return order

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bit, ones, zeros in self.levels:
            r = ones.rank(i)
            i = np.where(symbol >> bit & 1, zeros + r, i - r)
        return i

    def step(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """One step of backward search for a bound of each interval."""
        return self.before[symbol] + self._down(symbol, i) - self.origin[symbol]

    def codes(self, symbols: np.ndarray) -> np.ndarray:
        """Symbols as the index has them; 0 for those that it doesn't have."""
        at = np.minimum(np.searchsorted(self.alphabet, symbols), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == symbols, at + 1, 0)

    def matching(self, codes: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(matching statistic, its interval) of the end of each window of `length` codes from a start.

        The statistic is how many symbols up to the end are found at two places or more, `length` at most. A window of
        a run in the index is itself one of the places, so below `length` it is nowhere else."""
        matched, lo, hi = (np.zeros(len(start), np.int64) for _ in range(3))
        active, a, b = np.arange(len(start)), np.zeros(len(start), np.int64), np.full(len(start), self.n, np.int64)
        for j in range(length - 1, -1, -1):
            symbol = codes[start[active] + j]
            a, b = self.step(symbol, a), self.step(symbol, b)
            many = (b - a > 1) & (symbol > 0)
            active, a, b = active[many], a[many], b[many]
            if not len(active):
                break
            matched[active], lo[active], hi[active] = length - j, a, b
        return matched, lo, hi


def runs_in(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of rows: (anchor, row, first word in the row, windows, first word in all, hashes of all words)."""
    k = min(6, length)
    h, row, _, _ = words_in(data, offsets)
    n = len(h) - length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, h
    g = grams(h, k)
    best, at = g[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, length - k + 1):
        other = g[j : j + n]
        less = other < best
        best[less] = other[less]
        at[less] = j
    start = np.flatnonzero(row[:n] == row[length - 1 :])
    if not len(start):
        return *(np.zeros(0, np.int64) for _ in range(5)), h
    place = start + at[start]
    new = np.concatenate([[True], (np.diff(place) != 0) | (np.diff(start) != 1)])
    first = start[new]
    windows = np.diff(np.append(np.flatnonzero(new), len(start)))
    return g[place[new]].view(np.int64), row[first], first - row_bounds(row, len(offsets) - 1)[row[first]], windows, first, h


def filter_bits(anchor: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Word of a Bloom filter for each anchor, and its four bits there."""
    a, bits = anchor.view(np.uint64), np.zeros(len(anchor), np.uint64)
    for shift in (24, 30, 36, 42):
        bits |= np.uint64(1) << ((a >> np.uint64(shift)) & np.uint64(63))
    return (a & np.uint64(words - 1)).astype(np.int64), bits


def anchor_filter(anchors: DataFrame) -> np.ndarray:
    """A Bloom filter of saved anchors, about 10 bits each and FILTER_WORDS at most; its segments are made by tasks."""
    n = anchors.count()
    words = 1 << min(FILTER_WORDS.bit_length() - 1, max(13, (10 * n // 64).bit_length()))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            at, bits = filter_bits(batch.column(0).to_numpy(), words)
            for segment in np.unique(at >> 13):
                here = at >> 13 == segment
                np.bitwise_or.at(parts.setdefault(int(segment), np.zeros(8192, np.uint64)), at[here] & 8191, bits[here])
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array([x.tobytes() for x in parts.values()], pa.binary())], names=["segment", "bits"])

    segment = F.shiftright(F.col("anchor").bitwiseAND(F.lit(words - 1)), 13)
    out = np.zeros(words, np.uint64)
    for row in anchors.repartition(segment).mapInArrow(made, "segment long, bits binary").toLocalIterator():
        out[row["segment"] * 8192 : (row["segment"] + 1) * 8192] |= np.frombuffer(row["bits"], np.uint64)
    return out


def remove_repeats(df: DataFrame, length: int = 20, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of df: id, n_words, n_removed, kept_sha256, and with_text kept_text (kept words joined by a space).

    Each word is removed that lies in a window of `length` consecutive words (of [^\\x20\\x09-\\x0D]) of one text whose
    sequence also starts earlier: in a text of a smaller id, or before it in the same text. Windows are judged on the
    input. 2 <= length <= 64. Ids can be of any type that has an order. Null texts have no words; texts of fewer words
    keep all. Rows that repeat an id and text are at the same places, so neither removes the other; rows with a null id
    are kept whole and remove nothing. Very long texts are handled whole. An empty table gives an empty result; extra
    columns are ignored but for those in `carry`, which are handed on.

    Words go into the index as 64-bit hashes, and equal runs meet by a 64-bit hash of theirs."""
    if not 2 <= length <= 64:
        raise ValueError("length must be 2 to 64")
    carried = [f"_c{k}" for k in range(len(carry))]
    docs = df.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"), F.hash(text_of(text_col)).alias("_print"), *(F.col(c).alias(x) for c, x in zip(carry, carried, strict=True)))
    id_type = df.schema[id_col].dataType.simpleString()
    known = docs.filter("_id is not null").select("_id", "_text", "_print")

    def anchors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            for i, j in slices(offsets):
                yield pa.RecordBatch.from_arrays([pa.array(runs_in(data, offsets[i : j + 1], length)[0])], names=["anchor"])

    anchors = known.select("_text").mapInArrow(anchors_of, "anchor long")
    again = save(anchors.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "anchors")
    passes = df.sparkSession.sparkContext.broadcast(anchor_filter(again))

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Runs whose anchor passes the filter: (batch, first row, rows, anchor, run, row, s, windows, first word, hashes)."""
        seen = passes.value
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for i, j in slices(offsets):
                anchor, row, s, windows, first, h = runs_in(data, offsets[i : j + 1], length)
                at, bits = filter_bits(anchor, len(seen))
                take = seen[at] & bits == bits
                anchor, row, s, windows, first = (x[take] for x in (anchor, row, s, windows, first))
                run = mix(sequence_hashes(h, first, windows + length - 1).view(np.uint64) * np.uint64(5) + anchor.view(np.uint64)).view(np.int64)
                yield batch, i, j - i, anchor, run, row, s, windows, first, h
        give_back()

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, n, _, run, row, s, windows, _, _ in repeated(batches):
            own = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(run), *(batch.column(k).slice(i, n).take(own) for k in (0, 2)), pa.array(s << 6 | windows)], names=["run", "_id", "_print", "place"])

    names = ["anchor", "run", "_id", "place", "words"]

    def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each different run of the task, with its first place and its words; a few twice if there are many."""
        different: dict[int, tuple] = {}

        def handed_on() -> Iterator[pa.RecordBatch]:
            rows = [(a, key, *rest) for key, (a, *rest) in different.items()]
            different.clear()
            for k in range(0, len(rows), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows[k : k + 5000], strict=True), kinds, strict=True)], names=names)

        for batch, i, n, anchor, run, row, s, windows, first, h in repeated(batches):
            kinds = [pa.int64(), pa.int64(), batch.column(0).type, pa.int64(), pa.binary()]
            own = batch.column(0).slice(i, n).take(pa.array(row)).to_pylist()
            for key, a, doc, at, w, f in zip(run.tolist(), anchor.tolist(), own, (s << 6 | windows).tolist(), (windows + length - 1).tolist(), first.tolist(), strict=True):
                old = different.get(key)
                if old is None or (doc, at) < old[1:3]:
                    different[key] = (a, doc, at, old[3] if old else h[f : f + w].tobytes())
            if len(different) > HELD_RUNS:
                yield from handed_on()
        if different:
            yield from handed_on()

    texts = save(known.select("_id", "_text").mapInArrow(texts_of, f"anchor long, run long, _id {id_type}, place long, words binary"), "runs")
    hot = save(texts.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_RUNS).select("anchor"), "hot-anchors")
    shards = max(2, -(-(texts.agg(F.sum(F.octet_length("words"))).first()[0] or 0) // (8 * SHARD_WORDS)))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each different run: its first place, and which of its windows start earlier in another run."""
        if not (got := [b for b in batches if b.num_rows]):
            return
        table = pa.Table.from_batches(got)
        table = table.sort_by([("_id", "ascending"), ("place", "ascending"), ("run", "ascending")])
        _, keep = np.unique(table["run"].to_numpy(), return_index=True)
        table = table.take(pa.array(np.sort(keep)))
        runs = [np.frombuffer(w, np.uint64) for w in table["words"].to_pylist()]
        index, masks = FMIndex(runs), []
        met = np.zeros(index.n, bool)
        for k in range(0, len(runs), 4000):  # in the order of documents
            part = runs[k : k + 4000]
            sizes = np.array([len(r) for r in part])
            windows = sizes - length + 1
            nth = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
            matched, lo, _ = index.matching(index.codes(np.concatenate(part)), np.repeat(np.cumsum(sizes) - sizes, windows) + nth, length)
            full = np.flatnonzero(matched == length)
            earlier = met[lo[full]]
            _, first = np.unique(lo[full], return_index=True)
            again_here = np.ones(len(full), bool)
            again_here[first] = False
            met[lo[full]] = True
            bits = np.zeros(len(nth), np.int64)
            bits[full] = np.where(earlier | again_here, np.int64(1) << nth[full], 0)
            masks.append(np.add.reduceat(bits, np.cumsum(windows) - windows))
        out = [table["run"], table["_id"], table["place"], pa.chunked_array([pa.array(np.concatenate(masks))])]
        yield pa.RecordBatch.from_arrays([x.combine_chunks() for x in out], names=["run", "first_id", "first_place", "mask"])
        del index, table, runs, met
        give_back()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows of runs: (hash of its words, run, nth window of it, first place of the run)."""
        for batch in (b.slice(i, 5000) for b in batches for i in range(0, b.num_rows, 5000)):
            runs = [np.frombuffer(w, np.uint64) for w in batch.column(2).to_pylist()]
            sizes = np.array([len(r) for r in runs])
            windows = sizes - length + 1
            own, nth = np.repeat(np.arange(len(runs)), windows), np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
            key = sequence_hashes(np.concatenate(runs), (np.cumsum(sizes) - sizes)[own] + nth, np.full(len(own), length))
            first = batch.column(1).take(pa.array(own))
            yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0).take(pa.array(own)), pa.array(nth), *(first.field(k) for k in (0, 1))], names=["window", "run", "nth", "first_id", "first_place"])

    cold = texts.join(small_side(hot), "anchor", "left_anti").select("anchor", "run", "_id", "place", "words")
    firsts = cold.repartition(shards, "anchor").mapInArrow(searched, f"run long, first_id {id_type}, first_place long, mask long")
    if not hot.isEmpty():
        once = texts.join(small_side(hot), "anchor").groupBy("run").agg(F.min(F.struct("_id", "place")).alias("first"), F.first("words").alias("words"))
        parts = save(once.mapInArrow(cut_up, f"window long, run long, nth long, first_id {id_type}, first_place long"), "windows")
        start = (F.shiftright("first_place", 6) + F.col("nth")).alias("start")
        earliest = parts.groupBy("window").agg(F.min(F.struct("first_id", start)).alias("earliest"))
        judged = parts.join(earliest, "window").withColumn("bit", F.when(F.struct("first_id", start) != F.col("earliest"), F.expr("shiftleft(1L, cast(nth as int))")).otherwise(F.lit(0).cast("long")))
        firsts = firsts.union(judged.groupBy("run", "first_id", "first_place").agg(F.sum("bit").alias("mask")))
    firsts = save(firsts, "searched")
    discard(texts)
    every = F.expr("shiftleft(1L, cast(place & 63 as int)) - 1")
    elsewhere = (F.col("_id") != F.col("first_id")) | (F.col("place") != F.col("first_place"))
    marks = known.mapInArrow(occurrences, f"run long, _id {id_type}, _print int, place long").join(firsts, "run")
    marks = marks.withColumn("mask", F.when(elsewhere, every).otherwise(F.col("mask"))).filter("mask <> 0")
    marks = marks.groupBy("_id", "_print").agg(F.collect_list(F.struct(F.shiftright("place", 6).alias("s"), "mask")).alias("marks"))

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bit = np.arange(63, dtype=np.int64)
        for batch in batches:
            ids, texts, lists = batch.column(0), batch.column(1), batch.column(2)
            for i in range(0, batch.num_rows, 500):
                out: list[list] = [[], [], [], []]
                for text, list_ in zip(texts.slice(i, 500), lists.slice(i, 500), strict=True):
                    words, removed = text.as_py().encode().split(), 0
                    n = len(words)
                    if list_.is_valid:
                        s, mask = (list_.values.field(k).to_numpy().astype(np.int64) for k in (0, 1))
                        edge = np.zeros(n + 1, np.int64)
                        which, nth = np.nonzero(mask[:, None] >> bit & 1)
                        np.add.at(edge, s[which] + nth, 1)
                        np.add.at(edge, s[which] + nth + length, -1)
                        gone = np.cumsum(edge)[:n] > 0
                        removed = int(gone.sum())
                        words = [w for w, x in zip(words, gone.tolist(), strict=True) if not x]
                    kept = b" ".join(words)
                    for x, v in zip(out, (n, removed, hashlib.sha256(kept).hexdigest(), kept if with_text else None), strict=True):
                        x.append(v)
                columns = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())]
                if with_text:
                    columns.append(pa.array(out[3], pa.binary()).cast(pa.string()))
                columns += [batch.column(k).slice(i, 500) for k in range(3, 3 + len(carried))]
                yield pa.RecordBatch.from_arrays([ids.slice(i, 500), *columns], names=["_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text, *carried])

    result = docs.join(marks.hint("shuffle_merge"), ["_id", "_print"], "left").select("_id", "_text", "marks", *carried)
    kind = ", ".join(f"{x} {docs.schema[x].dataType.simpleString()}" for x in carried)
    result = result.mapInArrow(cleaned, f"_id {id_type}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text + f", {kind}" * bool(carried))
    own = [] if id_col in carry else [F.col("_id").alias(id_col)]
    texts = ["kept_text"] * with_text
    return result.select(*own, "n_words", "n_removed", "kept_sha256", *texts, *(F.col(x).alias(c) for c, x in zip(carry, carried, strict=True)))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 20 words that start earlier elsewhere, removed from all documents."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
