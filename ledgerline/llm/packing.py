"""Harmonic packing of token sequences: class k holds pieces of at most capacity / k tokens, k to a bin."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, Known, buffers, give_back, save, slices, text_of, words_in

#: What one more piece costs, in tokens of padding.
PIECE_COST = 12


def classes(capacity: int) -> list[int]:
    """Reciprocal-capacity classes: pieces per bin. All up to 64, then doublings."""
    ks = [k for k in range(1, 65) if k <= capacity]
    while ks[-1] * 2 <= capacity:
        ks.append(ks[-1] * 2)
    return ks


@lru_cache(maxsize=8)
def cuts(capacity: int) -> tuple[tuple[int, int, int], ...]:
    """For a rest of r tokens: (length of its next piece, class of that piece, cost of the rest from there).

    Padding up to the class limit plus PIECE_COST per piece is least."""
    limits = sorted({(capacity // k, k) for k in classes(capacity)}, reverse=True)
    best: list[tuple[int, int, int]] = [(0, 0, 0)]
    for r in range(1, capacity + 1):
        whole = min((limit, k) for limit, k in limits if limit >= r)
        options = [(PIECE_COST + whole[0] - r, r, whole[1])]
        options += [(PIECE_COST + best[r - limit][2], limit, k) for limit, k in limits if limit < r]
        cost, length, k = min(options)
        best.append((length, k, cost))
    return tuple(best)


def cut(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """Pieces (length, class) of n tokens."""
    table = cuts(capacity)
    while n > capacity:
        yield capacity, 1
        n -= capacity
    while n:
        length, k, _ = table[n]
        yield length, k
        n -= length


#: Words of letters alone that normalising only lower-cases.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
#: Byte-level vocabularies show bytes without a printable character from 256 on, in turn.
BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


class WordEncoder:
    """Ids of whole texts by a tokenizer that lower-cases and whose words are runs of letters, runs of marks, single digits and contractions."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.merge = self.model.model.tokenize
        self.known = Known(self.ids_of)

    def ids_of(self, words: list[str]) -> list[list[int]]:
        """Ids of words. Latin letters go to the tokenizer's merges at once, a character for a byte; others its whole way."""
        plain = [LETTERS(w) is not None for w in words]
        others = iter(self.model.encode_batch_fast([w for w, p in zip(words, plain, strict=True) if not p], add_special_tokens=False))
        return [[t.id for t in self.merge(w.lower().encode().decode("latin-1").translate(BYTES))] if p else next(others).ids for w, p in zip(words, plain, strict=True)]

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, where each row begins in them and the end)."""
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        plain = b"<|" not in data.tobytes()  # special tokens are told apart by case
        data = LOWER[data] if plain else data
        h, row, first, end = words_in(data, offsets, stops=plain)
        ids, upto = self.known(data, h, first, end)
        return ids, upto[np.searchsorted(row, np.arange(len(offsets)))]


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """One encoder, with the words that it knows, for all tasks that a Python worker runs."""
    return WordEncoder(path)


def fill(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """First fit: (bin, offset) of each piece in turn."""
    room = np.zeros(0, np.int64)
    bins, at = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, n in enumerate(lengths):
        fits = np.flatnonzero(room >= n)
        b = int(fits[0]) if len(fits) else len(room)
        if b == len(room):
            room = np.append(room, capacity)
        bins[i], at[i] = b, capacity - room[b]
        room[b] -= n
    return bins, at


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 2, with_ids: bool = True) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if with_ids.

    Each worker cuts its documents into pieces of the reciprocal classes and numbers the pieces of a class on its own.
    Counts per class and worker, summed, give each worker its first number, so k pieces in number order fill a bin
    of class k wherever they were made. What is left of the classes, fewer than k pieces each (below 2,016 + 8,064
    pieces for 4,096 tokens, however large the table), is packed by first fit, longest first, in one small task.

    Null text counts as empty; an empty text is the end id alone. Repeated rows are packed once each. An empty table
    gives an empty result. Extra columns are ignored."""
    columns = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("_k", pa.int32()), ("_worker", pa.int32()), ("_n", pa.int64())]
    if with_ids:
        columns.append(("ids", pa.list_(pa.int32())))

    def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, worker, made = encoder(tokenizer), TaskContext.get().partitionId(), dict.fromkeys(classes(capacity), 0)
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for i, j in slices(offsets):
                ids, ends = encode(data, offsets[i : j + 1])
                out: list[list] = [[] for _ in range(len(columns) + 1)]
                keys = batch.column(0).slice(i, j - i)
                for d in range(j - i):
                    own = np.append(ids[ends[d] : ends[d + 1]], np.uint32(end_id)).astype("<u4")
                    raw, start = own.tobytes(), 0
                    for length, k in cut(len(own), capacity):
                        row = [d, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), len(own), k, worker, made[k]]
                        if with_ids:
                            row.append(own[start : start + length].astype(np.int32))
                        for x, v in zip(out, row, strict=True):
                            x.append(v)
                        made[k] += 1
                        start += length
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(out[0], pa.int64())), *(pa.array(x, kind) for x, (_, kind) in zip(out[1:], columns, strict=True))], names=[id_col, *(name for name, _ in columns)])
        give_back()

    id_type = df.schema[id_col].dataType.simpleString()
    spec = f"`{id_col}` {id_type}, start long, length long, ids_crc32 long, doc_tokens long, _k int, _worker int, _n long" + ", ids array<int>" * with_ids
    pieces = save(df.select(F.col(id_col), text_of(text_col).alias("_text")).mapInArrow(pieces_of, spec), "pieces")
    counts = save(pieces.groupBy("_k", "_worker").agg(F.count("*").alias("_c")), "piece-counts")
    total, first, begin = {r["_k"]: r["n"] for r in counts.groupBy("_k").agg(F.sum("_c").alias("n")).collect()}, {}, 0  # a row per class
    for k in sorted(total):
        first[k], begin = begin, begin + total[k] // k
    before = counts.select("_k", "_worker", F.coalesce(F.sum("_c").over(Window.partitionBy("_k").orderBy("_worker").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    table = lambda x: F.element_at(F.create_map(*(F.lit(v) for kv in (x or {0: 0}).items() for v in kv)), F.col("_k"))
    placed = pieces.join(before, ["_k", "_worker"]).withColumn("_g", F.col("_before") + F.col("_n")).withColumn("_bin", F.expr("_g div _k"))
    whole = F.col("_bin") < table({k: n // k for k, n in total.items()})
    keep = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    upto = Window.partitionBy("sequence_id").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    full = placed.filter(whole).withColumn("sequence_id", (table(first) + F.col("_bin")).cast("long")).withColumn("offset", F.coalesce(F.sum("length").over(upto), F.lit(0)).cast("long"))

    def rest_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if got := [x for x in batches if len(x)]:
            x = pd.concat(got, ignore_index=True).sort_values(["length", "_k", "_g"], ascending=[False, True, True], ignore_index=True)
            bins, at = fill(x["length"].to_numpy(), capacity)
            yield x.assign(sequence_id=bins + begin, offset=at)[keep]

    spec = f"`{id_col}` {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return full.select(*keep).unionByName(placed.filter(~whole).drop("_before", "_n", "_worker", "_bin").repartition(1).mapInPandas(rest_of, spec))


def tokenizer_file(name: str) -> Callable[[], str] | str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 4,096 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), str(tokenizer_file("word_bpe_49k.json")), with_ids=False)
