"""What the operators of this subpackage share: scratch tables, size-checked joins, numbering, word hashes."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import re
import struct
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side is broadcast only if it has been measured and has at most so many bytes.
BROADCAST_BYTES = 64_000_000
#: Text is handled in Python in slices of about so many bytes, so memory does not follow the batch size.
SLICE_BYTES = 1 << 19
#: Rows go to Python in batches of at most about so many bytes while a table is saved.
BATCH_BYTES = 8_000_000


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares.

    That is spark.checkpoint.dir, or else the context's checkpoint folder. Where neither is set and Spark runs in one
    process, as in tests, an own folder becomes the context's; on a cluster a missing setting is an error."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a written table: lineage ends here and a lost executor costs no recomputation. options: of the writer."""
    path, conf, limit = scratch(df.sparkSession, name), df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(limit)
    conf.set(limit, BATCH_BYTES)
    try:
        df.write.options(**options).parquet(path)
    finally:
        conf.set(limit, before)
    saved = df.sparkSession.read.schema(df.schema).parquet(path)
    saved.saved_at = path
    return saved


def discard(*saved: DataFrame) -> None:
    """Delete saved tables that nothing reads any more, results not yet computed included."""
    for df in saved:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def bytes_of(df: DataFrame) -> int:
    """Bytes of a saved df's rows in memory, about: measured for strings, binaries and arrays, else 16 a column."""
    wide = [f.name for f in df.schema if f.dataType.typeName() in ("string", "binary", "array", "map", "struct")]
    sizes = [F.coalesce(F.octet_length(df[c].cast("string") if df.schema[c].dataType.typeName() != "binary" else df[c]), F.lit(0)) for c in wide]
    n, more = df.agg(F.count("*"), F.sum(sum(sizes, F.lit(0)).cast("long"))).first()
    return n * 16 * (1 + len(df.columns)) + (more or 0)


def small_side(df: DataFrame) -> DataFrame:
    """A saved df, hinted for broadcast if its bytes stay below BROADCAST_BYTES; else left to a shuffled join."""
    return F.broadcast(df) if bytes_of(df) <= BROADCAST_BYTES else df.hint("shuffle_merge")


def lanes(spark: SparkSession) -> int:
    return max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))


def numbered(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """df with a column `name`: 0, 1, 2, ... in each group without gaps.

    Rows are numbered inside hash lanes of the group, and each lane starts where the one before ends, so a group of
    any size is spread over many tasks. df is evaluated twice and should be a saved table."""
    n = lanes(df.sparkSession)
    laned = df.withColumn("_lane", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    begin = (
        laned.groupBy(*group, "_lane")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_lane").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("_n")
    )
    inside = laned.withColumn("_in", F.row_number().over(Window.partitionBy(*group, "_lane").orderBy(*order)) - 1)
    return inside.join(begin, [*group, "_lane"]).withColumn(name, (F.col("_before") + F.col("_in")).cast("long")).drop("_lane", "_before", "_in")


def give_back() -> None:
    """Return memory that this Python worker has freed but holds: workers outlive tasks and share their executor's room."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


# ---------------------------------------------------------------- words as 64-bit hashes, without a Python object per word

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
#: The first 0 to 8 bytes of eight.
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Spans of more bytes are handled one by one.
LONG = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is as empty."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    col = col.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `limit` bytes each; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


#: Kinds of bytes: 1 ASCII letter, 2 mark, 3 digit, 4 apostrophe, 0 the others.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 2
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 3
_KIND[39] = 4
#: Whether a word of the tokenizer surely ends between two kinds: a run of letters, a run of marks, a single digit.
_ENDS = np.zeros(25, bool)
_ENDS[[5 * a + b for a, b in ((1, 2), (1, 3), (1, 4), (2, 1), (2, 3), (3, 1), (3, 2), (3, 3), (3, 4), (4, 3))]] = True


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position, as a little-endian number; behind the end are zeros."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))


def span_hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """A hash of each span of bytes; lower: A-Z count as a-z.

    Eight bytes at a time go through mix, so that no form of the input makes spans collide but by chance; spans of
    more than LONG bytes are hashed by blake2b."""
    data = LOWER[data] if lower else data
    view, size = eights(data), end - first
    h = mix(size.astype(np.uint64) * np.uint64(_BASE))
    on = np.arange(len(h))
    for k in range(0, LONG, 8):
        on = on[size[on] > k] if k else on
        if not len(on):
            break
        part = view[first[on] + k] & _HEAD[np.minimum(size[on] - k, 8)]
        h[on] = mix(h[on] ^ part)
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[first[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def same_spans(data: np.ndarray, first: np.ndarray, end: np.ndarray, first2: np.ndarray, end2: np.ndarray) -> np.ndarray:
    """Whether spans of bytes are equal to other spans, byte by byte."""
    view, size = eights(data), end - first
    same = size == end2 - first2
    on = np.flatnonzero(same & (first != first2))
    for k in range(0, LONG, 8):
        on = on[size[on] > k] if k else on
        if not len(on):
            break
        same[on] &= ((view[first[on] + k] ^ view[first2[on] + k]) & _HEAD[np.minimum(size[on] - k, 8)]) == 0
    for i in on[size[on] > LONG].tolist():
        same[i] = data[first[i] : end[i]].tobytes() == data[first2[i] : end2[i]].tobytes()
    return same


def words_in(data: np.ndarray, offsets: np.ndarray, lower: bool = False, stops: bool = False) -> tuple[np.ndarray, ...]:
    """Words [^\\x20\\x09-\\x0D]+ of rows that lie side by side in data: (hash, row, first byte, end byte).

    stops: a word also ends between ASCII letters, marks and digits, but not between an apostrophe and a letter."""
    lo = int(offsets[0])
    data, offsets = data[lo : int(offsets[-1])], offsets - lo
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    space = _SPACE[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = space[:-1], space[1:]
    at = offsets[(offsets > 0) & (offsets < n)]
    before[at], after[at - 1] = True, True
    if stops:
        kind = _KIND[data]
        ends = _ENDS[kind[:-1] * np.uint8(5) + kind[1:]]
        before[1:] |= ends
        after[:-1] |= ends
    first, end = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return span_hashes(data, first, end, lower), np.searchsorted(offsets, first, "right") - 1, first + lo, end + lo


class Known:
    """Token ids of spans of bytes: each different span is encoded once and kept in a cache that is emptied when full.

    The cache goes by bytes. Hashes only group the spans of a call, and a span that isn't what its group holds is told apart."""

    def __init__(self, encode, most: int = 150_000):
        self.encode, self.most, self.ids = encode, most, {}

    def __call__(self, data: np.ndarray, h: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all spans in turn, number of ids up to each span and in all). encode: list of strings -> id lists."""
        if not len(h):
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        if len(self.ids) > self.most:
            self.ids.clear()
        begin = int(first.min())
        data, first, end = data[begin : int(end.max())], first - begin, end - begin
        _, at, back = np.unique(h, return_index=True, return_inverse=True)
        odd = np.flatnonzero(~same_spans(data, first, end, first[at[back]], end[at[back]]))
        if len(odd):
            places: dict[bytes, int] = {}
            back[odd] = [places.setdefault(data[first[i] : end[i]].tobytes(), len(at) + len(places)) for i in odd.tolist()]
            _, once = np.unique(back[odd], return_index=True)
            at = np.concatenate([at, odd[once]])
        raw = data.tobytes()
        keys, known = [raw[a:b] for a, b in zip(first[at].tolist(), end[at].tolist(), strict=True)], self.ids
        each = list(map(known.get, keys))
        if new := [i for i, x in enumerate(each) if x is None]:
            for i, x in zip(new, self.encode([keys[i].decode() for i in new]), strict=True):
                each[i] = struct.pack(f"<{len(x)}I", *x)
                if len(keys[i]) <= LONG:
                    known[keys[i]] = each[i]
        lengths = np.fromiter(map(len, each), np.int64, len(each)) // 4
        flat, begins = np.frombuffer(b"".join(each), "<u4"), np.cumsum(lengths) - lengths
        n = lengths[back]
        after = np.concatenate([[0], np.cumsum(n)])
        return flat[np.repeat(begins[back] - after[:-1], n) + np.arange(after[-1])], after


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position that has n words after it, across rows too."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(_BASE) + h[i : i + len(out)]
    return mix(out + np.uint64(n))


def sequence_hashes(h: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each sequence of word hashes, from those of its first and its last power of two of words."""
    out = np.zeros(len(first), np.uint64)
    level, step = h, 1
    while len(first):
        on = (size >= step) & (size < 2 * step)
        a, b = level[first[on]], level[first[on] + size[on] - step]
        out[on] = mix(mix(a + size[on].astype(np.uint64)) * np.uint64(_BASE) + b)
        if 2 * step > size.max():
            break
        level = mix(mix(level[:-step]) * np.uint64(_BASE) + level[step:])
        step *= 2
    return out.view(np.int64)


def row_bounds(row: np.ndarray, n: int) -> np.ndarray:
    """Where each of n rows begins in an array sorted by row, and the end."""
    return np.searchsorted(row, np.arange(n + 1))
