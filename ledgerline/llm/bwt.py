"""Removal of byte strings that a document with a smaller id has too, by Burrows-Wheeler transforms built column by column.

No task can hold the suffixes of all text, so strings that can share a window of `length` bytes are first brought
together: the smallest hash of the GRAM-byte grams of a window is its anchor, which equal windows share, and
neighbouring windows with one anchor form a string of some 60 bytes. Strings whose anchor occurs once are left out.
Equal strings are one, with the smallest id that has it; those that share their anchor with another go to a collection of about SHARD_BYTES.

Each collection's transform is built from the right: round j inserts the symbol of every string that is the j-th from
its end. The transform of round j is known, so a stable sort of it by symbol says where each suffix of j + 1 symbols
goes; its common prefix with each neighbour is one more than the least between their tails in the round before. Old
symbols keep their order, so transform and common prefixes are read and written in sequence. They lie in tables of the
shared folder, one row a collection, which a pass reads, advances by COLUMNS rounds and writes anew.

In the end suffixes with a common prefix of `length` form a class, and the smallest id of its strings says in which of
them the window is repeated."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffers, discard, eights, give_back, mix, save, slices, span_hashes, text_of

GRAM = 24
#: Windows in a string at most.
WINDOWS = 32
#: Bytes of a collection, about; no anchor that is not hot has more.
SHARD_BYTES = 2_000_000
#: Strings of an anchor that occurs more often are cut into their windows, which are dealt by their first and last bytes too.
HOT = 30_000
#: Rounds in a pass.
COLUMNS = 26
#: Bits of a filter: 2 ** FILTER words at most (128 MB). With more anchors more strings pass needlessly.
FILTER = 24
#: Anchors and strings that a task holds before it hands them on.
HELD_ANCHORS, HELD_STRINGS = 1 << 20, 1 << 18
#: Text of which the strings are found at a time.
TEXT_BYTES = 1 << 20
END = 0  # bytes are shifted by one; UTF-8 has none above 0xF4


# ---------------------------------------------------------------- strings


def grams_of(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each position that has as many; k is 8 at least."""
    a, step = eights(data)[: len(data) - 7] * np.uint64(0x9E3779B97F4A7C15), 8
    a ^= a >> np.uint64(32)
    while step < k:
        more = min(step, k - step)
        a = a[:-more] * np.uint64(0xD6E8FEB86659FD93) + a[more:]
        a ^= a >> np.uint64(32)
        a *= np.uint64(0x9E3779B97F4A7C15)
        a ^= a >> np.uint64(29)
        step += more
    return a


def strings_in(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings of rows that lie side by side in data: (anchor, first byte, windows)."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = min(GRAM, length)
    least, step = grams_of(data, k), 1
    while step < length - k + 1:
        more = min(step, length - k + 1 - step)
        least = np.minimum(least[:-more], least[more:])
        step += more
    inside = np.ones(n, bool)
    for end in offsets[1:-1].tolist():
        inside[max(0, end - length + 1) : end] = False
    edge = np.ones(n + 1, bool)
    np.not_equal(least[1:], least[:-1], out=edge[1:n])
    edge[:n] |= ~inside
    edge[1:n] |= ~inside[:-1]
    first = np.flatnonzero(edge)
    windows = np.diff(first)
    first = first[:-1]
    ok = inside[first]
    first, windows = first[ok], windows[ok]
    if len(first) and windows.max() > WINDOWS:  # the same gram again and again
        parts = -(-windows // WINDOWS)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, windows = np.repeat(first, parts) + nth * WINDOWS, np.minimum(np.repeat(windows, parts) - nth * WINDOWS, WINDOWS)
    return mix(least[first]), first, windows


def in_filter(bits: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    at, mask = _places(anchor, len(bits))
    return bits[at] & mask == mask


def _places(anchor: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Word of a Bloom filter for each anchor, by its upper bits, and its four bits there."""
    mask = np.zeros(len(anchor), np.uint64)
    for shift in (0, 6, 12, 18):
        mask |= np.uint64(1) << ((anchor >> np.uint64(shift)) & np.uint64(63))
    return (anchor >> np.uint64(65 - words.bit_length())).astype(np.int64), mask


def anchor_filter(anchors: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter of saved anchors (segment, and arrays of 64-bit anchors as binary), about 10 bits each; tasks make its segments."""
    n = (anchors.agg(F.sum(F.octet_length(column))).first()[0] or 0) // 8
    words = 1 << min(FILTER, max(SEGMENT_BITS, (10 * n // 64).bit_length()))
    part = words >> SEGMENT_BITS

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                at, mask = _places(np.frombuffer(raw.as_buffer(), np.uint64), words)
                np.bitwise_or.at(parts.setdefault(segment, np.zeros(part, np.uint64)), at - segment * part, mask)
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([x.tobytes() for x in parts.values()], pa.binary())], names=["segment", "bits"])

    out = np.zeros(words, np.uint64)
    for row in anchors.select("segment", column).repartition("segment").mapInArrow(made, "segment int, bits binary").toLocalIterator():
        out[row["segment"] * part : (row["segment"] + 1) * part] |= np.frombuffer(row["bits"], np.uint64)
    return out


#: Segments of anchors are at least 2 ** SEGMENT_BITS; those of strings are as many as make about SEGMENT_BYTES each.
SEGMENT_BITS, SEGMENT_BYTES = 8, 8_000_000


def repeated_anchors(texts: DataFrame, length: int, hot: int) -> DataFrame:
    """Saved (segment, again, hot): anchors that occur twice or more, and those that occur more than `hot` times.

    Anchors travel as sorted arrays, a segment (by their upper bits) a row, counted in the task that made them."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def handed_on() -> pa.RecordBatch:
            anchor, times = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            segment = (anchor >> np.uint64(64 - SEGMENT_BITS)).astype(np.int32)
            at = np.searchsorted(segment, np.arange((1 << SEGMENT_BITS) + 1))
            here = np.flatnonzero(np.diff(at)).tolist()
            cut = [(at[s], at[s + 1]) for s in here]
            more = [np.flatnonzero(times[a:b] > 1) + a for a, b in cut]  # how often is told only of these
            parts = [[anchor[a:b].tobytes() for a, b in cut], [anchor[k].tobytes() for k in more], [(times[k] - 1).astype(np.uint32).tobytes() for k in more]]
            return pa.RecordBatch.from_arrays([pa.array(here, pa.int32()), *(pa.array(x, pa.binary()) for x in parts)], names=["segment", "anchors", "more", "times"])

        for batch in batches:
            data, offsets = buffers(batch.column(0))
            for i, j in slices(offsets, TEXT_BYTES):
                held.append(strings_in(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length)[0])
                if sum(map(len, held)) > HELD_ANCHORS:
                    yield handed_on()
        if held:
            yield handed_on()
        give_back()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, times = [], []
        for batch in batches:
            for column in (1, 2):
                anchors += [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(column)]
            times += [np.ones(len(x.as_buffer()) // 8, np.int64) for x in batch.column(1)] + [np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column(3)]
        if anchors:
            anchor, n = np.concatenate(anchors), np.concatenate(times).astype(np.int64)
            order = np.argsort(anchor, kind="stable")
            anchor, n = anchor[order], n[order]
            first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])) if len(anchor) else np.zeros(0, np.int64)
            n = np.add.reduceat(n, first) if len(first) else n
            anchor = anchor[first]
            segment = (anchor >> np.uint64(64 - SEGMENT_BITS)).astype(np.int32)
            for s in np.unique(segment).tolist():
                own = segment == s
                again, often = anchor[own & (n > 1)], anchor[own & (n > hot)]
                for k in range(0, len(again), 1 << 17):
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([again[k : k + (1 << 17)].tobytes()], pa.binary()), pa.array([b"" if k else often.tobytes()], pa.binary())], names=["segment", "again", "hot"])
        give_back()

    made = texts.mapInArrow(counted, "segment int, anchors binary, more binary, times binary")
    return save(made.repartition("segment").mapInArrow(summed, "segment int, again binary, hot binary"), "anchors")


# ---------------------------------------------------------------- transforms


class Collection:
    """Transform and common prefixes of the suffixes of strings, from the empty ones on, a column of symbols a round."""

    FIELDS = ("texts", "sizes", "bwt", "lcp", "at", "who")
    KINDS = (np.uint8, np.uint8, np.uint8, np.uint8, np.int32, np.int32)

    def __init__(self, texts: np.ndarray, sizes: np.ndarray, bwt=None, lcp=None, at=None, who=None, rounds: int = 0):
        self.texts, self.sizes, self.rounds = texts, sizes, rounds
        self.ends = np.cumsum(sizes.astype(np.int64))
        m = len(sizes)
        self.bwt = self.symbols(np.arange(m), 1) if bwt is None else bwt
        self.lcp = np.zeros(m, np.uint8) if lcp is None else lcp
        #: Where the suffixes of the last round stand, in order, and whose they are.
        self.at, self.who = (np.arange(m), np.arange(m)) if at is None else (at.astype(np.int64), who.astype(np.int64))

    @classmethod
    def read(cls, rounds: int, *raw: bytes) -> Collection:
        return cls(*(np.frombuffer(x, kind) for x, kind in zip(raw, cls.KINDS, strict=True)), rounds=rounds)

    def written(self) -> list[bytes]:
        return [np.asarray(getattr(self, name), kind).tobytes() for name, kind in zip(self.FIELDS, self.KINDS, strict=True)]

    def symbols(self, who: np.ndarray, nth: int) -> np.ndarray:
        """The nth symbol from the end of each string, from 1; END before its first."""
        ok = self.sizes[who] >= nth
        out = np.zeros(len(who), np.uint8)
        out[ok] = self.texts[self.ends[who[ok]] - nth] + np.uint8(1)
        return out

    def order(self) -> np.ndarray:
        """Positions whose suffix goes on to the left, in the order of the suffixes that they go on to."""
        order = np.argsort(self.bwt, kind="stable")
        return order[np.count_nonzero(self.bwt == END) :]

    def insert(self) -> bool:
        """One round; False if no string goes on."""
        symbol = self.bwt[self.at]
        goes_on = symbol != END
        if not goes_on.any():
            return False
        m, order = len(self.sizes), self.order()
        at, symbol, who = self.at[goes_on], symbol[goes_on], self.who[goes_on]
        last = np.zeros(len(self.bwt), bool)
        last[at] = True
        new = last[order]
        places = np.flatnonzero(new)
        turn = np.argsort(symbol, kind="stable")
        place = np.empty(len(at), np.int64)  # of each new suffix among all that have a symbol, in the order of `at`
        place[turn] = places

        def least(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            """The least common prefix in [lo, hi) of the round before; hi or lo ascends, so that, taken backwards, no range between two is read."""
            pairs = np.stack([lo[::-1], hi[::-1]], 1).ravel()
            return np.minimum.reduceat(held, pairs)[::2][::-1] if len(pairs) else held[:0]

        held = np.append(self.lcp, np.uint8(0))
        bwt, lcp = np.empty(m + len(order), np.uint8), np.empty(m + len(order), np.uint8)
        bwt[:m], lcp[:m] = self.bwt[:m], 0
        old = ~new
        bwt[m:][old], lcp[m:][old] = self.bwt[m:], self.lcp[m:]
        for shift in (0, 1):  # each new suffix with the one before it, and the one behind it with it
            here = place + shift
            ok = (here > 0) & (here < len(order))
            here = here[ok]
            before, behind = order[here - 1], order[here]
            same = self.bwt[before] == self.bwt[behind]
            value = np.zeros(len(here), np.uint8)
            value[same] = least(before[same] + 1, behind[same] + 1) + np.uint8(1)
            lcp[m + here] = value
            if not shift:
                lcp[m + place[~ok]] = 0
        self.rounds += 1
        self.who, self.at = who[turn], m + places
        bwt[self.at] = self.symbols(self.who, self.rounds + 1)
        self.bwt, self.lcp = bwt, lcp
        return True

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(string, window of it, class) of all windows; those of one class are equal. All columns must be in."""
        m, order = len(self.sizes), self.order()
        to_left = np.zeros(len(self.bwt), np.int64)
        to_left[order] = m + np.arange(len(order))
        classes = np.cumsum(self.lcp < length)
        who, at, out = np.arange(m), np.arange(m), []
        for n in range(1, int(self.sizes.max()) + 1):
            ok = self.sizes[who] >= n
            who, at = who[ok], to_left[at[ok]]
            if n >= length:
                out.append((who, self.sizes[who].astype(np.int64) - n, classes[at]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def masks(collection: Collection, ids: np.ndarray, length: int) -> np.ndarray:
    """For each string the windows that a string with a smaller id has too, as bits."""
    who, nth, kind = collection.windows(length)
    least = np.full(int(kind.max(initial=0)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, kind, ids[who])
    out = np.zeros(len(ids), np.int64)
    repeated = least[kind] < ids[who]
    np.bitwise_or.at(out, who[repeated], np.int64(1) << nth[repeated])
    return out


# ---------------------------------------------------------------- the operator


def remove_shared(df: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, hot: int = HOT, shard_bytes: int = SHARD_BYTES, columns: int = COLUMNS) -> DataFrame:
    """One row per row of df: id, n_bytes, n_removed, n_spans, kept_sha256; with_text also kept (binary) and spans (first byte, end byte).

    Each byte of a text's UTF-8 form is removed that a string of `length` bytes covers which also starts in a text with a
    smaller id; matches never cross texts, and strings are judged on the input. 24 <= length <= 200. Ids are integers.

    Null texts are empty; texts of fewer bytes keep all. Rows that share an id never remove each other's bytes. Rows with a null id
    are kept whole and remove nothing. Very long texts are handled whole. An empty table gives an empty result; extra
    columns are ignored. kept need not be UTF-8, as bytes are removed and not characters.

    Strings of an anchor that occurs more than `hot` times are cut into windows and dealt by their ends too, so no
    anchor is more than a task holds. Equal strings are known by two 64-bit hashes."""
    if not 24 <= length <= 200:
        raise ValueError("length must be 24 to 200")
    id_type = df.schema[id_col].dataType.simpleString()
    if id_type not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError("ids must be integers")
    docs = df.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text"), F.hash(text_of(text_col)).alias("_print"))
    known = docs.filter("_id is not null")
    anchors = repeated_anchors(known.select("_text"), length, hot)
    n = (anchors.agg(F.sum(F.octet_length("again"))).first()[0] or 0) // 8
    bits = max(SEGMENT_BITS, (n * 300 // SEGMENT_BYTES).bit_length())  # some strings of some 80 bytes for each
    context = df.sparkSession.sparkContext
    again, often = context.broadcast(anchor_filter(anchors, "again")), context.broadcast(anchor_filter(anchors, "hot"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Strings that others may share: (key, hash, id, print, first byte in the text, windows, where it is in data, data)."""
        for batch in batches:
            ids, prints = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            whole, offsets = buffers(batch.column(1))
            for i, j in slices(offsets, TEXT_BYTES):
                data, begin = whole[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                key, first, windows = strings_in(data, begin, length)
                take = in_filter(again.value, key)
                key, first, windows = key[take], first[take], windows[take]
                cut = in_filter(often.value, key)
                if cut.any():  # windows by themselves
                    n = windows[cut]
                    own = np.repeat(first[cut], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    ends = mix(span_hashes(data, own, own + 8) ^ mix(span_hashes(data, own + length - 8, own + length)))
                    key, first, windows = np.concatenate([key[~cut], ends ^ np.repeat(key[cut], n)]), np.concatenate([first[~cut], own]), np.concatenate([windows[~cut], np.ones(len(own), np.int64)])
                row = np.searchsorted(begin, first, "right") - 1
                name = span_hashes_long(data, first, first + windows + length - 1)
                yield key.view(np.int64), name.view(np.int64), ids[i:j][row], prints[i:j][row], first - begin[row], windows, first, data
        give_back()

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Where strings are: compressed, a segment a row."""
        held: list[tuple] = []
        for key, name, own, prints, s, windows, _, _ in found(batches):
            held.append((key, name, own, prints, s << 6 | windows))
            if sum(len(x[0]) for x in held) > HELD_ANCHORS:
                yield dealt(held, bits)
        if held:
            yield dealt(held, bits)
        give_back()

    def different(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The different strings of the task, each with its smallest id, a few twice if there are many: compressed, a segment a row."""
        held: list[tuple] = []

        def handed_on() -> pa.RecordBatch:
            key, name, own = (np.concatenate([x[k] for x in held]) for k in range(3))
            texts, offsets = raw_of(pa.concat_arrays([x[3] for x in held]))
            held.clear()
            once = first_of(key, name, own)
            segment = key[once].view(np.uint64) >> np.uint64(64 - bits)
            once, segment = once[np.argsort(segment, kind="stable")], np.sort(segment)
            size = np.diff(offsets)[once]
            flat = pick(texts, offsets[once], size)
            ends, upto = np.append(np.flatnonzero(segment[1:] != segment[:-1]) + 1, len(once)), np.concatenate([[0], np.cumsum(size)])
            pack, packed, begin = zstandard.ZstdCompressor(level=1), [], 0
            for end in ends.tolist():
                part = once[begin:end]
                packed.append(pack.compress(b"".join(x.tobytes() for x in (key[part], name[part], own[part], size[begin:end].astype(np.uint8), flat[upto[begin] : upto[end]]))))
                begin = end
            return pa.RecordBatch.from_arrays([pa.array(segment[ends - 1].astype(np.int32)), pa.array(np.diff(ends, prepend=0)), pa.array(packed, pa.binary())], names=["segment", "n", "strings"])

        for key, name, own, _, _, windows, first, data in found(batches):
            once = first_of(key, name, own)
            if len(once):
                held.append((key[once], name[once], own[once], cut_out(data, first[once], windows[once] + length - 1)))
            if sum(len(x[0]) for x in held) > HELD_STRINGS:
                yield handed_on()
        if held:
            yield handed_on()
        give_back()

    fields = ", ".join(f"{x} binary" for x in ("keys", "names", "ids", *Collection.FIELDS))
    plain = "segment int, strings binary"

    def collected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Collections of the strings of each segment, whose rows come together; strings alone with their key have no shared window."""

        def made_of(held: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
            parts: list[list] = [[] for _ in range(5)]
            for n, raw in held:
                data = zstandard.ZstdDecompressor().decompress(raw)
                for k in range(3):
                    parts[k].append(np.frombuffer(data, np.int64, n, 8 * n * k))
                parts[3].append(np.frombuffer(data, np.uint8, n, 24 * n).astype(np.int64))
                parts[4].append(np.frombuffer(data, np.uint8, offset=25 * n))
            key, name, own, sizes, flat = (np.concatenate(x) for x in parts)
            once = first_of(key, name, own)
            at = (np.cumsum(sizes) - sizes)[once]
            key, name, own, sizes = key[once], name[once], own[once], sizes[once]
            more = np.zeros(len(key), bool)
            more[1:] = key[1:] == key[:-1]
            more[:-1] |= more[1:]
            if not more.all():
                lone = b"".join(x[~more].tobytes() for x in (key, name, own, np.zeros(len(key), np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([segment_of(key[:1], bits)[0]], pa.int32()), pa.array([lone], pa.binary()), pa.nulls(1, pa.int32()), *[pa.nulls(1, pa.binary())] * 9], names=names)
            key, name, own, sizes, at = key[more], name[more], own[more], sizes[more], at[more]
            size, last = np.cumsum(sizes), np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))  # where keys end
            begin = 0
            while begin < len(key):
                end = int(last[min(np.searchsorted(last, max(begin + 1, np.searchsorted(size, (size[begin - 1] if begin else 0) + shard_bytes))), len(last) - 1)])
                made = Collection(pick(flat, at[begin:end], sizes[begin:end]), sizes[begin:end].astype(np.uint8))
                raw = [x[begin:end].tobytes() for x in (key, name, own)] + made.written()
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.array([0], pa.int32()), *(pa.array([x], pa.binary()) for x in raw)], names=names)
                begin = end

        held, last = [], None
        for batch in batches:
            for segment, n, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if held and segment != last:
                    yield from made_of(held)
                    held = []
                last = segment
                held.append((n, raw))
        if held:
            yield from made_of(held)
        give_back()

    names = ["segment", "strings", "rounds", "keys", "names", "ids", *Collection.FIELDS]

    def advanced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rounds, keys, own_names, own, *raw = (batch.column(k)[i].as_py() for k in range(10))
                state = Collection.read(rounds, *raw)
                for _ in range(columns):
                    if not state.insert():
                        break
                yield pa.RecordBatch.from_arrays([pa.array([state.rounds], pa.int32()), *(pa.array([x], pa.binary()) for x in (keys, own_names, own, *state.written()))], names=names[2:])
        give_back()

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rounds, keys, own_names, own, *raw = (batch.column(k)[i].as_py() for k in range(10))
                ids = np.frombuffer(own, np.int64)
                mask = masks(Collection.read(rounds, *raw), ids, length)
                segment = segment_of(np.frombuffer(keys, np.int64, 1), bits)
                yield pa.RecordBatch.from_arrays([pa.array(segment, pa.int32()), pa.array([b"".join((keys, own_names, own, mask.tobytes()))], pa.binary())], names=names[:2])
        give_back()

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places with a repeated window (id, first byte, print, windows as bits), by segments of their ids; the strings of a
        segment come first, its places behind them."""
        strings: list[np.ndarray] = []
        held: list[tuple] = []
        last, table = None, None
        for batch in batches:
            for segment, n, raw in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if segment != last:
                    strings, last, table = [], segment, None
                if not n:
                    strings.append(np.frombuffer(raw, np.int64).reshape(4, -1))
                    continue
                if table is None:
                    table = np.concatenate(strings, 1)
                    table = table[:, np.lexsort((table[0], table[1]))]
                key, name, own, prints, place = unpacked(raw, n)
                first_id, mask = (table[k][matches(table, key, name)] for k in (2, 3))
                mask = np.where(own > first_id, (np.int64(1) << (place & 63)) - 1, mask)
                some = mask != 0
                held.append((mix(own[some].view(np.uint64)).view(np.int64), own[some], place[some] >> 6, prints[some], mask[some]))
                if sum(len(x[0]) for x in held) > HELD_ANCHORS:
                    yield dealt(held, bits)
        if held:
            yield dealt(held, bits)
        give_back()

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text: its places."""

        def made_of(held: list[list[np.ndarray]]) -> pa.RecordBatch:
            _, own, s, prints, mask = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((prints, own))
            own, prints = own[order], prints[order]
            first = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (prints[1:] != prints[:-1])))
            marks = pa.StructArray.from_arrays([pa.array(s[order]), pa.array(mask[order])], ["s", "mask"])
            return pa.RecordBatch.from_arrays([pa.array(own[first]), pa.array(prints[first]), pa.ListArray.from_arrays(pa.array(np.append(first, len(own)), pa.int32()), marks)], names=["_id", "_print", "marks"])

        held, last = [], None
        for batch in batches:
            for segment, n, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if held and segment != last:
                    yield made_of(held)
                    held = []
                last = segment
                held.append(unpacked(raw, n))
        if held:
            yield made_of(held)
        give_back()

    # no frame with an exchange keeps a name, so that its files can go as soon as it is written
    made = save(known.mapInArrow(different, "segment int, n long, strings binary").repartition("segment").sortWithinPartitions("segment").mapInArrow(collected, f"{plain}, rounds int, {fields}"), "collections", **ROWS)
    state = made.filter("rounds is not null").select(*names[2:])
    for begin in range(0, length + WINDOWS - 1, columns):
        before, state = state, save(state.mapInArrow(advanced, f"rounds int, {fields}"), "columns", **ROWS)
        if begin:
            discard(before)
    firsts = save(made.filter("rounds is null").select(*names[:2]).union(state.mapInArrow(judged, plain)), "firsts", **ROWS)
    discard(anchors, made, state)
    sides = firsts.select("segment", F.lit(0).alias("side"), F.lit(0).cast("long").alias("n"), "strings")
    sides = sides.union(known.mapInArrow(places, "segment int, n long, strings binary").select("segment", F.lit(1), "n", "strings"))
    marks = sides.repartition("segment").sortWithinPartitions("segment", "side").mapInArrow(marked, "segment int, n long, strings binary")
    del sides
    marks = marks.repartition("segment").sortWithinPartitions("segment").mapInArrow(gathered, "_id long, _print int, marks array<struct<s:long,mask:long>>")
    marks = save(marks, "marks", compression="zstd")
    discard(firsts)

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bit = np.arange(WINDOWS, dtype=np.int64)
        for batch in batches:
            whole, offsets = buffers(batch.column(1))
            lists = batch.column(2)
            for lo in range(0, batch.num_rows, 500):
                out: list[list] = [[] for _ in range(6)]
                for i in range(lo, min(lo + 500, batch.num_rows)):
                    data = whole[offsets[i] : offsets[i + 1]]
                    n, kept, spans = len(data), data, np.zeros((0, 2), np.int64)
                    if lists[i].is_valid:
                        s, mask = (lists[i].values.field(k).to_numpy() for k in (0, 1))
                        which, nth = np.nonzero(mask[:, None] >> bit & 1)
                        edge = np.bincount(s[which] + nth, minlength=n + 1) - np.bincount(s[which] + nth + length, minlength=n + 1)
                        gone = np.cumsum(edge)[:n] > 0
                        kept = data[~gone]
                        turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                        spans = turns.reshape(-1, 2)
                    raw = kept.tobytes()
                    for x, v in zip(out, (n, n - len(raw), len(spans), hashlib.sha256(raw).hexdigest(), raw if with_text else None, [{"first": a, "end": b} for a, b in spans.tolist()] if with_text else None), strict=True):
                        x.append(v)
                got = [pa.array(x, kind) for x, kind in zip(out, KINDS, strict=True)][: 6 if with_text else 4]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 500), *got], names=["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"][: 1 + len(got)])
        give_back()

    spec = "_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans array<struct<first:long,end:long>>" * with_text
    result = docs.join(marks.hint("shuffle_merge"), ["_id", "_print"], "left").select("_id", "_text", "marks").mapInArrow(cleaned, spec)
    return result.withColumn("_id", F.col("_id").cast(id_type)).withColumnRenamed("_id", id_col)


KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))
#: Rows of some megabytes: the writer looks at its memory after each.
ROWS = {"compression": "zstd", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.block.size": "8388608"}


def span_hashes_long(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans of any size below 300 bytes, eight bytes at a time."""
    half = np.minimum(first + 64, end)
    h = span_hashes(data, first, half)
    while (half < end).any():
        on = np.flatnonzero(half < end)
        upto = np.minimum(half[on] + 64, end[on])
        h[on] = mix(h[on] * np.uint64(5) + span_hashes(data, half[on], upto))
        half[on] = upto
    return h


#: Kinds of the arrays that dealt() packs: the first is what rows are dealt by.
PLACE = (np.int64, np.int64, np.int64, np.int32, np.int64)


def segment_of(key: np.ndarray, bits: int) -> np.ndarray:
    return (key.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int32)


def dealt(held: list[tuple], bits: int) -> pa.RecordBatch:
    """Held arrays as (segment, n, compressed bytes), a segment by the upper bits of the first array a row. held is emptied."""
    parts = [np.concatenate(x) for x in zip(*held, strict=True)]
    held.clear()
    segment = segment_of(parts[0], bits)
    order = np.argsort(segment, kind="stable")
    segment, parts = segment[order], [np.asarray(x[order], kind) for x, kind in zip(parts, PLACE, strict=True)]
    ends = np.append(np.flatnonzero(segment[1:] != segment[:-1]) + 1, len(segment)) if len(segment) else np.zeros(0, np.int64)
    pack, packed, begin = zstandard.ZstdCompressor(level=1), [], 0
    for end in ends.tolist():
        packed.append(pack.compress(b"".join(x[begin:end].tobytes() for x in parts)))
        begin = end
    return pa.RecordBatch.from_arrays([pa.array(segment[ends - 1]), pa.array(np.diff(ends, prepend=0)), pa.array(packed, pa.binary())], names=["segment", "n", "strings"])


def unpacked(raw: bytes, n: int) -> list[np.ndarray]:
    """The arrays of a row of dealt()."""
    data, at, out = zstandard.ZstdDecompressor().decompress(raw), 0, []
    for kind in PLACE:
        out.append(np.frombuffer(data, kind, n, at))
        at += out[-1].nbytes
    return out


def matches(table: np.ndarray, key: np.ndarray, name: np.ndarray) -> np.ndarray:
    """The column of each (key, name) in a table of (key, name, ...) sorted by name and key; each is there."""
    at = np.searchsorted(table[1], name)
    other = np.flatnonzero(table[0][at] != key)
    while len(other):  # names of different strings that fall together
        at[other] += 1
        other = other[table[0][at[other]] != key[other]]
    return at


def first_of(key: np.ndarray, name: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The place of each different (key, name) with the smallest id."""
    order = np.lexsort((own, name, key))
    k, n = key[order], name[order]
    return order[np.append(True, (k[1:] != k[:-1]) | (n[1:] != n[:-1]))] if len(order) else order


def pick(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Spans of bytes, side by side."""
    offsets = np.concatenate([[0], np.cumsum(size)])
    return data[np.repeat(first - offsets[:-1], size) + np.arange(offsets[-1])]


def cut_out(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> pa.Array:
    """Spans of bytes as a binary array."""
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(pick(data, first, size))])


def raw_of(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column and the offsets of its rows in them."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that a document with a smaller id has too, removed from all documents."""
    return remove_shared(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
