"""SentencePiece encoding that keeps source offsets, and decoding."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Known, span_hashes, text_of
from .packing import tokenizer_file

META = "▁"


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a serialized protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            b = raw[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while i < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = varint() if key & 7 == 2 else 4 if key & 7 == 5 else 8
            yield key >> 3, raw[i : i + n]
            i += n


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


class Normaliser:
    """Normalisation by a model's compiled character map, with the source byte of each normalised byte.

    The map is a double-array trie over UTF-8 prefixes with values that point to replacement strings; the longest
    prefix wins, and where none matches one character is kept."""

    def __init__(self, spec: bytes):
        got = dict(_fields(spec))
        blob = got.get(2, b"")
        self.dummy, self.trim, self.escape = bool(got.get(3, 1)), bool(got.get(4, 1)), bool(got.get(5, 1))
        self.units, self.strings = np.zeros(0, np.uint32), b""
        if blob:
            n = struct.unpack_from("<I", blob)[0]
            self.units, self.strings = np.frombuffer(blob[4 : 4 + n], "<u4"), blob[4 + n :]

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes]:
        """(bytes of source, replacement) at a position."""
        found = None
        if len(self.units):
            u = int(self.units[0])
            node = (u >> 10) << ((u & 512) >> 6)
            for k in range(at, len(raw)):
                node ^= raw[k]
                if node >= len(self.units):
                    break
                u = int(self.units[node])
                if u & 0x800000FF != raw[k]:
                    break
                node ^= (u >> 10) << ((u & 512) >> 6)
                if u >> 8 & 1:
                    found = k + 1 - at, int(self.units[node]) & 0x7FFFFFFF
        if found:
            return found[0], self.strings[found[1] : self.strings.index(b"\0", found[1])]
        n = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
        return n, raw[at : at + n]

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """(normalised bytes, source byte where each of them begins, and the end)."""
        raw = text.encode()
        if not raw:
            return b"", np.zeros(1, np.int64)
        space = META.encode() if self.escape else b" "
        if not len(self.units) and not self.trim:
            return self._plain(raw, space)
        at = 0
        if self.trim:
            while at < len(raw):
                n, put = self.longest(raw, at)
                if put != b" ":
                    break
                at += n
        if at == len(raw):
            return b"", np.full(1, at, np.int64)
        out, source = bytearray(), []
        if self.dummy:
            out += space
            source += [at] * len(space)
        last_space = self.trim
        while at < len(raw):
            n, put = self.longest(raw, at)
            if last_space:
                put = put.lstrip(b" ")
            if put:
                new = put.replace(b" ", space)
                out += new
                source += [at] * len(new)
                last_space = put.endswith(b" ")
            at += n
            if not self.trim:
                last_space = False
        if self.trim:
            while out.endswith(space):
                del out[-len(space) :]
                at = source[len(out)]
                del source[len(out) :]
        return bytes(out), np.array([*source, at], np.int64)

    def _plain(self, raw: bytes, space: bytes) -> tuple[bytes, np.ndarray]:
        """With an empty map each character stands for itself and a space for the space symbol."""
        data = np.frombuffer(raw, np.uint8)
        width = np.where(data == 32, len(space), 1)
        source = np.repeat(np.arange(len(data)), width)
        head = space if self.dummy else b""
        return head + raw.replace(b" ", space), np.concatenate([np.zeros(len(head), np.int64), source, [len(data)]])


class Pieces:
    """Encoder and decoder of one model file.

    Text is normalised here; the library's segmenter gets the normalised text through a copy of the model whose own
    normalisation does nothing, so pieces lie on our alignment and project to source bytes."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            raw = f.read()
        spec, rest, sizes, self.by_word = b"", b"", [], True
        for number, value in _fields(raw):
            if number == 3:
                spec = value
            elif isinstance(value, bytes):
                rest += _varint(number << 3 | 2) + _varint(len(value)) + value
            if number == 1:
                piece = dict(_fields(value))
                kind = piece.get(3, 1)
                sizes.append(1 if kind == 6 else 0 if kind == 3 else len(piece.get(1, b"")))
                self.by_word &= META not in piece.get(1, b"").decode().lstrip(META)
        self.sizes = np.array(sizes, np.int64)
        self.normalise = Normaliser(spec)
        none = _varint(1 << 3 | 2) + _varint(8) + b"identity" + b"".join(_varint(k << 3) + b"\0" for k in (3, 4, 5))
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=rest + _varint(3 << 3 | 2) + _varint(len(none)) + none)
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.known = Known(lambda words: self.segmenter.encode(words, num_threads=1))

    def segments(self, norm: list[bytes]) -> list[np.ndarray]:
        """Ids of normalised texts. If no piece goes on beyond a word, each different word is segmented once."""
        if not self.by_word:
            return [np.array(ids, np.int64) for ids in self.segmenter.encode([n.decode() for n in norm], num_threads=1)]
        data = np.frombuffer(b"".join(norm), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(n) for n in norm])])
        head = np.zeros(len(data) + 3, bool)
        head[: max(0, len(data) - 2)] = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
        begins = np.zeros(len(data), bool)
        begins[:] = head[: len(data)]
        begins[3:] &= ~head[: max(0, len(data) - 3)]
        at = offsets[:-1][np.diff(offsets) > 0]
        begins[at] = True
        first = np.flatnonzero(begins)
        end = np.append(first[1:], len(data))
        if not len(first):
            return [np.zeros(0, np.int64) for _ in norm]
        ids, upto = self.known(data, span_hashes(data, first, end), first, end)
        edge = upto[np.searchsorted(first, offsets)]
        return [ids[a:b].astype(np.int64) for a, b in zip(edge[:-1], edge[1:], strict=True)]

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids with begin and end, first source byte of each, end byte) of each text."""
        norm = [self.normalise(t) for t in texts]
        for (raw, source), ids in zip(norm, self.segments([n for n, _ in norm]), strict=True):
            size = self.sizes[ids]
            if size.sum() != len(raw):  # an unknown piece stands for as many bytes as it covers
                got = self.segmenter.encode(raw.decode(), out_type="immutable_proto").pieces
                size = np.array([len(p.surface.encode()) for p in got], np.int64)
            ends = np.concatenate([[0], np.cumsum(size)])
            if ends[-1] != len(raw):
                raise ValueError("pieces do not cover the normalised text")
            edge = source[ends]
            after = np.concatenate([edge[1:], edge[-1:]]) if len(ids) else edge[:0]
            begin = np.concatenate([edge[:1], edge[:-1], edge[-1:]])
            yield np.concatenate([[self.model.bos_id()], ids, [self.model.eos_id()]]), begin, np.concatenate([edge[:1], after[: len(ids)], edge[-1:]])

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.model.decode(ids, num_threads=1)


@lru_cache(maxsize=1)
def coder(path: str) -> Pieces:
    """One encoder, with the words that it knows, for all tasks that a Python worker runs."""
    return Pieces(path)


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", with_pieces: bool = True) -> DataFrame:
    """One row per row of df: id, n_tokens, ids_sha256, decoded_sha256, covered_bytes; with_pieces adds ids, begins, ends.

    begins and ends are byte positions in the UTF-8 source text: piece i came from bytes begins[i] to ends[i]. Where
    one source character became several pieces, they share its first byte. covered_bytes is the end of the last piece.
    Null text counts as empty (begin and end ids only). Repeated rows and any order of rows give the same per row; an
    empty table gives an empty result; extra columns are ignored. Texts are handled in groups of about 1 MB."""
    id_type = df.schema[id_col].dataType.simpleString()
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.list_(pa.int32())] * (3 * with_pieces)]
    names = ["n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes", *["ids", "begins", "ends"][: 3 * with_pieces]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(model)
        for batch in batches:
            sizes = np.cumsum(pa.compute.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + (1 << 20), "right")))
                got = list(own.encode(batch.column(1).slice(i, j - i).to_pylist()))
                back = own.decode([ids.tolist() for ids, _, _ in got])
                out = [
                    [len(ids) for ids, _, _ in got],
                    [hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest() for ids, _, _ in got],
                    [hashlib.sha256(t.encode()).hexdigest() for t in back],
                    [int(ends[-1]) for _, _, ends in got],
                    *([[x[k].astype(np.int32) for x in got] for k in range(3)] if with_pieces else []),
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names=[id_col, *names])
                i = j

    spec = f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string, covered_bytes long" + ", ids array<int>, begins array<int>, ends array<int>" * with_pieces
    return df.select(F.col(id_col), text_of(text_col).alias("_text")).mapInArrow(run, spec)


def op4_sentencepiece_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents, and the texts that they decode to."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), str(tokenizer_file("piece_bpe_32k.model")), with_pieces=False)
