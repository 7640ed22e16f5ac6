"""WARC archives in Zstandard with a dictionary of their own, written and read back by Spark."""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, scratch, small_side, text_of

#: Magic number of the leading skippable frame that holds the dictionary.
DICTIONARY_FRAME = 0x184D2A5D
#: An empty skippable frame: Spark's text writer puts it after each row, and readers of Zstandard pass over it.
BETWEEN = "P*M\x18\0\0\0\0"
#: A dictionary is built from so many bytes of an archive's first records at most.
SAMPLE_BYTES = 2_000_000
DICTIONARY_BYTES = 32_768


def record(target: str, kind: str, digest: str, payload: bytes, refers_to: object, page_id: object) -> bytes:
    """One WARC/1.1 record; a revisit has no payload of its own, and a page without an id none in its header."""
    named = lambda x: quote(str(x), safe=" :")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{target if page_id is None else named(page_id)}')}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Target-URI: " + target.replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {named(page_id)}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{named(refers_to)}')}>", f"WARC-Refers-To-Page-ID: {named(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little to train on, the records' own first bytes."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def frames(content: bytes) -> Iterator[tuple[int, bytes]]:
    """(magic, body) of the skippable frames and (0, frame) of the others, in turn."""
    import zstandard

    at = 0
    while at < len(content):
        magic = struct.unpack_from("<I", content, at)[0]
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            n = struct.unpack_from("<I", content, at + 4)[0]
            yield magic, content[at + 8 : at + 8 + n]
            at += 8 + n
        else:
            n = frame_size(content, at, zstandard.get_frame_parameters(content[at : at + 18]))
            yield 0, content[at : at + n]
            at += n


def frame_size(content: bytes, at: int, head) -> int:
    """Bytes of the frame at a position, from its header and block headers."""
    descriptor = content[at + 4]
    single = descriptor >> 5 & 1
    n = 5 + (not single) + (0, 1, 2, 4)[descriptor & 3] + ((1 if single else 0), 2, 4, 8)[descriptor >> 6]
    while True:
        block = int.from_bytes(content[at + n : at + n + 3], "little")
        n += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            return n + 4 * head.has_checksum


def decide(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int) -> DataFrame:
    """Rows to archive: id, url, payload, digest, first (page that the record revisits, else null)."""
    html = F.encode(text_of(html_col), "UTF-8")
    rows = pages.select(F.col(id_col).alias("_id"), text_of(url_col).alias("_url"), html.alias("_html"), F.sha2(html, 256).alias("_digest"))
    hashes = rows.filter(F.octet_length("_html") >= least).groupBy("_digest").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    copies = save(hashes.filter("_n > 1").select("_digest", "_first"), "copied-payloads")
    return rows.join(small_side(copies), "_digest", "left").withColumn("_first", F.when(F.col("_first") != F.col("_id"), F.col("_first")))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100) -> None:
    """Write pages as archives under path, one for each task.

    Of records with equal payloads of at least `least` bytes that with the smallest id is a response and the others
    revisit it; smaller payloads are all responses. Rows that repeat an id and payload are all written alike; rows
    without an id are responses, and none revisits them. A null payload or address counts as empty. An archive is a skippable frame with its dictionary and then a Zstandard frame
    for each record; between rows stands an empty skippable frame. Only the first SAMPLE_BYTES of an archive are held
    in memory. A task's part of the table must stay below 2 GB compressed, as an archive is read as one row. An empty table gives no archive; extra columns are ignored."""

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        def made(batch: pa.RecordBatch) -> Iterator[bytes]:
            for page_id, url, html, digest, first in zip(*(batch.column(c) for c in ("_id", "_url", "_html", "_digest", "_first")), strict=True):
                first = first.as_py()
                yield record(url.as_py(), "response" if first is None else "revisit", digest.as_py(), html.as_py(), first, page_id.as_py())

        def out(parts: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.binary())], names=["value"])

        records = (r for batch in batches for r in made(batch))
        held, size = [], 0
        for r in records:
            held.append(r)
            size += len(r)
            if size >= SAMPLE_BYTES:
                break
        if not held:
            return
        raw = dictionary(held)
        writer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=True)
        parts, size = [struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw], 0
        for source in (held, records):
            for r in source:
                parts.append(writer.compress(r))
                size += len(parts[-1])
                if size > 1_000_000:
                    yield out(parts)
                    parts, size = [], 0
        yield out(parts)

    rows = decide(pages, id_col, url_col, html_col, least).select("_id", "_url", "_html", "_digest", "_first")
    rows.mapInArrow(archive, "value binary").select(F.col("value").cast("string")).write.option("lineSep", BETWEEN).text(path)


def read(spark: SparkSession, path: str, id_type: str = "bigint", with_payload: bool = True) -> DataFrame:
    """Records of the archives under path: id, url, record_type, payload_bytes, payload_digest, refers_to, and payload.

    A response's digest and length are those of the payload as it was read, and a digest that differs from the header
    is an error. A revisit has them from its headers, and no payload."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        def rows(content: bytes) -> Iterator[tuple]:
            reader = None
            for magic, body in frames(content):
                if magic == DICTIONARY_FRAME:
                    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
                elif not magic:
                    head, _, block = reader.decompress(body).partition(b"\r\n\r\n")
                    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
                    http, _, rest = block[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
                    page, first = (None if x is None else unquote(x) for x in (fields.get("WARC-Page-ID"), fields.get("WARC-Refers-To-Page-ID")))
                    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    if kind == "response" and hashlib.sha256(rest).hexdigest() != digest:
                        raise ValueError(f"payload of page {page} is damaged")
                    n = len(rest) if kind == "response" else int(http.rpartition(b": ")[2])
                    yield (page, fields["WARC-Target-URI"], kind, n, digest, first, *[rest if kind == "response" else None] * with_payload)

        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), *[pa.binary()] * with_payload]
        for batch in batches:
            for content in batch.column(0):
                held: list[tuple] = []
                for r in rows(content.as_py()):
                    held.append(r)
                    if len(held) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", *["payload"] * with_payload]
    files = spark.read.format("binaryFile").load(path).select("content")
    got = files.mapInArrow(records, "page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string" + ", payload binary" * with_payload)
    return got.withColumn("page_id", F.col("page_id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))


def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back from them."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = scratch(spark, "warc")
    write(pages, path)
    return read(spark, path, pages.schema["page_id"].dataType.simpleString(), with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_WARC = """
WITH d AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages
), f AS (
  SELECT page_id, n, digest, min(page_id) OVER (PARTITION BY digest) AS first_id FROM d
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND first_id <> page_id THEN first_id END AS refers_to
FROM f
"""
