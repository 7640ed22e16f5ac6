"""Sharding by Karmarkar-Karp differencing: groups of equal texts stay whole, shards get near equal bytes."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, numbered, save, small_side, text_of

#: Items that one task differences into lumps, about, and how many lumps it makes of them.
BUCKET = 8192
LUMPS = 8


def difference(sizes: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item: the two partial partitions with the largest spread are combined in opposite order until one is left."""
    n = len(sizes)
    if not n:
        return np.zeros(0, np.int64)
    heap, order, children = [], [None] * (2 * n), [None] * (2 * n)
    for i, s in enumerate(sizes):
        heap.append((-int(s), i, (0,) * (shards - 1) + (int(s),)))
    heapq.heapify(heap)
    top = n
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        sums = [p + q for p, q in zip(x, reversed(y), strict=True)]
        rank = sorted(range(shards), key=sums.__getitem__)
        low = sums[rank[0]]
        children[top], order[top] = (a, b), rank
        heapq.heappush(heap, (-(sums[rank[-1]] - low), top, tuple(sums[r] - low for r in rank)))
        top += 1
    out, stack = np.zeros(n, np.int64), [(heap[0][1], list(range(shards)))]
    while stack:  # labels go down: place p of a node is place order[p] of its first child and the mirrored one of its second
        node, label = stack.pop()
        if node < n:
            out[node] = label[-1]
            continue
        below = [0] * shards
        for place, r in enumerate(order[node]):
            below[r] = label[place]
        a, b = children[node]
        stack += [(a, below), (b, below[::-1])]
    return out


def lumped(items: DataFrame, level: int) -> DataFrame:
    """Saved items (key, size) with the lump (long) that each goes to: buckets of about BUCKET items are differenced
    into LUMPS near equal lumps each, every bucket in a task of its own."""
    buckets = max(1, -(-items.count() // BUCKET))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "ascending"), ("key", "ascending")])
        place = difference(table["size"].to_numpy(), LUMPS)
        return table.select(["key", "size"]).append_column("lump", pa.array(table["bucket"].to_numpy() * LUMPS + place, pa.int64()))

    kind = items.schema["key"].dataType.simpleString()
    dealt = items.withColumn("bucket", F.pmod(F.xxhash64(F.lit(level), "key"), F.lit(buckets)))
    return save(dealt.groupBy("bucket").applyInArrow(run, f"key {kind}, size long, lump long"), "lumps")


def shard_by_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, most: int = 16_384, fine: int = 4_096) -> DataFrame:
    """Rows (id, size, text_crc32, shard, slot): all rows of equal text in one shard, bytes per shard near equal.

    Groups of equal texts are differenced. One task can hold only so many, so with more than `most` groups this goes
    in levels: groups are differenced into lumps in buckets side by side, lumps into larger ones, until there are at
    most `most`, and these into the shards. Groups that could not be evened out in lumps go to the last step as they
    are: those of more than 1 / (shards * fine) of all bytes, at most shards * fine of them. So do about `fine` others,
    by hash, which fill what the lumps leave uneven.

    Null text counts as empty (size 1, with empty texts in one group). Repeated rows each get a slot; ties go by id.
    Ids can be null or repeat. An empty table gives an empty result. Extra columns are ignored."""
    t = text_of(text_col)
    rows = save(df.select(F.col(id_col), (F.octet_length(t).cast("long") + 1).alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(t, 256)).alias("_text")), "shard-rows")
    groups = save(rows.groupBy(F.col("_text").alias("key")).agg(F.sum("size").alias("size")), "shard-groups")
    n, total = groups.agg(F.count("*"), F.sum("size")).first()
    least = max(1, (total or 0) // (shards * fine))
    alone = (F.col("size") >= least) | (F.pmod(F.xxhash64(F.lit("alone"), "key"), F.lit(max(1, n // fine))) == 0) if n > most else F.lit(True)
    levels, items = [], groups.filter(~alone)
    while n > most:
        levels.append(lumped(items, len(levels)))
        items = save(levels[-1].groupBy(F.col("lump").alias("key")).agg(F.sum("size").alias("size")), "lump-sizes")
        n = items.count()

    def differenced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if got := [b for b in batches if b.num_rows]:
            table = pa.Table.from_batches(got).sort_by([("size", "ascending"), ("key", "ascending"), ("lump", "ascending")])
            table = table.append_column("shard", pa.array(difference(table["size"].to_numpy(), shards), pa.int32()))
            yield from table.select(["key", "lump", "shard"]).to_batches()

    last = groups.filter(alone).select("key", F.lit(None).cast("long").alias("lump"), "size")
    if levels:
        last = last.union(items.select(F.lit(None).cast("binary"), "key", "size"))
    placed = save(last.repartition(1).mapInArrow(differenced, "key binary, lump long, shard int"), "shard-items")
    own = placed.filter("key is not null").select("key", "shard")
    if levels:
        of_lump = placed.filter("lump is not null").select("lump", "shard")
        for level in reversed(levels):
            below = level.join(of_lump, "lump").select("key", "shard")
            of_lump = below.withColumnRenamed("key", "lump")
        own = own.union(below)
    own = save(own.withColumnRenamed("key", "_text"), "group-shards")
    sharded = save(rows.join(small_side(own), "_text").select(id_col, "size", "text_crc32", "shard"), "sharded")
    discard(rows, groups, placed, own, *levels)
    return numbered(sharded, ["shard"], [id_col, "text_crc32", "size"], "slot").select(id_col, "size", "text_crc32", "shard", "slot")


def op9_karmarkar_karp_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes, equal texts together."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_by_bytes(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
