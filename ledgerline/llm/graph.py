"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every node of links (a, b); component is the smallest id that can be reached.

    Alternating stars: each node hands its larger neighbours to the smallest node it knows (large star), then its
    smaller ones (small star), until nothing changes. Links stay thin rows spread by key; each round is a written
    table. Self-links and repeated links do no harm; no links give an empty table."""
    now = save(links.filter("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "links")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(now.select("hi", "lo"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(lowest, "hi").filter("lo <> m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
        now = save(small.union(lowest.select("m", "hi")).distinct(), "links")
    return now.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(now.select("lo", "lo").distinct())
