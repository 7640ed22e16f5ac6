"""Session settings of the engine."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(name: str = "ledgerline", **more: str) -> SparkSession:
    """A session with UTC time and adaptive execution; partitions are left to the cluster's own settings."""
    return SparkSession.builder.appName(name).config(map=SETTINGS | more).getOrCreate()
