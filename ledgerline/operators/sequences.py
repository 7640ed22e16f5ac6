"""Event sequences of projects: assembly, padding, masks, scaling, coverage."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import SEQUENCE_STEPS

PAD = "named_struct('event_type', -1, 'days', -1, 'amount', cast(-1 as double))"


def events_of(sources: Mapping[int, DataFrame]) -> DataFrame:
    """Dated events of all sources (project_key, date, amount), with the source's number as event type."""
    out = None
    for kind, df in sources.items():
        rows = df.filter(F.col("date").isNotNull()).select("project_key", F.lit(kind).alias("event_type"), "date", "amount")
        out = rows if out is None else out.unionByName(rows)
    return out


def assemble(projects: DataFrame, events: DataFrame, steps: int = SEQUENCE_STEPS) -> DataFrame:
    """The earliest steps of each project by date and event type, days from the first, padded with -1, and a mask.

    Projects without events are kept with padding only."""
    ordered = F.array_sort(F.collect_list(F.struct("date", "event_type", "amount")))
    grouped = events.groupBy("project_key").agg(ordered.alias("_all"))
    rows = projects.select("project_key").distinct().join(grouped, "project_key", "left").withColumn("_all", F.coalesce("_all", F.expr("array()").cast(grouped.schema["_all"].dataType)))
    first = F.col("_all")[0]["date"]
    kept = F.transform(F.slice("_all", 1, steps), lambda e: F.struct(e["event_type"].alias("event_type"), F.datediff(e["date"], first).alias("days"), e["amount"].cast("double").alias("amount")))
    n = F.least(F.size("_all"), F.lit(steps))
    padded = F.concat(kept, F.array_repeat(F.expr(PAD), F.lit(steps) - n))
    mask = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: i < n)
    return rows.select("project_key", F.size("_all").alias("n_events"), padded.alias("steps"), mask.alias("mask"))


def scale_steps(train: DataFrame, df: DataFrame) -> DataFrame:
    """days and amount of real steps to 0..1 by the real steps of train; padding is untouched."""
    real = train.select(F.explode(F.filter(F.arrays_zip("steps", "mask"), lambda x: x["mask"])).alias("x"))
    bounds = real.agg(F.min("x.steps.days").alias("_d0"), F.max("x.steps.days").alias("_d1"), F.min("x.steps.amount").alias("_a0"), F.max("x.steps.amount").alias("_a1"))
    clip = lambda v, lo, hi: F.least(F.greatest((v - lo) / F.when(hi == lo, 1.0).otherwise(hi - lo), F.lit(0.0)), F.lit(1.0))
    joined = df.crossJoin(F.broadcast(bounds))
    days = lambda s: clip(s["days"].cast("double"), F.col("_d0"), F.col("_d1"))
    amount = lambda s: clip(s["amount"], F.col("_a0"), F.col("_a1"))
    scaled = F.zip_with("steps", "mask", lambda s, m: F.struct(s["event_type"].alias("event_type"), F.when(m, days(s)).otherwise(-1.0).alias("days"), F.when(m, amount(s)).otherwise(-1.0).alias("amount")))
    return joined.select("project_key", "n_events", scaled.alias("steps"), "mask")


def coverage(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.count_if(F.col("n_events") == 0).alias("n_empty"), F.round(F.avg(F.least("n_events", F.lit(SEQUENCE_STEPS))), 6).alias("mean_steps"))


def with_labels(df: DataFrame, labels: DataFrame, order: str) -> DataFrame:
    """Label and split of each sequence from the last labelled row of its key; unresolved where there is none."""
    last = labels.groupBy("project_key").agg(F.max_by(F.struct("label", "split"), order).alias("_l"))
    return df.join(last, "project_key", "left").select(*df.columns, F.col("_l.label").alias("label"), F.coalesce("_l.split", F.lit("unresolved")).alias("split"))
