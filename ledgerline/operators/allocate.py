"""Priority projects and weekly visit assignment under capacity limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from .features import UNCLUSTERED
from .target import contains_any


def priority_projects(df: DataFrame, least: int = S.PRIORITY_LEAST, size: int = S.PRIORITY_FALLBACK, pool: int = 150) -> DataFrame:
    """Open high or critical projects of a known cluster (not Unclustered); if fewer than `least`, the top `size` open ones by
    probability, tagged as relative. One plan: the number is a one-row side."""
    open_rows = df.filter(~contains_any("status", S.COMPLETED_WORDS + S.REFUND_WORDS) & F.col("prob").isNotNull() & (F.col("cluster") != UNCLUSTERED))
    strict = F.col("tier").isin("High", "Critical")
    count = open_rows.agg(F.count_if(strict).alias("_strict"))
    ranked = open_rows.orderBy(F.desc("prob"), "project_key").limit(size).select("project_key", F.lit(True).alias("_top"))
    joined = open_rows.join(F.broadcast(ranked), "project_key", "left").crossJoin(F.broadcast(count))
    enough = F.col("_strict") >= least
    weight = F.when(enough & (F.col("tier") == "Critical"), S.TIER_REWARD["Critical"]).otherwise(1.0)
    picked = joined.filter((enough & strict) | (~enough & F.col("_top"))).withColumn("relative", ~enough).withColumn("risk_weight", weight)
    return picked.drop("_top", "_strict").orderBy(F.desc("prob"), "project_key").limit(pool)


def assign_visits(df: DataFrame, inspectors: list[str]) -> DataFrame:
    """Visits (inspector, day) of a bounded pool: projects of a cluster in weight order form blocks of three, blocks go
    by weight to days of inspectors, four days each, a cluster's blocks side by side. Feasible, not proven best. A
    pool is at most a few hundred rows by priority_projects. An empty pool is an error."""
    if df.isEmpty():
        raise ValueError("no project to assign")
    nth = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("risk_weight"), F.desc("prob"), "project_key")) - 1
    blocked = df.withColumn("block", F.floor(nth / S.VISITS_PER_DAY))
    blocks = blocked.groupBy("cluster", "block").agg(F.sum("risk_weight").alias("w"))
    slots = len(inspectors) * S.DAYS_PER_INSPECTOR
    taken = blocks.orderBy(F.desc("w"), "cluster", "block").limit(slots)
    slot = F.row_number().over(Window.orderBy("cluster", "block")) - 1
    placed = taken.withColumn("slot", slot).withColumn("inspector", F.element_at(F.array(*map(F.lit, inspectors)), (F.floor(F.col("slot") / S.DAYS_PER_INSPECTOR) + 1).cast("int"))).withColumn("day", F.element_at(F.array(*map(F.lit, S.WEEK_DAYS)), (F.col("slot") % S.DAYS_PER_INSPECTOR + 1).cast("int")))
    return blocked.join(F.broadcast(placed.drop("w", "slot")), ["cluster", "block"]).drop("block")


def violations(schedule: DataFrame) -> DataFrame:
    """Rows (rule, subject) for each broken limit; empty for a feasible schedule."""
    rule = lambda keys, name, test: schedule.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("cluster").alias("c")).filter(test).select(F.lit(name).alias("rule"), F.concat_ws("/", *keys).alias("subject"))
    return (
        rule(["project_key"], "once", "n > 1")
        .unionByName(rule(["inspector", "day"], "daily", f"n > {S.VISITS_PER_DAY}"))
        .unionByName(rule(["inspector"], "weekly", f"n > {S.VISITS_PER_DAY * S.DAYS_PER_INSPECTOR}"))
        .unionByName(rule(["inspector", "day"], "one cluster", "c > 1"))
    )


def objective(schedule: DataFrame) -> DataFrame:
    return schedule.agg((F.sum("risk_weight") - S.CLUSTER_PENALTY * F.count_distinct("inspector", "cluster")).alias("objective"))


def schedule_summary(schedule: DataFrame, pool: DataFrame) -> DataFrame:
    total = pool.agg(F.count("*").alias("pool"))
    return schedule.agg(F.count("*").alias("visits"), F.count_distinct("project_key").alias("projects"), F.count_if(F.col("tier") == "Critical").alias("critical"), F.count_distinct("cluster").alias("clusters")).crossJoin(F.broadcast(total))


def loads(schedule: DataFrame) -> DataFrame:
    return schedule.groupBy("inspector", "day").agg(F.count("*").alias("n"), F.count_distinct("cluster").alias("clusters"))


def checked_edits(edits: DataFrame, schedule: DataFrame) -> DataFrame:
    """Edits with a verdict: a working day, and not twice the same project, day and week, in the edits or before."""
    key = ["project_key", "day", "week_of"]
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("edit_id"))
    known = edits.withColumn("_n", nth).join(schedule.select(*key).distinct().withColumn("_there", F.lit(True)), key, "left")
    verdict = F.when(~F.col("day").isin(*S.WEEK_DAYS), "bad day").when(F.col("_there") | (F.col("_n") > 1), "duplicate").otherwise("accepted")
    return known.withColumn("verdict", verdict).drop("_n", "_there")
