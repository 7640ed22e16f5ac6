"""Dashboard operators: facets, tiers, KPIs, rankings, report history, indicators, coordinates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import TIER_EDGES, TIER_TOP, TIERS, WEEK_DAYS, WET_MONTHS


def tier(p: Column | str) -> Column:
    """Risk tier of a probability; null if it is unknown."""
    p = F.col(p) if isinstance(p, str) else p
    out = F.lit(TIER_TOP)
    for edge, name in reversed(TIER_EDGES):
        out = F.when(p < edge, name).otherwise(out)
    return F.when(p.isNotNull(), out)


def facets(df: DataFrame, name: str | None = None, lists: Mapping[str, Sequence[str]] | None = None, ranges: Mapping[str, tuple[float | None, float | None]] | None = None, known: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Rows by a name pattern, multi-select lists and numeric ranges; values outside a known vocabulary are ignored."""
    where = F.lit(True)
    if name:
        where = where & F.col("project_name").ilike(f"%{name}%")
    for column, values in (lists or {}).items():
        values = [v for v in values if known is None or column not in known or v in known[column]]
        if values:
            where = where & F.col(column).isin(*values)
    for column, (low, high) in (ranges or {}).items():
        if low is not None:
            where = where & (F.col(column) >= low)
        if high is not None:
            where = where & (F.col(column) <= high)
    return df.filter(where)


def tier_counts(df: DataFrame) -> DataFrame:
    """Rows per tier with zeros for tiers without any; unscored rows don't count."""
    every = df.sparkSession.createDataFrame([(t,) for t in TIERS], "tier string")
    return F.broadcast(every).join(df.groupBy(tier("prob").alias("tier")).agg(F.count("*").alias("n")), "tier", "left").select("tier", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def hot_places(df: DataFrame, k: int = 10) -> DataFrame:
    """The k municipalities with most projects: high or critical ones, and the rest."""
    risky = F.coalesce(tier("prob").isin("High", "Critical"), F.lit(False))
    counted = df.groupBy("municipality").agg(F.count_if(risky).alias("n_risky"), F.count_if(~risky).alias("n_rest"))
    return counted.orderBy((F.col("n_risky") + F.col("n_rest")).desc(), "municipality").limit(k)


def kpis(projects: DataFrame, schedule: DataFrame, week: str | None = None, ongoing: str = "on_going") -> DataFrame:
    """One row: on-going projects, critical ones of them, distinct scheduled ones and their share; over all weeks, or one."""
    rows = schedule if week is None else schedule.filter(F.col("week_of") == F.lit(week).cast("date"))
    planned = rows.agg(F.count_distinct("project_key").alias("scheduled"))
    active = projects.filter(F.col("status") == ongoing).agg(F.count("*").alias("active"), F.count_if(F.coalesce(tier("prob") == TIER_TOP, F.lit(False))).alias("critical"))
    share = F.when(F.col("active") > 0, F.round(100 * F.col("scheduled") / F.col("active"), 0)).otherwise(0.0)
    return active.crossJoin(planned).withColumn("coverage", share)


def paged(df: DataFrame, page: int, size: int = 50) -> DataFrame:
    """A page by risk, unscored last, with the exact number of all rows."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(F.desc_nulls_last("prob"), "project_key").offset((page - 1) * size).limit(size).crossJoin(F.broadcast(total))


def latest_reports(reports: DataFrame) -> DataFrame:
    return reports.groupBy("project_key").agg(F.max_by(F.struct("observed_at", "report_id", "event_type", "value"), F.struct("observed_at", "report_id")).alias("r")).select("project_key", "r.*")


def audit_trail(reports: DataFrame, names: DataFrame, inspector: str | None = None, search: str | None = None, limit: int = 200) -> DataFrame:
    """The newest reports, of one inspector if asked; a name search looks only among these."""
    rows = reports if inspector is None else reports.filter(F.col("inspector") == inspector)
    newest = rows.orderBy(F.desc("observed_at"), "report_id").limit(limit)
    named = newest.join(names, "project_key", "left")
    return named if search is None else named.filter(F.col("project_name").ilike(f"%{search}%"))


def board(schedule: DataFrame) -> DataFrame:
    """Cells of the week board in day order: the projects of an inspector and day."""
    day = F.array_position(F.array(*map(F.lit, WEEK_DAYS)), F.col("day"))
    return schedule.groupBy("inspector", "day", day.alias("day_no")).agg(F.array_join(F.array_sort(F.collect_list("project_key")), ",").alias("projects"), F.count("*").alias("n"))


def indicators(df: DataFrame, today: str) -> DataFrame:
    """Flags of a project's panel as of a day: days since release, wet season, stalled start, verified in the field."""
    age = F.datediff(F.lit(today).cast("date"), F.col("released").cast("date"))
    return df.select(
        "project_key",
        F.array(
            F.struct(F.lit("Days since release").alias("label"), age.cast("string").alias("detail"), F.coalesce(age > 365, F.lit(False)).alias("flagged")),
            F.struct(F.lit("Wet season").alias("label"), F.month("released").cast("string").alias("detail"), F.coalesce(F.month("released").isin(*WET_MONTHS), F.lit(False)).alias("flagged")),
            F.struct(F.lit("Start stalled").alias("label"), F.col("status").alias("detail"), F.coalesce((F.col("status") == "Not Started") & (age > 90), F.lit(False)).alias("flagged")),
            F.struct(F.lit("Field verified").alias("label"), F.col("n_reports").cast("string").alias("detail"), (F.col("n_reports") == 0).alias("flagged")),
        ).alias("panel"),
    )


def string_hash(col: Column | str) -> Column:
    """31-fold string hash in 32 unsigned bits, over code points."""
    codes = F.transform(F.split(col, ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c, F.lit(4294967296)))


def pins(df: DataFrame, centres: DataFrame, spread: float = 0.02) -> DataFrame:
    """Real coordinates, or those of the town with an offset that depends on the key alone."""
    h = string_hash("project_key")
    angle, radius = F.pmod(h, F.lit(360)) * F.lit(3.141592653589793 / 180), spread * F.sqrt(F.pmod(F.floor(h / 360), F.lit(1000)) / 1000)
    placed = df.join(centres, "municipality", "left")
    return placed.withColumn("pin_lat", F.coalesce("lat", F.col("town_lat") + radius * F.sin(angle))).withColumn("pin_lng", F.coalesce("lng", F.col("town_lng") + radius * F.cos(angle)))


def in_box(df: DataFrame, low: tuple[float, float], high: tuple[float, float]) -> DataFrame:
    """Coordinates outside the box are dropped as a pair."""
    inside = F.col("lat").between(low[0], high[0]) & F.col("lng").between(low[1], high[1])
    return df.withColumn("ok", F.coalesce(inside, F.lit(False))).withColumn("lat", F.when(F.col("ok"), F.col("lat"))).withColumn("lng", F.when(F.col("ok"), F.col("lng"))).drop("ok")


def week_monday(col: Column | str) -> Column:
    """Monday of a day's week; a Sunday belongs to the Monday before it."""
    return F.date_trunc("week", col).cast("date")


def visible_to(projects: DataFrame, schedule: DataFrame, inspector: str) -> DataFrame:
    """Only projects on the inspector's own schedule."""
    return projects.join(schedule.filter(F.col("inspector") == inspector).select("project_key"), "project_key", "left_semi")


def latest_first(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
