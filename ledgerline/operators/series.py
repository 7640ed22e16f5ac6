"""Statistical series: detection of columns, months of periods, joins of series, point-in-time lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col
from ..schema import MONTHS


def months_of(period: Column | str) -> Column:
    """Months that a period text covers: of its quarter, its month, or all for annual and unknown ones."""
    p = F.lower(F.trim(col(period)))
    quarter = F.regexp_extract(p, r"q(?:uarter)?\s*([1-4])", 1).try_cast("int")
    month = F.lit(None).cast("int")
    for k, name in enumerate(MONTHS, 1):
        month = F.when(p.startswith(name[:3]), k).otherwise(month)
    return F.when(quarter.isNotNull(), F.sequence(quarter * 3 - 2, quarter * 3)).when(month.isNotNull(), F.array(month)).otherwise(F.sequence(F.lit(1), F.lit(12)))


def monthly(df: DataFrame, year: str = "year", period: str = "period") -> DataFrame:
    """A row per month of each period, with its first day."""
    return df.withColumn("month", F.explode(months_of(period))).withColumn("month_start", F.make_date(col(year).cast("int"), F.col("month"), F.lit(1)))


def latest_only(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key, the first by order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def wide(df: DataFrame, names: Sequence[str], keys: Sequence[str] = ("year", "month")) -> DataFrame:
    """A column per series with the mean of its values, for all keys of any series. One pass."""
    return df.groupBy(*keys).pivot("series", list(names)).agg(F.avg("value"))


def regional(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose label matches; all rows if none does."""
    hit = F.coalesce(F.col(column).rlike(pattern), F.lit(False))
    hits = df.agg(F.count_if(hit).alias("_hits"))
    return df.crossJoin(F.broadcast(hits)).filter(hit | (F.col("_hits") == 0)).drop("_hits")


def role_of(columns: Sequence[str], words: Sequence[str]) -> str | None:
    """First column with one of the words in its name."""
    return next((c for c in columns if any(w in c.lower() for w in words)), None)


def as_of(df: DataFrame, series: DataFrame, on: str, at: str = "month_start", value: str = "value", months: int = 12) -> DataFrame:
    """The latest series value at or before each row's date, not older than `months`: an equi-join on the months that
    each vintage can serve, then the newest per row."""
    served = series.select(F.col(at).alias("_at"), F.col(value).alias("indicator"), F.explode(F.sequence(F.lit(0), F.lit(months - 1))).alias("_k"))
    served = served.withColumn("_month", F.add_months(F.date_trunc("month", "_at").cast("date"), F.col("_k")))
    newest = served.groupBy("_month").agg(F.max_by(F.struct("_at", "indicator"), "_at").alias("_v"))
    return df.withColumn("_month", F.date_trunc("month", on).cast("date")).join(newest, "_month", "left").withColumns({"indicator": F.col("_v.indicator"), "vintage": F.col("_v._at")}).drop("_month", "_v")
