"""Construction of the overrun label: dates, lag calibration, clamp, durations, report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import COMPLETED_WORDS, EXTENSION_WORDS, STANDARD_DAYS
from ..sources.sinks import reread
from .features import quantiles

DAY = 86_400
#: What lag, correction and label are made of.
BASIS = ("start", "direct", "proxy", "status", "remarks", "project_type")


def contains_any(col: Column | str, words: tuple[str, ...]) -> Column:
    """Whether a text has any of the words in it, in any case; false for null."""
    text = F.lower(col)
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(text, F.lit(w))
    return F.coalesce(hit, F.lit(False))


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by order; null keys are equal."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def drop_duplicates(df: DataFrame, order: str = "mon_row_id") -> DataFrame:
    """The amount comes first among the keys, as it tells most rows apart in a sort by its first eight bytes."""
    return first_rows(df, ["amount", "released", "monitored", "name"], [order])


def with_start(df: DataFrame) -> DataFrame:
    """Start: the release, else the first visit; flagged where it is the latter."""
    return df.withColumn("start", F.coalesce("released", "monitored")).withColumn("start_is_proxy", F.expr("released is null and monitored is not null"))


def within_study(df: DataFrame, floor: str) -> DataFrame:
    """Rows that start on or after floor; an unknown start is kept."""
    return df.filter(F.coalesce(F.col("start") >= F.lit(floor).cast("timestamp"), F.lit(True)))


def with_direct(df: DataFrame) -> DataFrame:
    """A completion on or before the start is not credible: null, and flagged."""
    rejected = F.coalesce(F.col("completed") <= F.col("start"), F.lit(False))
    return df.withColumn("direct_rejected", rejected).withColumn("direct", F.when(~rejected, F.col("completed")))


def linked_dates(links: DataFrame, key: str = "order_id") -> DataFrame:
    return links.groupBy(key).agg(F.max("submitted").alias("linked"))


def with_proxy(df: DataFrame, links: DataFrame | None, key: str = "order_id") -> DataFrame:
    """Proxy of completion: the later of the visit and the latest linked date, whichever is known. Without links, df has
    the column linked."""
    joined = df if links is None else df.join(linked_dates(links, key), key, "left")
    return joined.withColumn("proxy", F.greatest("monitored", "linked"))


def lag_median(df: DataFrame) -> DataFrame:
    """One row: median of proxy minus direct in days over rows with both, and their number; 0 and 0 when none.

    Lags are counted by value and by day first, and only those of the middle day or two are put in order."""
    lag = (F.unix_timestamp("proxy") - F.unix_timestamp("direct")) / DAY
    lags = df.filter("direct is not null and proxy is not null").select(lag.alias("lag"), F.lit(0).alias("all"))
    middle = quantiles(lags, "lag", "all", (0.5,), per_unit=1)
    return middle.agg(F.coalesce(F.max("q0"), F.lit(0.0)).alias("lag_days"), F.coalesce(F.max("n"), F.lit(0)).alias("lag_n"))


def with_corrected(df: DataFrame, lag: DataFrame) -> DataFrame:
    """Proxy less the lag. Where only the correction crosses the start, it is pinned to a day after the start."""
    seconds = F.unix_timestamp("proxy") - F.round(F.col("lag_days") * DAY).cast("long")
    moved = F.timestamp_seconds(seconds)
    clamped = F.coalesce((moved <= F.col("start")) & (F.col("proxy") > F.col("start")), F.lit(False))
    out = df.crossJoin(F.broadcast(lag)).withColumn("clamped", clamped)
    return out.withColumn("corrected", F.when(F.col("clamped"), F.timestamp_seconds(F.unix_timestamp("start") + DAY)).otherwise(moved))


def with_label(df: DataFrame) -> DataFrame:
    """Durations, extension flag, overrun label (null if the type or a date is unknown) and overrun in percent."""
    days = F.lit(None).cast("int")
    for kind, n in STANDARD_DAYS.items():
        days = F.when(F.col("project_type") == kind, n).otherwise(days)
    recovered = F.col("direct").isNull() & contains_any("status", COMPLETED_WORDS) & F.coalesce(F.col("corrected") > F.col("start"), F.lit(False))
    out = df.withColumn("recovered", recovered).withColumn("finished", F.coalesce("direct", F.when(F.col("recovered"), F.col("corrected"))))
    actual = F.floor((F.unix_timestamp("finished") - F.unix_timestamp("start")) / DAY)
    out = out.withColumn("standard_days", days).withColumn("actual_days", actual).withColumn("extended", contains_any("remarks", EXTENSION_WORDS))
    valid = F.col("standard_days").isNotNull() & F.col("actual_days").isNotNull()
    over = (F.col("actual_days") > F.col("standard_days")) & ~F.col("extended")
    percent = F.bround((F.col("actual_days") - F.col("standard_days")) / F.col("standard_days") * 100, 1)
    return out.withColumn("overrun", F.when(valid, over.cast("int"))).withColumn("overrun_pct", F.when(valid, percent))


def calibrated(base: DataFrame) -> DataFrame:
    """Rows with a corrected proxy. They are read for the lag and again for the correction, so they are staged first."""
    staged = reread(base, "target-base")
    out = with_corrected(staged, lag_median(staged))
    out.saved_at = staged.saved_at
    return out


def basis(rows: DataFrame, links: DataFrame | None, floor: str) -> DataFrame:
    """Rows of the study with direct dates and proxies. Linked dates hang on the key alone, so they join before duplicates
    go: rows that lie by that key need not move for them."""
    return with_direct(within_study(with_start(drop_duplicates(with_proxy(rows, links))), floor))


def build_target(rows: DataFrame, links: DataFrame | None, floor: str, keep: Sequence[str] | None = None) -> DataFrame:
    """All steps of the label in turn; the lag is a one-row side of the last plan.

    keep: the columns wanted besides BASIS and what is made of it (all, if None); the others are neither moved nor staged.
    Where the staged rows lie is told as saved_at, so that they can go once the result is written."""
    based = basis(rows, links, floor)
    staged = calibrated(based if keep is None else based.select(*dict.fromkeys([*BASIS, *keep])))
    out = with_label(staged)
    out.saved_at = staged.saved_at
    return out


def report(df: DataFrame) -> DataFrame:
    """Counts over a labelled frame by type and cluster."""
    return df.groupBy("project_type", "cluster").agg(
        F.count("*").alias("n_rows"),
        F.count("direct").alias("n_direct"),
        F.count_if("direct_rejected").alias("n_rejected"),
        F.count_if("recovered").alias("n_recovered"),
        F.count_if(F.col("recovered") & F.col("clamped")).alias("n_clamped"),
        F.count_if("extended").alias("n_extended"),
        F.count("overrun").alias("n_labelled"),
        F.coalesce(F.sum("overrun"), F.lit(0)).alias("n_overrun"),
        F.round(F.avg("overrun"), 6).alias("overrun_rate"),
        F.round(F.avg(F.when(F.col("direct").isNotNull(), F.col("overrun"))), 6).alias("rate_direct"),
        F.round(F.avg(F.when(F.col("recovered"), F.col("overrun"))), 6).alias("rate_recovered"),
    )
