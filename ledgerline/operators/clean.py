"""Cleaning: dates, money, vocabularies, project types, statuses, locations, reports on failures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text
from .target import contains_any


#: Further readings of a cell, tried last.
TIMED_FORMATS = ("M/d/yyyy H:mm[:ss]", "M/d/yyyy h:mm[:ss] a", "d MMM yyyy", "d MMMM yyyy", "yyyy/M/d")


def to_date(c: Column | str, window: tuple[str, str] = S.DATE_WINDOW) -> Column:
    """Date of a messy cell: a whole serial number, else an ISO date with or without a time, else one of the known
    formats, else the known day orders with a time; null outside the window."""
    c = F.trim(text.col(c))
    number = c.try_cast("double")
    low, high = S.SERIAL_RANGE
    serial = F.when((number == F.floor(number)) & number.between(low, high), F.date_add(F.lit(S.SERIAL_ORIGIN).cast("date"), number.cast("int")))
    parsed = F.coalesce(*(F.try_to_timestamp(c, F.lit(f)).cast("date") for f in (*S.DATE_FORMATS, S.DAY_FIRST_FORMAT, *TIMED_FORMATS)))
    parsed = F.coalesce(c.try_cast("timestamp_ntz").cast("date"), parsed)
    day = F.when(F.upper(c).isin(*S.MISSING_WORDS), None).when(number.isNotNull(), serial).otherwise(parsed)
    return F.when(day.between(F.lit(window[0]).cast("date"), F.lit(window[1]).cast("date")), day)


def to_amount(c: Column | str) -> Column:
    """Number of a money cell: digits, dots and minus signs of it, or null."""
    return F.regexp_replace(text.col(c), "[^0-9.\\-]", "").try_cast("double")


def failures(df: DataFrame, pairs: Mapping[str, str]) -> DataFrame:
    """For each raw column and its coerced one: cells with text, cells that failed, and the rate. One pass."""
    counts = [x for raw, out in pairs.items() for x in (F.count(raw).alias(f"{raw}_n"), F.count_if(F.col(raw).isNotNull() & F.col(out).isNull()).alias(f"{raw}_bad"))]
    parts = ", ".join(f"'{raw}', `{raw}_n`, `{raw}_bad`" for raw in pairs)
    rows = df.agg(*counts).selectExpr(f"stack({len(pairs)}, {parts}) as (column_name, n, failed)")
    return rows.withColumn("rate", F.when(F.col("n") > 0, F.round(F.col("failed") / F.col("n"), 6)).otherwise(0.0))


def to_vocabulary(c: Column | str, table: Mapping[str, str]) -> Column:
    """Term of a lookup table by its squeezed text, else the text in title case."""
    return F.coalesce(text.lookup(text.squeezed(c), table), text.title(F.trim(text.col(c))))


def unmapped(df: DataFrame, column: str, table: Mapping[str, str]) -> DataFrame:
    """Distinct texts that the table has no term for."""
    return df.filter(F.col(column).isNotNull() & text.lookup(text.squeezed(column), table).isNull()).select(text.squeezed(column).alias(column)).distinct()


def project_type(c: Column | str, yes: Sequence[str] = S.INFRASTRUCTURE_WORDS, no: Sequence[str] = S.NON_INFRASTRUCTURE_WORDS) -> Column:
    """Type by keywords, only if just one of the two lists is hit."""
    words = text.marks_to_spaces(c)
    a, b = contains_any(words, tuple(yes)), contains_any(words, tuple(no))
    return F.when(a & ~b, "Infrastructure").when(b & ~a, "Non-Infrastructure").otherwise("Unclassified")


def status_in_order(c: Column | str) -> Column:
    """Published status of a free text; the order of the rules decides, and all else is on-going."""
    rules = (("completed", S.COMPLETED_WORDS), ("refunded", S.REFUND_WORDS), ("not_yet_implemented", S.NOT_IMPLEMENTED_WORDS), ("for_bidding", S.BIDDING_WORDS))
    out = F.lit("on_going")
    for name, words in reversed(rules):
        out = F.when(contains_any(text.col(c), words), name).otherwise(out)
    return out


def status_exact(c: Column | str, table: Mapping[str, str]) -> Column:
    """Status of an upload: by the table, refunds by part of the text, else on-going."""
    t = text.squeezed(c)
    return F.coalesce(text.lookup(t, table), F.when(F.contains(t, F.lit("refund")), "Refunded"), F.lit("On-going"))


def without_nan(df: DataFrame) -> DataFrame:
    """NaN as null in double and float columns and in arrays of them."""
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            df = df.withColumn(name, F.when(~F.isnan(name), F.col(name)))
        elif kind in ("array<double>", "array<float>"):
            df = df.withColumn(name, F.transform(name, lambda x: F.when(~F.isnan(x), x)))
    return df


def year_deviates(date: Column | str, year: Column | str, by: int = 6) -> Column:
    """A flag for dates far from the year of their batch; rows are never dropped for it."""
    return F.coalesce(F.abs(F.year(date) - text.col(year)) > by, F.lit(False))


def shares(df: DataFrame, column: str) -> DataFrame:
    """Percent of rows for each value."""
    counted = df.groupBy(column).agg(F.count("*").alias("n"))
    return counted.crossJoin(F.broadcast(df.agg(F.count("*").alias("_all")))).select(column, "n", F.round(100 * F.col("n") / F.col("_all"), 4).alias("share"))


def first_set(columns: Mapping[str, str], default: str = "Unclassified") -> Column:
    """Name of the first indicator column that is set."""
    out = F.lit(default)
    for column, name in reversed(columns.items()):
        out = F.when(F.col(column) > 0, name).otherwise(out)
    return out


def check_rules(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """Number of rows that break each rule (SQL conditions that must hold where they aren't null). One pass."""
    counts = df.agg(*(F.count_if(F.coalesce(~F.expr(f"({sql})"), F.lit(False))).alias(name) for name, sql in rules.items()))
    return counts.selectExpr(f"stack({len(rules)}, " + ", ".join(f"'{n}', `{n}`" for n in rules) + ") as (rule, broken)")


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(df: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose key is not null and not in the parent."""
    return df.filter(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")
