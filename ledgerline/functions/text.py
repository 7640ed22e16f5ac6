"""Text rules of the ledger as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeezed(c: Column | str) -> Column:
    """Lower case, without outer spaces, runs of white space as one space; null stays null."""
    return F.trim(F.regexp_replace(F.lower(col(c)), r"\s+", " "))


def marks_to_spaces(c: Column | str) -> Column:
    """As squeezed, with dashes, slashes, commas and dots as spaces."""
    return squeezed(F.regexp_replace(col(c), "[-–—/,.]", " "))


def place_name(c: Column | str) -> Column:
    """As marks_to_spaces, without a leading brgy or barangay."""
    return F.trim(F.regexp_replace(marks_to_spaces(c), r"^(brgy|barangay)\s+", ""))


def title(c: Column | str) -> Column:
    """A capital after anything that is not a letter."""
    parts = F.regexp_extract_all(F.lower(col(c)), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.substring(x, 2, 1_000_000))), "")


def token_sort_key(c: Column | str) -> Column:
    """Words in order, joined by a space."""
    return F.array_join(F.array_sort(F.filter(F.split(marks_to_spaces(c), " "), lambda w: w != "")), " ")


def levenshtein_ratio(a: Column | str, b: Column | str) -> Column:
    """100 * (1 - edits / longer length); null if either is null."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(100.0)).otherwise(100.0 * (1 - F.levenshtein(col(a), col(b)) / longer))


def lookup(c: Column | str, table: Mapping[str, str]) -> Column:
    """Value of a text in a fixed table, else null."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.element_at(F.create_map(*pairs), col(c))


def last_part(c: Column | str, sep: str = ",") -> Column:
    return F.trim(F.element_at(F.split(col(c), sep), -1))


def first_part(c: Column | str, sep: str = ",") -> Column:
    return F.trim(F.split(col(c), sep)[0])
