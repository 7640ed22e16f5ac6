"""Record linkage: exact one-to-one passes, blocked fuzzy pass, canonical names, crosswalk."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Sequence
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..schema import FUZZY_CUTOFF, FUZZY_TOP, YEAR_TOLERANCE
from . import similarity
from .similarity import LEVENSHTEIN, Similarity

def exact_links(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One-to-one links of equal keys (none of them null), in id order: the nth left row with the nth right one."""
    nth = lambda df, name: df.dropna(subset=list(keys)).select(F.col("id").alias(name), *keys, F.row_number().over(Window.partitionBy(*keys).orderBy("id")).alias("_n"))
    return nth(left, "left_id").join(nth(right, "right_id"), [*keys, "_n"]).select("left_id", "right_id", F.lit(100.0).alias("match_score"), F.lit("exact").alias("match_method"))


def exact_links_with_veto(left: DataFrame, right: DataFrame, keys: Sequence[str], veto: str) -> DataFrame:
    """As exact_links, but rows whose known veto values differ don't link: each left row in turn takes the first right
    row that is free and agrees; ids are unique.

    Where all rows of a key have a known value, its values have nothing to do with each other: the nth left row of a
    value takes the nth right one, by windows over key and value, so a large key spreads by value. Where some have none, what a row takes
    depends on all before it. Rows of such a key meet in one cogroup, in which free rows wait in a line for each value, so
    the key costs its rows and not their pairs."""

    def linked(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        known = lambda v: None if pd.isna(v) or not v else v
        b, by_value, taken, out = b.sort_values("id"), defaultdict(deque), set(), []
        every = deque(b["id"])
        for i, v in zip(b["id"], b["veto"], strict=True):
            by_value[known(v)].append(i)
        for i, v in a.sort_values("id")[["id", "veto"]].itertuples(index=False):
            lines = [every] if known(v) is None else [by_value[known(v)], by_value[None]]
            for line in lines:
                while line and line[0] in taken:
                    line.popleft()
            first = min((line[0] for line in lines if line), default=None)
            if first is not None:
                taken.add(first)
                out.append((i, first, 100.0, "exact"))
        return pd.DataFrame(out, columns=["left_id", "right_id", "match_score", "match_method"])

    side = lambda df: df.dropna(subset=list(keys)).select("id", *keys, F.nullif(F.col(veto).cast("string"), F.lit("")).alias("veto"))
    a, b = side(left), side(right)
    unknown = a.union(b).filter("veto is null").select(*(F.col(k).alias(f"_same_{k}") for k in keys)).distinct()
    same = reduce(and_, (F.col(k) == F.col(f"_same_{k}") for k in keys))
    own = ["id", *keys, "veto"]
    apart = [df.join(unknown, same, "left_anti") for df in (a, b)]
    mixed = [df.join(unknown, same, "left_semi").select(*(F.col(c).alias(c) for c in own)).groupBy(*keys) for df in (a, b)]
    met = mixed[0].cogroup(mixed[1]).applyInPandas(linked, "left_id long, right_id long, match_score double, match_method string")
    return exact_links(*apart, [*keys, "veto"]).unionByName(met)


def residual(left: DataFrame, links: DataFrame) -> DataFrame:
    return left.join(links.select(F.col("left_id").alias("id")), "id", "left_anti")


def scored_names(left: DataFrame, right: DataFrame, block: str, cutoff: float, score: Similarity = LEVENSHTEIN) -> DataFrame:
    """(block, left name, right name, score) of distinct sorted names of a block that reach the cutoff.

    Names are scored once, not per row, and only where an index of their q-grams lets two of them meet."""
    names = lambda df, name: df.filter(F.col(block).isNotNull() & F.col("name").isNotNull()).select(block, text.token_sort_key("name").alias(name)).distinct()
    return similarity.pairs(names(left, "_left"), names(right, "_right"), block, cutoff, score)


def top_candidates(left: DataFrame, right: DataFrame, block: str, cutoff: float, top: int = FUZZY_TOP, score: Similarity = LEVENSHTEIN) -> DataFrame:
    """For each left row the first `top` right rows of its block by score and id, from the cutoff on, ranked in _k. Both have
    an id, a name and more columns, which come as left_... and right_....

    Left rows of one name have the same candidates, and of the right rows of one name only the first `top` by id can be
    among them. So names meet names, each left name keeps `top` rows, and these go to its rows: no product of rows is made."""
    names = scored_names(left, right, block, cutoff, score)
    side = lambda df, name: df.select(block, text.token_sort_key("name").alias(f"_{name}"), *(F.col(c).alias(f"{name}_{c}") for c in df.columns if c not in (block, "name")))
    of_name = Window.partitionBy(block, "_right").orderBy("right_id")
    few = side(right, "right").withColumn("_n", F.row_number().over(of_name)).filter(F.col("_n") <= top).drop("_n")
    by_left = Window.partitionBy(block, "_left").orderBy(F.desc("score"), "right_id")
    best = names.join(few, [block, "_right"]).withColumn("_n", F.row_number().over(by_left)).filter(F.col("_n") <= top).drop("_n")
    own = Window.partitionBy("left_id").orderBy(F.desc("score"), "right_id")
    return side(left, "left").join(best, [block, "_left"]).withColumn("_k", F.row_number().over(own)).filter(F.col("_k") <= top)


def fuzzy_links(left: DataFrame, right: DataFrame, block: str, cutoff: float = FUZZY_CUTOFF, top: int = FUZZY_TOP, years: int = YEAR_TOLERANCE, veto: str | None = None, score: Similarity = LEVENSHTEIN) -> DataFrame:
    """For each left row the best right row of its block: the top five by score are taken first, then those outside
    the year tolerance or with another veto value go (an unknown value passes), then the first left links."""
    own = ["id", "name", block, "year", *([veto] if veto else [])]
    pairs = top_candidates(left.select(*own), right.select(*own), block, cutoff, top, score)
    near = F.coalesce(F.abs(F.col("left_year") - F.col("right_year")) <= years, F.lit(True))
    if veto:
        a, b = F.col(f"left_{veto}"), F.col(f"right_{veto}")
        near = near & F.coalesce((a == b) | (a == "") | (b == ""), F.lit(True))
    best = Window.partitionBy("left_id").orderBy("_k")
    found = pairs.filter(near).withColumn("_k", F.row_number().over(best)).filter("_k = 1")
    return found.select("left_id", "right_id", F.round("score", 6).alias("match_score"), F.lit("fuzzy").alias("match_method"), F.col(block).alias("block"), F.col("left_year").alias("year_left"), F.col("right_year").alias("year_right"))


def canonical(df: DataFrame, column: str, names: DataFrame, cutoff: float, scope: str | None = None, score: Similarity = LEVENSHTEIN) -> DataFrame:
    """df with <column>_canonical: the nearest name of a reference list (in the same scope if given) from the cutoff on,
    else the title case of the text. Distinct texts are scored once, with names of a length that allows the cutoff, and
    joined back."""
    keys = [scope] if scope else []
    least = score.ratio(cutoff)
    texts = df.filter(F.col(column).isNotNull()).select(column, *keys).distinct().withColumn("_text", text.place_name(column))
    size = F.length("_text")
    texts = texts.withColumn("_size", F.explode(F.sequence(F.ceil(size * least - 1e-9), F.floor(size / least + 1e-9))))
    known = names.select(F.col("name").alias("_name"), text.place_name("name").alias("_known"), *keys).withColumn("_size", F.length("_known").cast("long"))
    marked = texts.join(known, [*keys, "_size"]).withColumn("_score", score(F.col("_text"), F.col("_known"))).filter(F.col("_score") >= cutoff - 1e-9)
    best = marked.groupBy(column, *keys).agg(F.min_by("_name", F.struct(-F.col("_score"), F.col("_name"))).alias("_best"))
    return df.join(best, [column, *keys], "left").withColumn(f"{column}_canonical", F.coalesce("_best", text.title(F.trim(column)))).drop("_best")


#: What a place without a listed name resolves to.
UNMAPPED = "Unmapped"


def resolved(df: DataFrame, column: str, names: DataFrame, cutoff: float, score: Similarity = LEVENSHTEIN) -> DataFrame:
    """df with <column>_resolved: a listed name for the last comma-separated part of a text, else for the whole of it, else Unmapped.

    A part is only taken for a name of the list, never for its own title case; parts that are blank don't count as the last."""
    # F.trim itself would be given the index of a part as the letters to trim
    parts = F.filter(F.transform(F.split(F.col(column), ","), lambda x: F.trim(x)), lambda x: x != "")
    texts = df.select(column).distinct().filter(F.trim(column) != "")
    asked = texts.select(column, F.posexplode(F.array(F.try_element_at(parts, F.lit(-1)), F.col(column))).alias("_turn", "_part")).filter(F.col("_part").isNotNull())
    listed = names.select("name").distinct()
    found = canonical(asked, "_part", listed, cutoff, score=score).join(listed.select(F.col("name").alias("_part_canonical")), "_part_canonical", "left_semi")
    first = found.groupBy(column).agg(F.min_by("_part_canonical", "_turn").alias("_found"))
    return df.join(first, column, "left").withColumn(f"{column}_resolved", F.coalesce("_found", F.lit(UNMAPPED))).drop("_found")


def crosswalk(hub: DataFrame, liquidations: DataFrame, monitorings: DataFrame) -> DataFrame:
    """A row per hub row with its links; of several links of a row the first by right id."""
    first = lambda links, name: links.groupBy("left_id").agg(F.min_by(F.struct("right_id", "match_score", "match_method"), "right_id").alias("_x")).select(F.col("left_id").alias("id"), F.col("_x.right_id").alias(f"{name}_row_id"), F.col("_x.match_score").alias(f"{name}_score"), F.col("_x.match_method").alias(f"{name}_method"))
    rows = hub.select("id").join(first(liquidations, "liq"), "id", "left").join(first(monitorings, "mon"), "id", "left")
    return rows.withColumn("project_key", F.concat(F.lit("PRJ_"), F.col("id").cast("string"))).withColumnRenamed("id", "ft_row_id")


def linkage_rate(table: DataFrame) -> DataFrame:
    linked = F.col("liq_row_id").isNotNull() | F.col("mon_row_id").isNotNull()
    return table.agg(F.count("*").alias("n"), F.count_if(linked).alias("linked"), F.round(F.avg(linked.cast("double")), 6).alias("rate"))


def first_keys(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Project key of each monitored row: that of its first hub row, else one of its own."""
    first = table.filter("mon_row_id is not null").groupBy(F.col("mon_row_id").alias("id")).agg(F.min_by("project_key", "ft_row_id").alias("_key"))
    return rows.join(first, "id", "left").withColumn("project_key", F.coalesce("_key", F.concat(F.lit("MON_ONLY_"), F.col("id").cast("string")))).drop("_key")


