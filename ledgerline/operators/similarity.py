"""Similarity of names: scores as native expressions, and an index that finds the pairs that can reach a cut-off.

The index goes by positional q-grams. A name within the cut-off of another keeps all but a few of its q-grams at nearly
the same place, so of both names' q-grams, rarest first, the first few hold a common one. Only these go into a join by
(block, q-gram, length of the right name), which also spreads a large block; then the pairs that share enough letters
are scored. Every pair that reaches the cut-off is found, whatever the cut-off is."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

#: Bits of a row in a 64-bit number, so that a sum of two stays below its sign.
LIMB = 62
#: Lengths of grams; the longest that a name's length and the cut-off allow is used.
GRAMS = (1, 2, 3)
TINY = 1e-9


@dataclass(frozen=True)
class Similarity:
    """A score of 0 to 100 of two names, and what follows for their lengths and letters if it reaches a cut-off.

    prepare: what is made of a left name once; score: (left, right, prepared) -> score; ratio: least ratio of the shorter length to the
    longer; shared: least number of letters in common, in order, of names of two lengths; edits: most edits between them."""

    prepare: Callable[[Column], Column]
    score: Callable[[Column, Column, Column], Column]
    ratio: Callable[[float], float]
    shared: Callable[[Column, Column, float], Column]
    edits: Callable[[Column, Column, float], Column]

    def __call__(self, left: Column, right: Column) -> Column:
        return self.score(left, right, self.prepare(left))


def letters(c: Column) -> Column:
    """Characters of a text, one by one."""
    return F.filter(F.split(c, ""), lambda x: x != "")


def letter_rows(c: Column) -> Column:
    """For each different letter of a text the places where it stands, as bits in rows of LIMB."""
    chars = letters(c)
    limbs = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(c) / LIMB).cast("int") - 1, F.lit(0)))
    row = lambda ch, k: F.aggregate(
        F.slice(chars, k * LIMB + 1, LIMB),
        F.struct(F.lit(0).cast("long").alias("row"), F.lit(1).cast("long").alias("bit")),
        lambda s, x: F.struct((s["row"] + F.when(x == ch, s["bit"]).otherwise(0)).alias("row"), F.when(s["bit"] < 2 ** (LIMB - 1), s["bit"] * 2).otherwise(s["bit"]).alias("bit")),
        lambda s: s["row"],
    )
    return F.map_from_entries(F.transform(F.array_distinct(chars), lambda ch: F.struct(ch.alias("key"), F.transform(limbs, lambda k: row(ch, k)).alias("value"))))


def common_letters(left: Column, right: Column, rows: Column) -> Column:
    """Length of the longest common subsequence, by bit rows: a bit for each letter of left, cleared as it is matched.

    The sum of a row and its hits carries from one number to the next."""
    full = 2**LIMB - 1
    limbs = F.greatest(F.ceil(F.length(left) / LIMB).cast("int"), F.lit(1))
    start = F.array_repeat(F.lit(full).cast("long"), limbs)

    def step(state: Column, ch: Column) -> Column:
        hits = F.element_at(rows, ch)
        done = F.aggregate(
            F.zip_with(state, hits, lambda v, h: F.struct(v.alias("v"), v.bitwiseAND(h).alias("u"))),
            F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("long").alias("carry")),
            lambda s, x: F.struct(F.concat(s["out"], F.array((x["v"] + x["u"] + s["carry"]).bitwiseAND(full).bitwiseOR(x["v"] - x["u"]))).alias("out"), F.shiftright(x["v"] + x["u"] + s["carry"], LIMB).alias("carry")),
            lambda s: s["out"],
        )
        return F.when(hits.isNull(), state).otherwise(done)

    left_open = F.aggregate(letters(right), start, step)
    return F.aggregate(left_open, F.lit(0), lambda n, v: n + F.bit_count(v)) * -1 + limbs * LIMB


def _indel(left: Column, right: Column, rows: Column) -> Column:
    total = F.length(left) + F.length(right)
    return F.when(total == 0, F.lit(100.0)).otherwise(200.0 * common_letters(left, right, rows) / total)


def _longer(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


#: 100 * (1 - edits / longer length).
LEVENSHTEIN = Similarity(
    prepare=lambda c: F.lit(None).cast("boolean"),
    score=lambda a, b, _: text.levenshtein_ratio(a, b),
    ratio=lambda cutoff: cutoff / 100,
    shared=lambda a, b, cutoff: F.ceil(_longer(a, b) * (cutoff / 100) - TINY),
    edits=lambda a, b, cutoff: F.floor(_longer(a, b) * (1 - cutoff / 100) + TINY),
)
#: 200 * longest common subsequence / total length, without a Python worker.
INDEL = Similarity(
    prepare=letter_rows,
    score=_indel,
    ratio=lambda cutoff: cutoff / (200 - cutoff),
    shared=lambda a, b, cutoff: F.ceil((a + b) * (cutoff / 200) - TINY),
    edits=lambda a, b, cutoff: F.floor((a + b) * (1 - cutoff / 100) + TINY),
)


def _lengths(size: Column, least: float) -> tuple[Column, Column]:
    """Shortest and longest length of a partner."""
    return F.ceil(size * least - TINY), F.floor(size / least + TINY)


def _spare(size: Column, q: int, kind: Similarity, cutoff: float) -> Column:
    """How many of a name's q-grams can be without a counterpart in a partner, at most. An edit spoils q of them; the
    letters of a name that are not shared are spoilt themselves."""
    low, high = _lengths(size, kind.ratio(cutoff))
    return size - kind.shared(size, low, cutoff) if q == 1 and kind is INDEL else q * kind.edits(size, high, cutoff)


def _grams(name: str, q: int) -> Column:
    """(gram, place) of a name."""
    n = F.length(name) - q + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.substr(F.col(name), i, F.lit(q)).alias("gram"), i.alias("place")))).otherwise(F.array().cast("array<struct<gram:string,place:int>>"))


def _bag(name: str) -> Column:
    """The letters of a name, each with how often it came before."""
    chars = F.array_sort(letters(F.col(name)))
    return F.transform(chars, lambda c, i: F.concat(c, (i + 1 - F.array_position(chars, c)).cast("string")))


def candidates(left: DataFrame, right: DataFrame, block: str, cutoff: float, kind: Similarity = LEVENSHTEIN) -> DataFrame:
    """Distinct (block, _left, _right, _made) of distinct (block, _left) and (block, _right) whose letters allow the cut-off.

    The right names are indexed by the grams of all lengths; a left name looks its own up by the longest grams of which
    it must keep one. From 0 to 50, where a name may share no letter with a partner, names also meet by their lengths."""
    least = max(kind.ratio(cutoff), TINY)
    size = lambda c: F.length(c).cast("long")
    a = left.select(block, "_left", size("_left").alias("_n"), kind.prepare(F.col("_left")).alias("_made"), _bag("_left").alias("_bag"))
    b = right.select(block, "_right", size("_right").alias("_m"), _bag("_right").alias("_bag2"))
    alone = F.lit(True) if kind is LEVENSHTEIN and cutoff <= 50 or cutoff <= 0 else None

    every = None
    for q in GRAMS:
        part = b.select(block, "_right", "_m", F.lit(q).alias("_q"), _spare(F.col("_m"), q, kind, cutoff).alias("_spare"), F.explode(_grams("_right", q)).alias("g"))
        every = part if every is None else every.unionByName(part)
    every = every.select(block, "_right", "_m", "_q", "_spare", "g.gram", "g.place")
    often = every.groupBy("gram").agg(F.count("*").alias("_often"))
    rank = F.row_number().over(Window.partitionBy(block, "_right", "_q").orderBy("_often", "gram", "place"))
    index = every.join(often, "gram").withColumn("_r", rank).filter(F.col("_r") <= F.col("_spare") + 1).select(block, "gram", "_right", "_m", F.col("place").alias("_place2"))

    choice, spare = F.lit(1), _spare(F.col("_n"), 1, kind, cutoff)
    for q in GRAMS[1:]:
        fits = _spare(F.col("_n"), q, kind, cutoff) < F.col("_n") - q + 1
        choice, spare = F.when(fits, q).otherwise(choice), F.when(fits, _spare(F.col("_n"), q, kind, cutoff)).otherwise(spare)
    own = F.when(choice == 3, _grams("_left", 3)).when(choice == 2, _grams("_left", 2)).otherwise(_grams("_left", 1))
    looked = a.select(block, "_left", "_n", spare.alias("_spare"), F.explode(own).alias("g")).select(block, "_left", "_n", "_spare", "g.gram", "g.place")
    looked = looked.join(often, "gram", "left")
    of_name = Window.partitionBy(block, "_left")
    lost = F.count_if(F.col("_often").isNull()).over(of_name)  # grams that no right name has are without a counterpart
    rank = F.row_number().over(of_name.orderBy(F.col("_often").asc_nulls_last(), "gram", "place"))
    looked = looked.withColumns({"_lost": lost, "_r": rank}).filter(F.col("_often").isNotNull() & (F.col("_r") <= F.col("_spare") - F.col("_lost") + 1))
    low, high = _lengths(F.col("_n"), least)
    looked = looked.select(block, "_left", "_n", "gram", "place", F.explode(F.sequence(low, high)).alias("_m"))
    near = F.abs(F.col("place") - F.col("_place2")) <= kind.edits(F.col("_n"), F.col("_m"), cutoff)
    met = looked.join(index, [block, "gram", "_m"]).filter(near).select(block, "_left", "_right")
    bare = a.filter("_n = 0").select(block, "_left").join(b.filter("_m = 0").select(block, "_right"), block)
    met = met.union(bare)
    if alone is not None:
        within = (F.col("_m") >= low) & (F.col("_m") <= high) if kind.ratio(cutoff) > 0 else F.lit(True)
        met = met.union(a.join(b, block).filter(within).select(block, "_left", "_right"))
    pairs = met.distinct().join(a, [block, "_left"]).join(b, [block, "_right"])
    enough = F.size(F.array_intersect("_bag", "_bag2")) >= kind.shared(F.col("_n"), F.col("_m"), cutoff)
    return pairs.filter(enough).select(block, "_left", "_right", "_made")


def pairs(left: DataFrame, right: DataFrame, block: str, cutoff: float, kind: Similarity = LEVENSHTEIN) -> DataFrame:
    """(block, _left, _right, score) of distinct (block, _left) and (block, _right) that reach the cut-off."""
    scored = candidates(left, right, block, cutoff, kind).withColumn("score", kind.score(F.col("_left"), F.col("_right"), F.col("_made")))
    return scored.filter(F.col("score") >= cutoff - TINY).select(block, "_left", "_right", "score")
