"""Fill-in-the-middle: texts cut into lines, and prefix, middle and suffix put in another order, by counted patterns.

The number of lines comes from regexp_count. Where to cut is drawn from a hash of the id, and a pattern made for the row,
with possessive groups of exactly a and b - a lines, takes prefix, middle and suffix in one match; the replacement sets
them in their new order. Everything is an expression of the JVM, without an exchange."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of

#: A line with its end, or what follows the last end.
UNIT = r"[^\n]*\n|[^\n]+"
#: Before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")


def _checked(marks: Sequence[str]) -> None:
    """Marks by which an output can be taken apart: none is in another, and none begins as another ends."""
    if len(marks) != 3 or not all(marks):
        raise ValueError("three marks are needed")
    for i, j in product(range(3), repeat=2):
        a, b = marks[i], marks[j]
        if i != j and a in b or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + (i != j))):
            raise ValueError(f"marks {a!r} and {b!r} can't be told apart")


def _draws(seed: int, key: Column) -> list[Column]:
    """Four unsigned 32-bit numbers from the hex digest of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _parts(marks: Sequence[str], order: str) -> tuple[str, str, str]:
    """(replacement that puts groups 1 to 3, prefix, middle and suffix, in order; pattern of such an output; replacement
    that puts its groups back in the order of the text). order: "psm" or "spm"."""
    mark, group = dict(zip("psm", marks, strict=True)), {"p": 1, "m": 2, "s": 3}
    made = "".join(mark[x].replace("\\", "\\\\").replace("$", "\\$") + f"${group[x]}" for x in order)
    taken = r"(?s)\A" + "".join(r"\Q" + mark[x].replace(r"\E", r"\E\\E\Q") + r"\E(.*)" for x in order) + r"\z"
    back = "".join(f"${order.index(x) + 1}" for x in "pms")
    return made, taken, back


def restored(output: Column, form: Column, marks: Sequence[str] = MARKS) -> Column:
    """The text that an output and its form were made of."""
    ways = {order: _parts(marks, order) for order in ("psm", "spm")}
    out = output
    for order, (_, taken, back) in ways.items():
        out = F.when(form == order, F.regexp_replace(output, taken, back)).otherwise(out)
    return out


def fill_in_middle(df: DataFrame, seed: int = 7, percent: int = 100, spm_percent: int = 50, id_col: str = "doc_id", text_col: str = "text", marks: Sequence[str] = MARKS) -> DataFrame:
    """One row per row of df: id, n, form, prefix_chars, middle_chars, output.

    n is the number of lines. Form is plain, with the text as output, if the text is empty or holds a mark, or for 100 -
    percent of 100 ids; else spm (suffix, prefix, middle) for spm_percent of 100 ids and psm (prefix, suffix, middle)
    for the others. Lengths are in code points, null where plain.

    Null texts count as empty; a null id draws as an empty one. Repeated ids draw the same; rows with equal ids and
    texts give equal rows. Very long texts are matched whole, without recursion. An empty table gives an empty result;
    extra columns are ignored."""
    _checked(marks)
    if not 0 <= percent <= 100 or not 0 <= spm_percent <= 100:
        raise ValueError("percentages must be 0 to 100")
    h1, h2, h3, h4 = _draws(seed, F.col("_id"))
    rows = df.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    rows = rows.select("*", F.regexp_count("_text", F.lit(UNIT)).cast("long").alias("n"))
    holds = F.col("_text") == ""
    for mark in marks:
        holds |= F.contains("_text", F.lit(mark))
    form = F.when(holds | (h3 % 100 >= percent), "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    a, b = F.least(h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)), F.greatest(h1 % (F.col("n") + 1), h2 % (F.col("n") + 1))
    rows = rows.select("*", form.alias("form"), a.alias("_a"), (b - a).alias("_m"))
    pattern = F.concat(F.lit(rf"\A((?:{UNIT}){{"), "_a", F.lit(rf"}}+)((?:{UNIT}){{"), "_m", F.lit(r"}+)((?s:.*))\z"))
    order = F.when(F.col("form") == "spm", _parts(marks, "spm")[0]).otherwise(_parts(marks, "psm")[0])
    output = F.when(F.col("form") == "plain", F.col("_text")).otherwise(F.regexp_replace("_text", pattern, order))
    rows = rows.select("*", output.alias("output"))
    at = {x: F.instr("output", mark).cast("long") + len(mark) for x, mark in zip("psm", marks, strict=True)}  # first character behind each mark
    prefix = F.when(F.col("form") == "psm", at["s"] - len(marks[1]) - at["p"]).when(F.col("form") == "spm", at["m"] - len(marks[2]) - at["p"])
    middle = F.when(F.col("form") != "plain", F.length("output").cast("long") + 1 - at["m"])
    return rows.select(F.col("_id").alias(id_col), "n", "form", prefix.alias("prefix_chars"), middle.alias("middle_chars"), "output")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with prefix, suffix and middle in the order of their form, and what they are restored to."""
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


ORACLE_INFILL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || CAST(doc_id AS VARCHAR)) AS h FROM documents
), k AS (
  SELECT doc_id, t, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM k
), p AS (
  SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
