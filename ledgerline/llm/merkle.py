"""Merkle manifest of a table: a persistent tree of three-fold nodes per group, and one version of it per changed row.

Rows of a group are numbered in order by ranges, so a group of any size is spread over all tasks. Leaves are handled in
aligned blocks of 3 ** depth: a block is a subtree, built in one task; its roots are the leaves of the next round, until
a group has one node. The roots of groups make a tree of the same kind. Nobody holds more than one block.

On the way back each block gets the siblings of its way to the top. A changed leaf makes a new version of the tree: in
the block only its ancestors are copied and all other nodes are shared with the first version, and above the block the
version goes on along the block's siblings, so versions never touch each other and need no exchange of their own."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, lanes, save, small_side

ARITY = 3
SIDES = "array<struct<before:string,after:string>>"
SIDES_ARROW = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def joined(digests: Sequence[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def folded(digest: str, sides: Sequence[tuple[str, str]]) -> str:
    """The root above a node with these siblings, level by level."""
    for before, after in sides:
        digest = joined((before, digest, after))
    return digest


class Tree:
    """Levels of digests over leaves: each run of ARITY nodes becomes one, `levels` times or, if None, until one is left."""

    def __init__(self, leaves: Sequence[str], levels: int | None = None):
        self.levels = [list(leaves)]
        while len(self.levels[-1]) > 1 if levels is None else len(self.levels) <= levels:
            last = self.levels[-1]
            self.levels.append([joined(last[i : i + ARITY]) for i in range(0, len(last), ARITY)])

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def node(self, level: int, at: int) -> str:
        return self.levels[level][at]

    def sides(self, at: int) -> list[tuple[str, str]]:
        """Siblings before and after the way from a leaf to the root."""
        out = []
        for level in self.levels[:-1]:
            begin = at - at % ARITY
            out.append(("".join(level[begin:at]), "".join(level[at + 1 : begin + ARITY])))
            at //= ARITY
        return out


class Version:
    """A tree in which one leaf is another: it holds the copied leaf and ancestors, all else is the first version's."""

    def __init__(self, tree: Tree, at: int, digest: str):
        self.tree, self.at, self.copied = tree, at, [digest]
        for level in tree.levels[:-1]:
            begin = at - at % ARITY
            self.copied.append(joined((*level[begin:at], self.copied[-1], *level[at + 1 : begin + ARITY])))
            at //= ARITY

    @property
    def root(self) -> str:
        return self.copied[-1]

    def node(self, level: int, at: int) -> str:
        return self.copied[level] if at == self.at // ARITY**level else self.tree.node(level, at)


def leaf_of(columns: Sequence[Column]) -> Column:
    """Digest of values: each is `-` if null, else its UTF-8 byte count, a colon and itself."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def placed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Saved rows with _group, _id, _leaf, as (rows with key: rank of the group, size of it, pos: place in it, from 0;
    groups: key, size). Null groups and ids come first, groups are ordered by bytes, ties of an id by leaf."""
    parts = lanes(rows.sparkSession)
    order = [F.col(c).asc_nulls_first() for c in ("_group", "_id", "_leaf")]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = save(dealt.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_row")), "placed-rows")
    counts = save(dealt.groupBy("_group", "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first")), "placed-counts")
    groups = counts.groupBy("_group").agg(F.min("_part").alias("_from"), F.sum("_n").alias("size"))
    before, starts = 0, []
    for part, n in sorted(map(tuple, groups.groupBy("_from").count().collect())):  # a row per range at most
        starts.append((part, before))
        before += n
    starts = rows.sparkSession.createDataFrame(starts, "_from int, _rank long")
    rank = F.row_number().over(Window.partitionBy("_from").orderBy(F.col("_group").asc_nulls_first())) - 1
    groups = groups.join(F.broadcast(starts), "_from").select(F.col("_group").alias("_same"), (F.col("_rank") + rank).alias("key"), "size")
    groups = save(groups, "groups")
    upto = Window.partitionBy("key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    place = counts.join(small_side(groups), F.col("_group").eqNullSafe(F.col("_same"))).drop("_same")
    place = place.select("_group", "_part", "key", "size", (F.coalesce(F.sum("_n").over(upto), F.lit(0)) - F.col("_first")).alias("_shift"))
    place = save(place.select(F.col("_group").alias("_same"), F.col("_part").alias("_there"), "key", "size", "_shift"), "places")
    met = F.col("_group").eqNullSafe(F.col("_same")) & (F.col("_part") == F.col("_there"))
    out = dealt.join(small_side(place), met).withColumn("pos", F.col("_row") + F.col("_shift")).drop("_same", "_there", "_shift", "_part", "_row")
    return out, groups


def tree_of(table: pa.Table, depth: int) -> Tree:
    """The subtree of one block's nodes, in order: of `depth` levels, or up to its root if it is its group's only block."""
    return Tree(table["digest"].to_pylist(), depth if table["size"][0].as_py() > ARITY**depth else None)


def _block(nodes: DataFrame, depth: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {ARITY**depth}"))


def raised(nodes: DataFrame, depth: int) -> DataFrame:
    """Saved roots of the blocks of nodes (key, size, pos, digest), as nodes of the next round."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        one = table.slice(0, 1)
        return pa.table({"key": one["key"], "size": pa.array([-(-one["size"][0].as_py() // ARITY**depth)]), "pos": one["block"], "digest": [tree_of(table, depth).root]})

    return save(_block(nodes, depth).groupBy("key", "block").applyInArrow(run, "key long, size long, pos long, digest string"), "tree-nodes")


def ways(nodes: DataFrame, upper: DataFrame, depth: int) -> DataFrame:
    """Saved (key, pos, inner, outer) of saved nodes: siblings on their way up. upper: the same of their blocks' roots."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        tree = tree_of(table, depth)
        sides = [[{"before": a, "after": b} for a, b in tree.sides(i)] for i in range(table.num_rows)]
        return table.select(["key", "block", "pos"]).append_column("sides", pa.array(sides, SIDES_ARROW))

    own = _block(nodes, depth).groupBy("key", "block").applyInArrow(run, f"key long, block long, pos long, sides {SIDES}")
    upper = small_side(upper.withColumnRenamed("pos", "block"))
    return save(own.join(upper, ["key", "block"]).select("key", "pos", F.concat("sides", "inner").alias("inner"), "outer"), "tree-ways")


def rounds_of(nodes: DataFrame, size: int, depth: int) -> list[DataFrame]:
    """Nodes of each round, up to that in which every key has one; size: of the largest key."""
    out = [nodes]
    while size > 1:
        out.append(raised(out[-1], depth))
        size = -(-size // ARITY**depth)
    return out


def manifest(df: DataFrame, columns: Sequence[str], changed: Mapping[str, Column] | None = None, id_col: str = "doc_id", group_col: str = "source", with_nodes: bool = False, depth: int = 6) -> DataFrame:
    """One row per row of df: id, leaf, subroot, root, proof_sha256, new_leaf, folded_root, verified; with_nodes also
    siblings (digests before and after the way, level by level) and copied (the version's own nodes, from the leaf to the root).

    Leaves are digests of `columns`; those of a group ascend by id. changed: what columns are in the version of each row.
    proof_sha256 is of all siblings from the leaf to the root; folded_root is the root of the version. A block
    has `depth` levels.

    A null group is a group, before all others; null ids come first in theirs. Rows that share an id are ordered by
    leaf; repeated rows have a leaf each. Null and empty values differ (`-` and `0:`). Very long texts are hashed where they are
    read, and only digests are moved. An empty table gives an empty result; extra columns are ignored."""
    changed = changed or {}
    new = [changed.get(c, F.col(c)) for c in columns]
    rows = save(df.select(F.col(group_col).cast("string").alias("_group"), F.col(id_col).alias("_id"), leaf_of([F.col(c) for c in columns]).alias("_leaf"), leaf_of(new).alias("_new")), "leaves")
    leaves, groups = placed(rows)
    leaves = save(leaves.select("key", "size", "pos", "_id", F.col("_leaf").alias("digest"), "_new"), "placed-leaves")
    n, largest = groups.agg(F.count("*"), F.max("size")).first()
    id_type = df.schema[id_col].dataType.simpleString()
    spec = f"_id {id_type}, leaf string, subroot string, root string, proof_sha256 string, new_leaf string, folded_root string, verified boolean" + f", siblings {SIDES}, copied array<string>" * with_nodes
    if not n:
        return rows.sparkSession.createDataFrame([], spec).withColumnRenamed("_id", id_col)
    inner = rounds_of(leaves.select("key", "size", "pos", "digest"), largest, depth)
    top = inner[-1].select(F.lit(0).cast("long").alias("key"), F.lit(n).cast("long").alias("size"), F.col("key").alias("pos"), "digest")
    outer = rounds_of(save(top, "subroots"), n, depth)
    root = outer[-1].first()["digest"]
    none = F.array().cast(SIDES)
    way = save(outer[-1].select("key", "pos", none.alias("inner"), none.alias("outer")), "tree-ways")
    for nodes in reversed(outer[:-1]):
        way = ways(nodes, way, depth)
    way = save(way.select(F.col("pos").alias("key"), F.lit(0).cast("long").alias("pos"), none.alias("inner"), F.col("inner").alias("outer")), "tree-ways")
    for nodes in reversed(inner[1:-1]):
        way = ways(nodes, way, depth)

    def versions(table: pa.Table) -> pa.Table:
        """All rows of a block, each with its own version of the block's tree."""
        table = table.sort_by("pos")
        tree = tree_of(table, depth)
        above, beyond = ([(x["before"], x["after"]) for x in table[c][0].as_py()] for c in ("inner", "outer"))
        subroot = folded(tree.root, above)
        out: list[list] = [[] for _ in range(7 if with_nodes else 5)]
        for i, digest in enumerate(table["_new"].to_pylist()):
            version, sides = Version(tree, i, digest), [*tree.sides(i), *above, *beyond]
            end = folded(version.root, [*above, *beyond])
            row = [subroot, root, hashlib.sha256("".join(a + b for a, b in sides).encode()).hexdigest(), end, end == root]
            if with_nodes:
                copied = list(version.copied)
                for before, after in [*above, *beyond]:
                    copied.append(joined((before, copied[-1], after)))
                row += [[{"before": a, "after": b} for a, b in sides], copied]
            for x, v in zip(out, row, strict=True):
                x.append(v)
        text = [pa.array(x, pa.string()) for x in out[:4]]
        got = [table["_id"], table["digest"], *text[:3], table["_new"], text[3], pa.array(out[4], pa.bool_())]
        names = ["_id", "leaf", "subroot", "root", "proof_sha256", "new_leaf", "folded_root", "verified"]
        if with_nodes:
            got += [pa.array(out[5], SIDES_ARROW), pa.array(out[6], pa.list_(pa.string()))]
            names += ["siblings", "copied"]
        return pa.table(got, names=names)

    blocks = _block(leaves, depth).join(small_side(way.withColumnRenamed("pos", "block")), ["key", "block"])
    discard(rows, *inner[1:], *outer)
    return blocks.groupBy("key", "block").applyInArrow(versions, spec).withColumnRenamed("_id", id_col)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of all documents under one root, and the root that each has with the line ends of every other text deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = {"text": F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    made = manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], changed)
    return made.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _sql_field(column: str) -> str:
    return f"coalesce(CAST(strlen(CAST({column} AS VARCHAR)) AS VARCHAR) || ':' || CAST({column} AS VARCHAR), '-')"


_SQL_OTHERS = " || ".join(_sql_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
ORACLE_MERKLE = f"""
WITH RECURSIVE c AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
    lambda s, b: xor(xor(s, b) >> 1, 3988292384 * (xor(s, b) & 1)))) AS crc FROM documents
), l AS (
  SELECT doc_id, source, sha256({_SQL_OTHERS} || {_sql_field("text")}) AS leaf,
    sha256({_SQL_OTHERS} || {_sql_field("CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")}) AS changed,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos FROM c
), t AS (
  SELECT source, 0 AS lvl, list(leaf ORDER BY doc_id) AS nodes FROM l GROUP BY source
  UNION ALL
  SELECT source, lvl + 1, list_transform(range(0, (len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1 : 3 * i + 3], ''))) FROM t WHERE len(nodes) > 1
), s AS (SELECT source, lvl AS height, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM t WHERE len(nodes) = 1
), u AS (
  SELECT 0 AS lvl, list(subroot ORDER BY pos) AS nodes FROM s
  UNION ALL
  SELECT lvl + 1, list_transform(range(0, (len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1 : 3 * i + 3], ''))) FROM u WHERE len(nodes) > 1
), w AS (
  SELECT doc_id, l.source, t.lvl, pos // CAST(pow(3, t.lvl) AS BIGINT) AS place, t.nodes FROM l JOIN t ON l.source IS NOT DISTINCT FROM t.source WHERE len(t.nodes) > 1
  UNION ALL
  SELECT doc_id, l.source, s.height + u.lvl, s.pos // CAST(pow(3, u.lvl) AS BIGINT), u.nodes FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source, u WHERE len(u.nodes) > 1
), g AS (
  SELECT doc_id, lvl, array_to_string(nodes[place - place % 3 + 1 : place], '') AS before, array_to_string(nodes[place + 2 : place - place % 3 + 3], '') AS after FROM w
), p AS (SELECT doc_id, sha256(string_agg(before || after, '' ORDER BY lvl)) AS proof_sha256 FROM g GROUP BY doc_id
), f AS (
  SELECT doc_id, 0 AS lvl, changed AS digest FROM l
  UNION ALL
  SELECT f.doc_id, f.lvl + 1, sha256(before || digest || after) FROM f JOIN g ON f.doc_id = g.doc_id AND f.lvl = g.lvl
), e AS (SELECT doc_id, arg_max(digest, lvl) AS folded_root FROM f GROUP BY doc_id
), r AS (SELECT nodes[1] AS root FROM u WHERE len(nodes) = 1)
SELECT l.doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source JOIN e ON l.doc_id = e.doc_id LEFT JOIN p ON l.doc_id = p.doc_id, r
"""
