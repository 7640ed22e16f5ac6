"""Exact top-k by integer inner product over an impact-ordered index, a score level at a time."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, give_back, save
from .vectors import checked, matrix

#: Candidates in a block of the index, queries that are worked on at a time, and bytes of queries sent out at once.
BLOCK = 4096
CHUNK = 128
QUERY_BYTES = 32_000_000
#: Impacts are quantised towards zero to multiples of 2**SHIFT.
SHIFT = 2
#: A block's search stops once at most this share of its candidates can still be among the best.
FEW = 1 / 32
#: Vectors with a component from here on are scored in whole numbers of any size; sums of the others fit in 53 bits.
LARGE = 2**22


def whole(x: np.ndarray) -> np.ndarray:
    """floor(256 x) as doubles, which hold it exactly; components whose product overflows are infinite here."""
    with np.errstate(over="ignore"):
        return np.floor(256 * x)


def integers(x: np.ndarray) -> list[int]:
    """floor(256 x) of one vector, whatever its size."""
    return [floor(256 * v) if abs(v) < 2**1000 else 256 * int(v) for v in x.tolist()]


def order_key(score: int) -> bytes:
    """Bytes that sort as the scores do."""
    raw = abs(score).to_bytes((abs(score).bit_length() + 7) // 8, "big")
    return b"\1" + len(raw).to_bytes(4, "big") + raw if score >= 0 else b"\0" + (2**32 - 1 - len(raw)).to_bytes(4, "big") + bytes(255 - b for b in raw)


def postings_of(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(candidate, quantised impact, where each segment begins, what is left of each candidate before each level).

    A segment is the posting list of one component at one level; levels are powers of two of the size of impacts,
    largest first. What is left is the length of the vector without its postings so far."""
    n, dim = w.shape
    size = np.abs(w).astype(np.int64) >> SHIFT << SHIFT
    level = np.where(size > 0, np.frexp(size.astype(np.float64))[1], 0)
    top, low = int(level.max(initial=0)), SHIFT + 1
    row, col, impact, begin, left, known = [], [], [], [0], [], np.zeros(w.shape)
    for at in range(top, low - 1, -1):
        left.append(np.sqrt(((w - known) ** 2).sum(1)))
        c, r = np.nonzero((level == at).T)  # by component
        row.append(r)
        impact.append(np.sign(w[r, c]) * size[r, c])
        begin += (begin[-1] + np.cumsum(np.bincount(c, minlength=dim))).tolist()
        known[r, c] = impact[-1]
    left.append(np.sqrt(((w - known) ** 2).sum(1)))
    joined = lambda parts, kind: np.concatenate([*parts, np.zeros(0)]).astype(kind)
    return joined(row, np.int32), joined(impact, np.float32), np.array(begin, np.int64), np.array(left) * (1 + 1e-9)


class Block:
    """A block of the index: candidates by id, their vectors, and the postings of those without large components."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, small: np.ndarray, row: np.ndarray, impact: np.ndarray, begin: np.ndarray, left: np.ndarray):
        self.ids, self.x, self.small, self.row, self.impact, self.begin, self.left = ids, x, small, row, impact, begin, left
        self.w = whole(x[small])
        self.large = np.setdiff1d(np.arange(len(ids)), small)

    def possible(self, q: np.ndarray, k: int, own: tuple[np.ndarray, np.ndarray], least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (small candidate, query) that can be among the k best of a query and reach what it has already.

        After each level a score is known up to the length of the query times what is left of the candidate. Pairs
        whose upper bound is below the k-th lower bound, or below `least`, are out for sure."""
        n, dim = self.w.shape
        length = np.sqrt((q * q).sum(1)) * (1 + 1e-9)
        score, turned, levels = np.zeros((n, len(q))), np.ascontiguousarray(q.T), len(self.left) - 1
        for at in range(levels + 1):
            if at:
                for c in range(dim):
                    lo, hi = self.begin[(at - 1) * dim + c], self.begin[(at - 1) * dim + c + 1]
                    if lo < hi:
                        score[self.row[lo:hi]] += self.impact[lo:hi, None] * turned[c]
            if at < levels and self.left[at].sum() > 0.5 * self.left[0].sum():
                continue  # too much is left for a proof
            unsure = self.left[at][:, None] * length
            lower, upper = score - unsure, score + unsure
            lower[own], upper[own] = -np.inf, -np.inf
            sure = np.maximum(np.partition(lower, n - k, axis=0)[n - k], least) if n >= k else least
            open_ = upper >= sure
            open_[own] = False
            if at == levels or open_.sum() <= FEW * open_.size:
                return np.nonzero(open_)
        raise AssertionError("the last level ends the search")

    def best(self, names: list, x: np.ndarray, k: int, least: np.ndarray) -> list[list[tuple[int, int]]]:
        """For each query its k best (candidate, exact score) of this block, ties to the smaller id."""
        out: list[list[tuple[int, int]]] = [[] for _ in names]
        w = whole(x)
        small = np.flatnonzero(np.abs(w).max(1, initial=0) < LARGE)
        at = {i: p for p, i in enumerate(self.small.tolist())}
        ranges = [range(*(int(np.searchsorted(self.ids, name, side)) for side in ("left", "right"))) for name in names]
        for lo in range(0, len(small), CHUNK):
            here = small[lo : lo + CHUNK]
            pairs = [(at[i], p) for p, j in enumerate(here.tolist()) for i in ranges[j] if i in at]
            own = tuple(np.array([p[s] for p in pairs], np.int64) for s in (0, 1))
            if not len(self.small):
                break
            c, p = self.possible(w[here], k, own, least[here])
            score = np.einsum("ij,ij->i", self.w[c], w[here][p]).astype(np.int64)
            order = np.lexsort((c, -score, p))
            c, p, score = c[order], p[order], score[order]
            nth = np.arange(len(p)) - np.searchsorted(p, p)
            for i, j, v in zip(self.small[c[nth < k]].tolist(), here[p[nth < k]].tolist(), score[nth < k].tolist(), strict=True):
                out[j].append((i, v))
        big = np.setdiff1d(np.arange(len(names)), small)
        if len(big) or len(self.large):
            exact = {j: integers(x[j]) for j in (range(len(names)) if len(self.large) else big.tolist())}
            for i in range(len(self.ids)) if len(big) else self.large.tolist():
                own_w = integers(self.x[i])
                for j in big.tolist() if i in at else exact:
                    if i not in ranges[j]:
                        out[j].append((i, sum(a * b for a, b in zip(own_w, exact[j], strict=True))))
        return [sorted(found, key=lambda f: (-f[1], f[0]))[:k] for found in out]


def top_k(df: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k best rows for each row that `queries`, a condition on any columns of df, selects: query_id, rank from 1, id, score; all if fewer.

    Components x count as floor(256 x), of any size; the score is the inner product, ties go to the smaller id, and a
    query's own id is no candidate. A score beyond 64 bits is given as null, but ranked by its value.

    Candidates lie in blocks of about BLOCK rows, written once with their postings; each is one row of a table.
    Queries go out QUERY_BYTES at a time and meet all blocks where these are read, so no candidate is copied or
    shuffled. A task keeps the k-th best score that it has for each query, below which nothing is looked at further.
    Each block hands on its k best for each query, and a window over these ends the search.

    Rows without an id, and vectors that are null or hold null or non-finite components, take no part; shorter ones end in zeros. Rows that
    repeat an id are candidates each; equal rows are one query. Empty tables give empty results; extra columns are
    ignored."""
    # the condition is on df's own columns, so it is evaluated before these are cut
    named = df.filter(F.col(id_col).isNotNull()).select(F.struct(F.col(id_col).alias("id"), F.coalesce(queries, F.lit(False)).alias("asked")).alias("_named"), F.col(vector_col).alias("_vector"))
    rows = checked(named, "_named", "_vector", lambda x: x).select(F.col("_id.id").alias("_id"), F.col("_id.asked").alias("_asked"), "vec", "class")
    rows = save(rows.withColumnRenamed("_id", id_col), "vectors")
    n, size = rows.agg(F.count("*"), F.max(F.octet_length("vec"))).first()
    dim, blocks = max(1, (size or 0) // 8), max(1, -(-n // BLOCK))
    id_type = rows.schema[id_col].dataType.simpleString()
    parts = ("x", "small", "row", "impact", "begin", "left")
    kinds = (np.float64, np.int32, np.int32, np.float32, np.int64, np.float64)

    def built(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        x = matrix(table["vec"], dim)
        small = np.flatnonzero(np.abs(whole(x)).max(1, initial=0) < LARGE).astype(np.int32)
        made = (x, small, *postings_of(whole(x[small])))
        cells = [pa.array([np.ascontiguousarray(v, kind).tobytes()], pa.binary()) for v, kind in zip(made, kinds, strict=True)]
        return pa.table([pa.array([table["id"].to_pylist()], pa.list_(table["id"].type)), *cells], names=["ids", *parts])

    grouped = rows.select(F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias("block"), F.col(id_col).alias("id"), "vec").groupBy("block")
    index = save(grouped.applyInArrow(built, f"ids array<{id_type}>, " + ", ".join(f"`{c}` binary" for c in parts)), "impact-index")
    asked = save(rows.filter("_asked").drop("_asked").dropDuplicates([id_col, "class"]), "queries")
    m = asked.count()
    turns = max(1, -(-m * (8 * dim + 64) // QUERY_BYTES))

    def found_for(turn: int) -> DataFrame:
        own = asked.filter(F.pmod(F.xxhash64(id_col, "class"), F.lit(turns)) == turn).toArrow()
        kind = own.schema.field(id_col).type
        sent = df.sparkSession.sparkContext.broadcast((own[id_col].to_pylist(), own["class"].to_pylist(), matrix(own["vec"], dim)))

        def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, classes, x = sent.value
            seen, least = np.full((len(names), k), -np.inf), np.full(len(names), -np.inf)
            for batch in batches:
                for r in range(batch.num_rows):
                    cells = [np.frombuffer(batch.column(c)[r].as_py(), t) for c, t in zip(parts, kinds, strict=True)]
                    ids = batch.column("ids")[r].as_py()
                    cells[0] = cells[0].reshape(len(ids), dim)
                    cells[5] = cells[5].reshape(-1, len(cells[1]))
                    out: list[list] = [[], [], [], [], []]
                    for j, found in enumerate(Block(np.array(ids), *cells).best(names, x, k, least)):
                        for i, v in found:
                            for column, value in zip(out, (names[j], classes[j], ids[i], v if -(2**63) <= v < 2**63 else None, order_key(v)), strict=True):
                                column.append(value)
                        if found and all(abs(v) < 2**53 for _, v in found):
                            seen[j] = np.sort(np.concatenate([seen[j], [v for _, v in found]]))[-k:]
                            least[j] = seen[j][0]
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], kind), pa.array(out[1], pa.int64()), pa.array(out[2], kind), pa.array(out[3], pa.int64()), pa.array(out[4], pa.binary())], names=["query_id", "class", id_col, "score", "order"])
            give_back()

        return save(index.mapInArrow(searched, f"query_id {id_type}, class long, `{id_col}` {id_type}, score long, `order` binary"), "found")

    best = reduce(DataFrame.union, [found_for(turn) for turn in range(turns)])
    discard(rows, index, asked)
    rank = F.row_number().over(Window.partitionBy("query_id", "class").orderBy(F.desc("order"), id_col))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", id_col, "score")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors for each vector whose id is divisible by 50."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


ORACLE_TOPK = """
WITH c AS (
  SELECT e.vec_id, u.i, CAST(floor(256 * CAST(e.embedding[u.i] AS DOUBLE)) AS BIGINT) AS w
  FROM embeddings e, (SELECT unnest(generate_series(1, 64)) AS i) u
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(sum(q.w * v.w) AS BIGINT) AS score
  FROM c q JOIN c v ON q.i = v.i AND q.vec_id <> v.vec_id
  WHERE q.vec_id % 50 = 0
  GROUP BY q.vec_id, v.vec_id
), r AS (
  SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
