"""Embedding near-duplicates by product quantisation: inverted lists, residual codes, table look-ups, exact cosine."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, small_side
from .graph import components
from .vectors import checked, matrix

#: Vectors the quantisers are fitted on, those with the smallest hash of their id.
SAMPLE = 20_000
#: Inverted lists at most; below that about the square root of the number of vectors.
LISTS = 4096
SUBSPACES = 8
CENTROIDS = 64
#: Vectors of one list in a task, and queries of it.
BLOCK = 4096


def means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """k-means from seeded rows of x."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, c)
        order = np.argsort(own, kind="stable")
        filled, first = np.unique(own[order], return_index=True)
        c[filled] = np.add.reduceat(x[order], first) / np.diff(np.append(first, len(x)))[:, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([(x[i : i + 4096] @ c.T - half).argmax(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


class Quantiser:
    """Coarse centroids, and for each subspace of the residuals its own centroids."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.coarse = means(sample, lists)
        rest = sample - self.coarse[nearest(sample, self.coarse)]
        self.edges = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int)
        self.fine = [means(rest[:, a:b], CENTROIDS) for a, b in zip(self.edges[:-1], self.edges[1:], strict=True)]
        self.apart = np.sqrt(np.maximum(((self.coarse[:, None] - self.coarse[None]) ** 2).sum(2), 0)) if len(self.coarse) <= 512 else None

    def codes(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals, and how far each lies from what its code stands for."""
        own = np.stack([nearest(rest[:, a:b], c) for a, b, c in zip(self.edges[:-1], self.edges[1:], self.fine, strict=True)], 1).astype(np.uint8)
        back = np.concatenate([c[own[:, m]] for m, c in enumerate(self.fine)], 1)
        return own, np.sqrt(((rest - back) ** 2).sum(1))

    def probes(self, x: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(own list of each row, row, list) for lists whose border with the row's own list is at most margin away."""
        d = (self.coarse**2).sum(1) - 2 * (x @ self.coarse.T)
        own = d.argmin(1)
        apart = self.apart[own] if self.apart is not None else np.sqrt(np.maximum((self.coarse**2).sum(1) + (self.coarse[own] ** 2).sum(1)[:, None] - 2 * self.coarse[own] @ self.coarse.T, 0))
        row, near = np.nonzero(d - d[np.arange(len(x)), own][:, None] <= 2 * margin * apart)
        return own, row, near

    def tables(self, rest: np.ndarray) -> list[np.ndarray]:
        """Squared distances of each query's residual to the centroids of each subspace."""
        return [((rest[:, a:b] ** 2).sum(1)[:, None] - 2 * rest[:, a:b] @ c.T + (c * c).sum(1)) for a, b, c in zip(self.edges[:-1], self.edges[1:], self.fine, strict=True)]


def unit(x: np.ndarray) -> np.ndarray | None:
    """x at length 1; None if it is zero."""
    most = np.abs(x).max(initial=0.0)
    if most == 0:
        return None
    x = x / most
    return x / math.sqrt(float(x @ x))


def near_duplicates(df: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", sigmas: float = 2.0) -> DataFrame:
    """One row per row of df: id, n_links, component_id, kept. Rows link when the cosine of their vectors is >= least.

    Equal vectors are one class, compared once. A vector goes to the inverted list of its nearest coarse centroid and
    is looked for in each list whose border is within `sigmas` standard deviations of the step that a neighbour at the
    least cosine makes in a random direction, delta / sqrt(dim); so the lists that are probed follow the data, and
    recall against brute force is measured in the tests. In a list nothing is lost: the table distance to a code
    differs from the true one by at most the code's own error, so all within delta + error are reranked by exact
    cosine in double precision. Pairs of different lists are met from one side and counted for both.

    Lists are split into blocks of BLOCK vectors times BLOCK queries. A block gives link counts and, for components,
    one link per label that a query meets, never its pairs. Vectors that are null, zero or hold null or non-finite
    components link with nothing and are kept. Shorter vectors count as ending in zeros. Rows that repeat an id count
    as rows of their own. An empty table gives an empty result; extra columns are ignored."""
    spark = df.sparkSession
    every = df.select(F.col(id_col).alias("_id"))
    rows = save(checked(df, id_col, vector_col, unit), "vectors")
    classes = save(rows.groupBy("class").agg(F.min("_id").alias("node"), F.count("*").alias("times"), F.first("vec").alias("vec"), F.octet_length(F.first("vec")).alias("size")), "vector-classes")
    n, size = classes.agg(F.count("*"), F.max("size")).first()
    if not n:
        return every.select(F.col("_id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"), F.lit(True).alias("kept"))
    dim = size // 8
    taken = classes.select("node", "vec").orderBy(F.xxhash64("node"), "node").limit(SAMPLE).collect()
    model = Quantiser(matrix(pa.array([bytes(r["vec"]) for r in taken]), dim), max(1, min(LISTS, math.isqrt(n))))
    shared = spark.sparkContext.broadcast(model)
    delta = math.sqrt(max(0.0, 2 - 2 * least))
    margin = min(delta, sigmas * delta / math.sqrt(dim))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A base row (role 0) in the own list, and a query row (role 1) for it and each probed list of a lower number."""
        q = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                x = matrix(part.column(2), dim)
                own, row, near = q.probes(x, margin)
                keep = near <= own[row]
                row, near = row[keep], near[keep]
                take = pa.array(np.concatenate([np.arange(len(x)), row]))
                role = np.repeat([0, 1], [len(x), len(row)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([own, near]).astype(np.int32)), pa.array(role), *(part.column(k).take(take) for k in range(3)), pa.array(own.astype(np.int32)).take(take)], names=["list", "role", "node", "times", "vec", "own"])

    node = classes.schema["node"].dataType.simpleString()
    dealt = save(classes.select("node", "times", "vec").mapInArrow(listed, f"list int, role int, node {node}, times long, vec binary, own int"), "listed")
    sizes = F.broadcast(dealt.groupBy("list").agg(F.ceil(F.count_if(F.col("role") == 0) / BLOCK).cast("int").alias("blocks"), F.ceil(F.count_if(F.col("role") == 1) / BLOCK).cast("int").alias("parts")))
    placed = dealt.join(sizes, "list").filter("blocks > 0 and parts > 0")
    place = lambda count: F.pmod(F.xxhash64("node"), F.col(count)).cast("int")
    base = placed.filter("role = 0").withColumn("block", place("blocks")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("list", "block", "part", "node", "times", "vec")
    query = placed.filter("role = 1").withColumn("part", place("parts")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*(F.col(c).alias(c) for c in ("list", "block", "part", "node", "times", "vec", "own")))

    def searched(left: pa.Table, right: pa.Table) -> pa.Table:
        names, ids, counts, ends = ["node", "links", "other"], [], [], []
        if left.num_rows and right.num_rows:
            q, here = shared.value, left["list"][0].as_py()
            x, y = matrix(left["vec"], dim), matrix(right["vec"], dim)
            nodes, times = left["node"].to_pylist(), left["times"].to_numpy()
            codes, error = q.codes(x - q.coarse[here])
            asking, weight, own = right["node"].to_pylist(), right["times"].to_numpy(), right["own"].to_numpy()
            label, met = np.arange(len(x)), np.zeros(len(x), np.int64)
            reach = (delta + error + 1e-9) ** 2
            for i in range(0, len(y), 256):
                z = y[i : i + 256]
                tables = q.tables(z - q.coarse[here])
                far = sum(t[:, codes[:, m]] for m, t in enumerate(tables))
                who, what = np.nonzero(far <= reach)
                linked = np.einsum("ij,ij->i", z[who], x[what]) >= least
                who, what = who[linked], what[linked]
                bounds = np.searchsorted(who, np.arange(len(z) + 1))
                for j in range(len(z)):
                    found = what[bounds[j] : bounds[j + 1]]
                    found = found[[nodes[k] != asking[i + j] for k in found]] if len(found) else found
                    if not len(found):
                        continue
                    ids.append(asking[i + j])
                    counts.append(int(times[found].sum()))
                    labels = np.unique(label[found])
                    ends.append(nodes[found[0]])
                    for other in labels[labels != label[found[0]]]:
                        ids.append(asking[i + j])
                        counts.append(0)
                        ends.append(nodes[found[label[found] == other][0]])
                    if len(labels) > 1:
                        label[np.isin(label, labels)] = labels[0]
                    if own[i + j] != here:
                        met[found] += weight[i + j]
            for k in np.flatnonzero(met):
                ids.append(nodes[k])
                counts.append(int(met[k]))
                ends.append(nodes[k])
        kind = left.schema.field("node").type
        return pa.table([pa.array(ids, kind), pa.array(counts, pa.int64()), pa.array(ends, kind)], names=names)

    key = ["list", "block", "part"]
    found = save(base.groupBy(*key).cogroup(query.groupBy(*key)).applyInArrow(searched, f"node {node}, links long, other {node}"), "vector-links")
    label = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.select("class", "node", "times").join(links, "node", "left").join(label.withColumnRenamed("id", "node"), "node", "left")
    named = named.select("class", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    named = save(named.filter("n_links > 0"), "vector-components")
    linked = rows.select("_id", "class").join(small_side(named), "class").select("_id", "n_links", "component_id")
    good = rows.select("_id", "class").join(small_side(named), "class", "left_anti").select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    bad = without(df, id_col, vector_col)
    every = linked.unionByName(good).unionByName(bad.select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id")))
    return every.select(F.col("_id").alias(id_col), "n_links", "component_id", (F.col("_id") == F.col("component_id")).alias("kept"))


def without(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Ids of rows whose vector takes no part: the complement of checked() with unit vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for v in batch.column(1):
                x = None if not v.is_valid or v.values.null_count else v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                keep.append(x is None or not np.isfinite(x).all() or unit(x) is None)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_()))], names=["_id"])

    id_type = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("_id"), F.col(vector_col)).mapInArrow(run, f"_id {id_type}")


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all vectors."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
