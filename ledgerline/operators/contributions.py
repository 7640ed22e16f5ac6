"""Exact contributions of features to the probability of tree models, against rows of a background.

A tree is a table of paths: for each leaf its value and the range that each feature on its way must lie in. For a row
and a background row a leaf counts if every feature on its way fits for one of them; the features that fit for the row alone share
what the leaf adds, those that fit for the background row alone what it takes away, by the Shapley weights of their numbers.
That is the interventional Shapley value itself, not an estimate: contributions sum up to f(row) - mean f(background).

Paths and background are bounded by the models and by a parameter; rows are worked out by cells, in batches side by side."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import reread, stage_folder


@dataclass
class Paths:
    """Leaves of a model's trees: value of each, and for each of its features (index, low, high], padded with index -1.

    link: whether the sum of values is a margin m of which 1 / (1 + exp(-2 m)) is the probability."""

    value: np.ndarray
    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    link: bool

    def fits(self, x: np.ndarray, leaf: int) -> np.ndarray:
        """For each row the features of a leaf's way that fit, as bits."""
        bits = np.zeros(len(x), np.int64)
        for k, f in enumerate(self.feature[leaf]):
            if f < 0:
                break
            bits |= ((x[:, f] > self.low[leaf, k]) & (x[:, f] <= self.high[leaf, k])).astype(np.int64) << k
        return bits

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for leaf, v in enumerate(self.value):
            out += v * (self.fits(x, leaf) == (1 << int((self.feature[leaf] >= 0).sum())) - 1)
        return out

    def probabilities(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-2 * margins)) if self.link else margins


def paths_of(model: PipelineModel) -> Paths:
    """The table of paths of a pipeline's last stage, a forest or boosted trees over continuous features, from its saved nodes.

    Ranges of features that the pipeline bins are those of the values themselves."""
    splits = {}
    for stage in model.stages[:-1]:
        if isinstance(stage, Bucketizer):
            splits |= {f"{c}_bin": points for c, points in zip(stage.getInputCols(), stage.getSplitsArray(), strict=True)}
    columns = next((s.getInputCols() for s in model.stages if isinstance(s, VectorAssembler)), [])
    tree_model, spark = model.stages[-1], SparkSession.active()
    path = f"{stage_folder(spark)}/trees-{uuid.uuid4().hex}"
    tree_model.write().save(path)
    weights = tree_model.treeWeights
    boosted = "GBT" in type(tree_model).__name__
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()  # bounded by trees and depth
    nodes = {(r["treeID"], r["id"]): r for r in rows}
    out = []

    def walk(tree: int, at: int, bounds: dict[int, tuple[float, float]]) -> None:
        node = nodes[tree, at]
        if node["leftChild"] < 0:
            stats = node["impurityStats"]
            value = weights[tree] * node["prediction"] if boosted else stats[1] / sum(stats) / len(weights)
            out.append((value, bounds))
            return
        f, cut = node["split"]["featureIndex"], node["split"]["leftCategoriesOrThreshold"][0]
        if node["split"]["numCategories"] != -1:
            raise ValueError("only continuous features have ranges")
        if f < len(columns) and columns[f] in splits:  # bins up to the cut hold the values below the next split
            cut = np.nextafter(splits[columns[f]][int(np.floor(cut)) + 1], -np.inf)
        low, high = bounds.get(f, (-np.inf, np.inf))
        walk(tree, node["leftChild"], {**bounds, f: (low, min(high, cut))})
        walk(tree, node["rightChild"], {**bounds, f: (max(low, cut), high)})

    for tree in sorted({t for t, _ in nodes}):
        walk(tree, 0, {})
    width = max([1, *(len(b) for _, b in out)])
    feature, low, high = np.full((len(out), width), -1), np.zeros((len(out), width)), np.zeros((len(out), width))
    for i, (_, bounds) in enumerate(out):
        for k, (f, (a, b)) in enumerate(bounds.items()):
            feature[i, k], low[i, k], high[i, k] = f, a, b
    return Paths(np.array([v for v, _ in out]), feature, low, high, boosted)


def _weights(width: int) -> tuple[np.ndarray, np.ndarray]:
    """Share of a feature that fits for the row alone, and of one that fits for the background alone, by (a, b): how
    many features of either kind there are."""
    plus, minus = np.zeros((width + 1, width + 1)), np.zeros((width + 1, width + 1))
    for a in range(width + 1):
        for b in range(width + 1 - a):
            if a:
                plus[a, b] = factorial(a - 1) * factorial(b) / factorial(a + b)
            if b:
                minus[a, b] = -factorial(a) * factorial(b - 1) / factorial(a + b)
    return plus, minus


def contributions(paths: Paths, x: np.ndarray, background: np.ndarray) -> np.ndarray:
    """Contribution of each feature to the probability of each row, on average over the background."""
    m, width = len(background), paths.feature.shape[1]
    plus, minus = _weights(width)
    if not paths.link:
        out = np.zeros_like(x, dtype=np.float64)
        for leaf, v in enumerate(paths.value):
            n = int((paths.feature[leaf] >= 0).sum())
            full = (1 << n) - 1
            z, times = np.unique(paths.fits(background, leaf), return_counts=True)
            masks, back = np.unique(paths.fits(x, leaf), return_inverse=True)
            covers = (masks[:, None] | z[None, :]) == full
            a, b = np.bitwise_count(masks[:, None] & ~z[None, :]), np.bitwise_count(z[None, :] & ~masks[:, None])
            up, down = plus[a, b] * covers * times, minus[a, b] * covers * times
            for k in range(n):
                own, other = (masks[:, None] >> k & 1).astype(bool), (z[None, :] >> k & 1).astype(bool)
                each = np.where(own & ~other, up, np.where(other & ~own, down, 0.0)).sum(1)
                out[:, paths.feature[leaf, k]] += v / m * each[back]
        return out
    each = np.zeros((len(x), m, x.shape[1]))
    for leaf, v in enumerate(paths.value):
        n = int((paths.feature[leaf] >= 0).sum())
        full = (1 << n) - 1
        z, zback = np.unique(paths.fits(background, leaf), return_inverse=True)
        masks, back = np.unique(paths.fits(x, leaf), return_inverse=True)
        covers = (masks[:, None] | z[None, :]) == full
        a, b = np.bitwise_count(masks[:, None] & ~z[None, :]), np.bitwise_count(z[None, :] & ~masks[:, None])
        up, down = plus[a, b] * covers * v, minus[a, b] * covers * v
        for k in range(n):
            own, other = (masks[:, None] >> k & 1).astype(bool), (z[None, :] >> k & 1).astype(bool)
            each[:, :, paths.feature[leaf, k]] += np.where(own & ~other, up, np.where(other & ~own, down, 0.0))[back][:, zback]
    # a margin's contributions, on the scale of the probability for each pair of rows
    mx, mz = paths.margins(x), paths.margins(background)
    gap = mx[:, None] - mz[None, :]
    px, pz = paths.probabilities(mx), paths.probabilities(mz)
    slope = np.where(np.abs(gap) > 1e-12, (px[:, None] - pz[None, :]) / np.where(np.abs(gap) > 1e-12, gap, 1.0), 2 * px[:, None] * (1 - px[:, None]))
    return (each * slope[:, :, None]).mean(1)


def with_cell(df: DataFrame, tables: Sequence[Paths], names: Sequence[str]) -> DataFrame:
    """df with _cell: between which cuts of the models each column lies. No model can tell rows of a cell apart."""
    cuts = {}
    for i, c in enumerate(names):
        bounds = [b[p.feature == i] for p in tables for b in (p.low, p.high)]
        points = np.unique(np.concatenate(bounds))
        if (points := points[np.isfinite(points)]).size:
            cuts[c] = [-np.inf, *(float(x) for x in np.nextafter(points, np.inf)), np.inf]  # a bucket holds its lower end, a range its upper
    bins = [f"_bin{i}" for i in range(len(cuts))]
    if cuts:
        df = Bucketizer(splitsArray=list(cuts.values()), inputCols=list(cuts), outputCols=bins, handleInvalid="keep").transform(df)
    return df.withColumn("_cell", F.concat_ws(",", *(F.col(b).cast("int").cast("string") for b in bins))).drop(*bins)


def tree_contributions(models: Sequence[PipelineModel], rows: DataFrame, background: DataFrame, columns: Sequence[str], most: int = 100, key: str = "project_key", batch: int = 500) -> DataFrame:
    """(key, feature, contribution, raw_value) in long form: the mean of the models' contributions for each row and column.

    Rows that no model can tell apart are worked out once, so that work grows with the cells between the models' cuts.
    background is bounded: its first `most` rows in hash order of the key. Models take `columns` in this order as features."""
    tables = [paths_of(m) for m in models]
    names = list(columns)
    known = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in names]
    some = background.orderBy(F.xxhash64(key), key).limit(most).select(*known).toPandas().to_numpy(np.float64)
    if not len(some):
        raise ValueError("contributions need a background")
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((tables, some))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        paths, back = shared.value
        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                x = part[names].to_numpy(np.float64)
                mean = sum(contributions(p, x, back) for p in paths) / len(paths)
                yield pd.DataFrame({"_cell": part["_cell"].to_numpy(), "_made": list(mean)})

    marked = with_cell(rows.select(key, *known), tables, names)
    some_of_each = marked.groupBy("_cell").agg(*(F.min(c).alias(c) for c in names)).repartition(2 * spark.sparkContext.defaultParallelism)
    made = reread(some_of_each.mapInPandas(run, "_cell string, _made array<double>"), "contributions")
    cells = F.arrays_zip(F.array(*map(F.lit, names)).alias("feature"), F.col("_made").alias("contribution"), F.array(*(F.col(f"`{c}`") for c in names)).alias("raw_value"))
    return marked.join(made, "_cell").select(key, F.inline(cells).alias("feature", "contribution", "raw_value"))
