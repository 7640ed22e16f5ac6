"""Table models: text classifier, base learners, out-of-fold predictions, stacker, scoring, contributions."""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, CountVectorizer, CountVectorizerModel, ElementwiseProduct, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..schema import CONFIDENCE
from ..sources.sinks import reread


def assembler(columns: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="keep")


def feature_columns(df: DataFrame, deny: Sequence[str]) -> list[str]:
    """Numeric columns that are neither identifiers nor made from the label, in name order."""
    numeric = ("int", "bigint", "double", "float", "smallint", "tinyint")
    return sorted(c for c, kind in df.dtypes if kind in numeric and c not in deny)


def feature_matrix(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, x): the columns as doubles in the given order, those that df lacks as 0 and missing values as 0."""
    return df.select(key, F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0) for c in columns)).alias("x"))


def cut_points(df: DataFrame, columns: Sequence[str], bins: int = 32) -> dict[str, list[float]]:
    """Quantiles of continuous columns between which tree learners cut, as many as they take by default. All rows are read; ranks are true to 0.1 %."""
    found = df.approxQuantile(list(columns), [i / bins for i in range(1, bins)], 0.001)
    return {c: sorted(set(q)) for c, q in zip(columns, found, strict=True) if q}


def binning(cuts: Mapping[str, Sequence[float]]) -> Bucketizer:
    """Columns <name>_cut: how many cuts are at most the value; unknown values have a bin of their own."""
    splits = [[-float("inf"), *points, float("inf")] for points in cuts.values()]
    return Bucketizer(splitsArray=splits, inputCols=list(cuts), outputCols=[f"{c}_cut" for c in cuts], handleInvalid="keep")


def binned(columns: Sequence[str], cuts: Mapping[str, Sequence[float]]) -> list:
    """Stages that make features of columns, those with cuts by their bins <name>_bin, as numbers and not as categories; unknown values come last."""
    numbers = ", ".join(f"coalesce(`{c}_cut`, {len(points) + 1}) + 0.0D AS `{c}_bin`" for c, points in cuts.items())
    return [*([binning(cuts), SQLTransformer(statement=f"SELECT *, {numbers} FROM __THIS__")] if cuts else []), assembler([f"{c}_bin" if c in cuts else c for c in columns])]


def cells(df: DataFrame, columns: Sequence[str], cuts: Mapping[str, Sequence[float]], by: Sequence[str] = ("y", "fold")) -> DataFrame:
    """Rows that learners of binned features can't tell apart, as one row with the sum of their weights.

    All rows count, but what the learners read grows with the combinations of bins and categories, not with the rows.
    Bootstraps and subsamples then draw cells of a fold."""
    made = binning(cuts).transform(df) if cuts else df
    keys = [*by, *(f"{c}_cut" if c in cuts else c for c in columns)]
    return made.groupBy(*keys).agg(F.sum("weight").alias("weight"), *(F.min(c).alias(c) for c in cuts)).select(*by, "weight", *columns)


def forest(trees: int = 300, depth: int = 8) -> RandomForestClassifier:
    return RandomForestClassifier(labelCol="y", weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=3, seed=42)


def boosted(rounds: int = 300, depth: int = 4) -> GBTClassifier:
    return GBTClassifier(labelCol="y", weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=42)


def sequence_learner(width: int, rounds: int = 60) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(labelCol="y", layers=[width, 16, 2], maxIter=rounds, seed=42)


def stacker() -> LogisticRegression:
    return LogisticRegression(labelCol="y", weightCol="weight", regParam=0.0)


def with_weights(df: DataFrame, copies: Column | None = None) -> DataFrame:
    """Balanced weights of labels y; copies: how many rows a row stands for."""
    times = F.lit(1) if copies is None else copies
    total = df.agg(F.sum(times).alias("_n"), F.sum(F.when(F.col("y") == 1, times).otherwise(0)).alias("_p"))
    share = F.when(F.col("y") == 1, F.col("_p")).otherwise(F.col("_n") - F.col("_p"))
    return df.crossJoin(F.broadcast(total)).withColumn("weight", times * F.col("_n") / (2 * share)).drop("_n", "_p")


def balanced(df: DataFrame, key: str) -> DataFrame:
    """Rows of the smaller class repeated by whole times, for learners without weights."""
    n = {r["y"]: r["n"] for r in df.groupBy("y").agg(F.count("*").alias("n")).collect()}
    top = max(n.values())
    times = F.lit(1)
    for y, c in n.items():
        times = F.when(F.col("y") == y, top // c).otherwise(times)
    return df.withColumn("_t", F.explode(F.sequence(F.lit(1), times))).drop("_t")


def probability(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")


def fit_all(jobs: Mapping[Any, Callable[[], Any]], parallelism: int = 4, alone: Collection[Any] = ()) -> dict[Any, Any]:
    """Results of jobs that run side by side, as one fit seldom fills a cluster; the table that they read should be written.

    alone: keys of jobs that hold many rows while they run; one of them runs at a time, beside the others."""
    chains = [[key for key in jobs if key in alone], *([key] for key in jobs if key not in alone)]
    chains = [chain for chain in chains if chain]
    with ThreadPool(max(1, min(parallelism, len(chains)))) as pool:
        done = pool.map(inheritable_thread_target(SparkSession.active())(lambda chain: {key: jobs[key]() for key in chain}), chains, 1)
    return {key: result for part in done for key, result in part.items()}


def out_of_fold(df: DataFrame, make: Callable, name: str, k: int = 5, prepare: Callable[[DataFrame], DataFrame] = lambda x: x, parallelism: int = 4, learned: DataFrame | None = None) -> DataFrame:
    """Prediction of each row by a model fitted on the other folds. df is a written table with a column fold; fits run side by side.

    learned: cells of df, which are fitted instead of its rows."""
    source = df if learned is None else learned
    models = fit_all({fold: lambda fold=fold: make().fit(prepare(source.filter(F.col("fold") != fold))) for fold in range(k)}, parallelism)
    return reduce(DataFrame.unionByName, (probability(models[fold].transform(df.filter(F.col("fold") == fold)), name) for fold in range(k)))


def word_grams(words: Column, n: int) -> Column:
    """Runs of n words of an array of words."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " ")) if n > 1 else words


def char_grams(words: Column, n: int) -> Column:
    """Runs of n characters inside words, each with a space before and after it; never across words."""
    padded = F.filter(F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" "))), lambda w: F.length(w) >= n)
    return F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: w.substr(i, F.lit(n)))))


class Terms(Transformer):
    """Arrays w (words of two characters and more, and their runs) and c (characters' runs inside words) of column text."""

    def __init__(self, words: int = 2, low: int = 2, high: int = 4) -> None:
        super().__init__()
        self.words, self.low, self.high = words, low, high

    def _transform(self, df: DataFrame) -> DataFrame:
        lower = F.lower(F.coalesce("text", F.lit("")))
        df = df.withColumn("_w", F.regexp_extract_all(lower, F.lit(r"(?U)\b\w\w+\b"), F.lit(0))).withColumn("_c", F.filter(F.split(lower, r"(?U)\s+"), lambda w: w != ""))
        runs = [F.when(F.size("_w") >= n, word_grams(F.col("_w"), n)).otherwise(F.array().cast("array<string>")) for n in range(1, self.words + 1)]
        chars = [char_grams(F.col("_c"), n) for n in range(self.low, self.high + 1)]
        return df.withColumns({"w": F.concat(*runs), "c": F.concat(*chars)}).drop("_w", "_c")


#: What a sparse vector is made of.
PARTS = "v struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"


def parts_of(vector: Column) -> Column:
    """A vector as a struct of its parts, without a Python worker: vectors have no casts, but go through JSON as what they are."""
    return F.from_json(F.to_json(F.struct(vector.alias("v"))), PARTS)["v"]


def vector_of(size: Column, indices: Column, values: Column) -> Column:
    """A sparse vector of its parts."""
    parts = F.struct(F.lit(0).cast("tinyint").alias("type"), size.alias("size"), indices.alias("indices"), values.alias("values"))
    return F.from_json(F.to_json(F.struct(parts.alias("v"))), StructType([StructField("v", VectorUDT())]))["v"]


class Damped(Transformer):
    """<name>_f: (1 + log count) * (1 + inverse document frequency) of the counts <name>_n and their product <name>_i, made
    to unit length. All in the JVM."""

    def __init__(self, name: str = "w") -> None:
        super().__init__()
        self.name = name

    def _transform(self, df: DataFrame) -> DataFrame:
        made = df.withColumns({"_counts": parts_of(F.col(f"{self.name}_n")), "_scaled": parts_of(F.col(f"{self.name}_i"))})
        weights = F.zip_with("_counts.values", "_scaled.values", lambda n, x: (1 + F.log(n)) * (1 + x / n))
        made = made.withColumn("_weights", weights)
        made = made.withColumn("_norm", F.sqrt(F.aggregate("_weights", F.lit(0.0), lambda s, w: s + w * w)))
        unit = F.transform("_weights", lambda w: F.when(F.col("_norm") > 0, w / F.col("_norm")).otherwise(w))
        vector = vector_of(F.col("_counts.size"), F.col("_counts.indices"), unit)
        size = df.schema[f"{self.name}_n"].metadata
        return made.withColumn(f"{self.name}_f", vector.alias(f"{self.name}_f", metadata=size)).drop("_counts", "_scaled", "_weights", "_norm")


class Frequencies(Estimator):
    """What makes features <name>_f of the term arrays <name>: as many terms as a CountVectorizer keeps, the most frequent
    ones, and their smoothed inverse document frequency. A row with a column copies stands for so many rows."""

    def __init__(self, name: str = "w", size: int = 1 << 18) -> None:
        super().__init__()
        self.name, self.size = name, size

    def _fit(self, df: DataFrame) -> PipelineModel:
        copies, name = F.col("copies") if "copies" in df.columns else F.lit(1), self.name
        one = lambda terms, n, rows: F.transform(terms, lambda t: F.struct(t.alias("t"), n.alias("n"), rows.alias("rows")))
        none = F.lit(0).cast("long")
        df = df.select(name, copies.cast("long").alias("copies")).filter("copies > 0")
        each = df.select(F.explode(F.concat(one(F.col(name), F.col("copies"), none), one(F.array_distinct(name), none, F.col("copies")))).alias("x")).select("x.*")
        total = df.agg(F.sum("copies").alias("all"))
        kept = each.groupBy("t").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows")).orderBy(F.col("n").desc(), "t").limit(self.size)
        kept = reread(kept.crossJoin(F.broadcast(total)).select("t", F.log((F.col("all") + 1) / (F.col("rows") + 1)).alias("idf")), "terms")
        found = {r["t"]: r["idf"] for r in kept.collect()} or {"": 0.0}
        # a vocabulary moves to the JVM a term a call, so a model learns it there
        counts = CountVectorizer(inputCol=name, outputCol=f"{name}_n", vocabSize=self.size).fit(kept.select(F.array("t").alias(name))) if len(found) > 1 else CountVectorizerModel.from_vocabulary(list(found), name, f"{name}_n")
        scales = [found[t] for t in counts.vocabulary]
        scaled = ElementwiseProduct(scalingVec=Vectors.dense(scales), inputCol=f"{name}_n", outputCol=f"{name}_i")
        return PipelineModel([counts, scaled, Damped(name)])


def damped_terms() -> list:
    """Stages that make features of the term arrays w and c."""
    return [Frequencies("w"), Frequencies("c"), assembler(["w_f", "c_f"])]


def text_regression(n: int, strength: float = 2.0) -> LogisticRegression:
    return LogisticRegression(labelCol="y", weightCol="weight", regParam=1 / (strength * max(n, 1)), standardization=False, maxIter=200)


def text_classifier(n: int, words: int = 2, chars: tuple[int, int] = (2, 4), strength: float = 2.0) -> Pipeline:
    """Runs of words and of characters inside words, with damped counts times smoothed inverse document frequency and unit
    length for each of the two, into a balanced logistic regression. Input columns text, y, weight; n is the number of
    rows fitted, by which the inverse penalty `strength` is divided."""
    return Pipeline(stages=[Terms(words, *chars), *damped_terms(), text_regression(n, strength)])


def classified_texts(df: DataFrame, learned: Column, name: str = "p") -> DataFrame:
    """df with the probability of the text classifier fitted on its learned rows; columns text and y.

    Each text is read once, however many rows have it: terms and features are made of the distinct texts and written once,
    and the regression learns from (text, y) with the sum of the weights, which is the same loss as that of the rows."""
    spark = df.sparkSession
    files = 2 * spark.sparkContext.defaultParallelism  # a short text costs much for its bytes
    df = df.withColumn("_text", F.coalesce("text", F.lit("")))
    times = [F.count_if(learned & (F.col("y") == y)).alias(f"_n{y}") for y in (0, 1)]
    texts = df.groupBy(F.col("_text").alias("text")).agg(*times).withColumn("copies", F.col("_n0") + F.col("_n1"))
    texts = reread(Terms().transform(texts.repartition(files)), "texts")
    made = reread(Pipeline(stages=damped_terms()).fit(texts).transform(texts).select("text", "_n0", "_n1", "features"), "text-features")
    sides = F.array(*(F.struct(F.lit(y).alias("y"), F.col(f"_n{y}").alias("copies")) for y in (0, 1)))
    rows = made.select("features", F.explode(sides).alias("x")).select("features", "x.*").filter("copies > 0")
    n = rows.agg(F.sum("copies")).first()[0]
    fitted = text_regression(n or 0).fit(with_weights(rows, F.col("copies")))
    scored = reread(probability(fitted.transform(made), name).select(F.col("text").alias("_text"), name), "text-scores")
    return df.join(scored, "_text").drop("_text")


def gated(rule: Column, predicted: Column, confidence: Column, least: float = CONFIDENCE) -> tuple[Column, Column]:
    """Label where a rule left none and the model is sure enough, and where it came from."""
    sure = rule.isNull() & (confidence >= least)
    return F.coalesce(rule, F.when(sure, predicted)), F.when(rule.isNotNull(), "rule").when(sure, "model").otherwise("none")


def fallback(p1: Column, p2: Column, p3: Column) -> Column:
    """The stacked probability, or the mean of the two tree models where it is missing."""
    return F.coalesce(p3, (p1 + p2) / 2)


def predicted(df: DataFrame, base: Mapping[str, PipelineModel], optional: str | None = None, known: Column | None = None) -> DataFrame:
    """Probabilities of all base models, a column each; that of the optional one is the mean of the others where it isn't known."""
    for name, model in base.items():
        df = probability(model.transform(df), name).select(*df.columns, name)
    if optional is not None:
        others = [F.col(name) for name in base if name != optional]
        df = df.withColumn(optional, F.when(known, F.col(optional)).otherwise(sum(others[1:], others[0]) / len(others)))
    return df


def fit_folds(df: DataFrame, learners: Mapping[str, Callable], k: int = 5, prepare: Mapping[str, Callable] | None = None, parallelism: int = 4, learned: Mapping[str, DataFrame] | None = None, whole: bool = False) -> dict[tuple, PipelineModel]:
    """Models by (fold, name), each fitted on the other folds; whole: those of all folds too, by (None, name).

    Learners of rows hold these in memory, so they are fitted one after another; those of cells run side by side."""
    own = lambda name, rows: (prepare or {}).get(name, lambda x: x)(rows)
    source = {name: (learned or {}).get(name, df) for name in learners}
    rest = lambda fold, name: source[name] if fold is None else source[name].filter(F.col("fold") != fold)
    keys = [(fold, name) for fold in [*range(k), *([None] if whole else [])] for name in learners]
    jobs = {(fold, name): lambda fold=fold, name=name: learners[name]().fit(own(name, rest(fold, name))) for fold, name in keys}
    return fit_all(jobs, parallelism, [key for key in keys if key[1] not in learned] if learned else ())


def stack(df: DataFrame, learners: dict[str, Callable], k: int = 5, prepare: dict[str, Callable] | None = None, optional: str | None = None, known: Column | None = None, parallelism: int = 4, learned: Mapping[str, DataFrame] | None = None, fitted: Mapping[tuple, PipelineModel] | None = None) -> tuple[DataFrame, PipelineModel]:
    """Out-of-fold probabilities of all base learners, a column each, and the stacker fitted on them.

    df has y, weight and fold; it is a written table, as each fold of each learner reads it, all side by side. prepare
    gives a learner's own handling of the rows it is fitted on, learned the cells of df that a learner is fitted on instead
    of rows; for the optional learner and known see predicted. fitted: the models of fit_folds, where they are made already."""
    fitted = fitted or fit_folds(df, learners, k, prepare, parallelism, learned)
    parts = (predicted(df.filter(F.col("fold") == fold), {name: fitted[fold, name] for name in learners}, optional, known) for fold in range(k))
    out = reread(reduce(DataFrame.unionByName, parts), "out-of-fold")
    return out, Pipeline(stages=[assembler(list(learners)), stacker()]).fit(out)


@dataclass
class Stack:
    """Base models by name, the stacker over them, and what their inputs need: columns, and the range of days of the train side."""

    base: dict[str, PipelineModel]
    meta: PipelineModel
    low: float
    high: float
    optional: str = "p3"

    def save(self, path: str) -> None:
        for name, model in {**self.base, "meta": self.meta}.items():
            model.write().overwrite().save(f"{path}/{name}")
        spark = SparkSession.active()
        spark.createDataFrame([(list(self.base), self.low, self.high, self.optional)], "base array<string>, low double, high double, optional string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")

    @classmethod
    def load(cls, path: str) -> Stack:
        about = SparkSession.active().read.parquet(f"{path}/about").first()
        base = {name: PipelineModel.load(f"{path}/{name}") for name in about["base"]}
        return cls(base, PipelineModel.load(f"{path}/meta"), about["low"], about["high"], about["optional"])

    def score(self, df: DataFrame, known: Column) -> DataFrame:
        """df with the base probabilities and prob; known: whether the optional learner's input is there."""
        return probability(self.meta.transform(predicted(df, self.base, self.optional, known)), "prob").drop("features")


def score_open(df: DataFrame, models: dict[str, PipelineModel], meta: PipelineModel, tier: Callable[[str], Column], closed: Column, optional: str | None = None, known: Column | None = None) -> DataFrame:
    """Probabilities of all base models, the stacked one, its tier, and a flag for closed rows."""
    scored = probability(meta.transform(predicted(df, models, optional, known)), "prob").drop("features")
    return scored.withColumn("tier", tier("prob")).withColumn("excluded", closed)


def linear_contributions(df: DataFrame, coefficients: dict[str, float], key: str = "project_key") -> DataFrame:
    """Exact contributions of a linear score: coefficient times distance from the mean, as long rows."""
    means = df.agg(*(F.avg(c).alias(f"_{c}") for c in coefficients))
    cells = F.array(*(F.struct(F.lit(c).alias("feature"), (F.lit(w) * (F.col(c) - F.col(f"_{c}"))).alias("contribution"), F.col(c).cast("double").alias("raw_value")) for c, w in coefficients.items()))
    return df.crossJoin(F.broadcast(means)).select(key, F.explode(cells).alias("x")).select(key, "x.*")


def sampled_contributions(model: PipelineModel, rows: DataFrame, background: DataFrame, columns: Sequence[str], permutations: int = 4, key: str = "project_key") -> DataFrame:
    """Shapley contributions to a model's probability by sampled permutations against a bounded background.

    Each row, permutation and background row gives a walk that swaps in the row's values one by one; scores along the
    walk are one transform, and differences of neighbours average to contributions that add up to f(x) - mean f. A score
    counts for the column that led to it and against the next, so sums by row and column need no walk held together."""
    walks = rows.select(key, F.struct(*columns).alias("own")).crossJoin(F.broadcast(background.select(F.struct(*columns).alias("back")))).withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    order = F.array_sort(F.transform(F.array(*map(F.lit, columns)), lambda c: F.struct(F.xxhash64(c, F.col("perm"), F.col("back")).alias("h"), c.alias("c"))))
    steps = walks.withColumn("order", F.transform(order, lambda x: x["c"])).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(len(columns)))))
    mixed = {c: F.when(F.array_position("order", c) <= F.col("step"), F.col(f"own.{c}")).otherwise(F.col(f"back.{c}")) for c in columns}
    scored = probability(model.transform(steps.withColumns(mixed)), "f")
    sides = F.array(*(F.struct(F.get("order", F.col("step") - back).alias("feature"), F.lit(sign).alias("sign"), "f") for back, sign in ((1, 1), (0, -1))))
    moved = scored.select(key, F.explode(sides).alias("x")).select(key, "x.*").filter("feature is not null")
    return moved.groupBy(key, "feature").agg((F.sum(F.col("sign") * F.col("f")) / F.count_if(F.col("sign") > 0)).alias("contribution"))


def top_contributions(df: DataFrame, n: int = 8, key: str = "project_key") -> DataFrame:
    """The n largest contributions of each row by size, with direction and value."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.abs("contribution").desc(), "feature"))
    return df.withColumn("rank", rank).filter(F.col("rank") <= n).withColumn("direction", F.when(F.col("contribution") >= 0, "up").otherwise("down"))
