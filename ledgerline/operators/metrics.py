"""Binary classification metrics over prediction tables (y, p)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Ranges of scores that the running sum of the ROC curve is split into.
RANGES = 1024


def confusion(df: DataFrame, cut: float = 0.5) -> DataFrame:
    said = F.col("p") >= cut
    return df.filter("y is not null and p is not null").agg(F.count_if((F.col("y") == 1) & said).alias("tp"), F.count_if((F.col("y") == 0) & said).alias("fp"), F.count_if((F.col("y") == 1) & ~said).alias("fn"), F.count_if((F.col("y") == 0) & ~said).alias("tn"))


def evaluate(df: DataFrame, cut: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall and F1 at a cut, 0 where undefined, to four places."""
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    c = confusion(df, cut)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(F.round(rate(tp + tn, tp + fp + fn + tn), 4).alias("accuracy"), F.round(rate(tp, tp + fp), 4).alias("precision"), F.round(rate(tp, tp + fn), 4).alias("recall"), F.round(rate(2 * tp, 2 * tp + fp + fn), 4).alias("f1"))


def auc(df: DataFrame) -> DataFrame:
    """Area under the ROC curve by mid-ranks; null if there is one class only.

    Scores are counted by value, and values fall into RANGES ranges: the running sum over ranges is short, and those
    inside the ranges are apart, so continuous scores don't all meet in one task."""
    by_score = df.filter("y is not null and p is not null").groupBy("p").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    by_score = by_score.withColumn("range", F.floor(F.least(F.greatest("p", F.lit(0.0)), F.lit(1.0)) * RANGES))
    ahead = lambda w: F.coalesce(F.sum("neg").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = by_score.groupBy("range").agg(F.sum("neg").alias("neg")).select("range", ahead(Window.orderBy("range")).alias("before"))
    below = F.col("before") + ahead(Window.partitionBy("range").orderBy("p"))
    won = by_score.join(before, "range").withColumn("won", F.col("pos") * (below + F.col("neg") / 2))
    total = won.agg(F.sum("won").alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return total.select(F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("won") / F.col("pos") / F.col("neg")).alias("auc"))


def label_rates(df: DataFrame, flag: str, label: str) -> DataFrame:
    return df.filter(F.col(label).isNotNull()).groupBy(flag).agg(F.count("*").alias("n"), F.round(F.avg(label), 6).alias("rate"))


def aligned(a: DataFrame, b: DataFrame, key: str = "project_key") -> tuple[DataFrame, DataFrame]:
    """Rows of both predictions, and one row: rows dropped on either side, and keys whose labels differ."""
    both = a.join(b.withColumnRenamed("y", "y2"), key)
    dropped = a.join(b, key, "left_anti").agg(F.count("*").alias("only_left")).crossJoin(b.join(a, key, "left_anti").agg(F.count("*").alias("only_right")))
    return both.drop("y2"), dropped.crossJoin(both.agg(F.count_if(F.col("y") != F.col("y2")).alias("differ")))


def summary(models: dict[str, DataFrame]) -> DataFrame:
    """A metric row per model with its confusion matrix; an error if there is none."""
    if not models:
        raise ValueError("no model has predictions")
    out = None
    for name, df in models.items():
        row = evaluate(df).crossJoin(auc(df).select(F.round("auc", 4).alias("auc"))).crossJoin(confusion(df)).withColumn("model", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out
