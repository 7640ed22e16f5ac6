"""Features: dates, outliers, one-hot columns, imputation, scaling, splits, weights."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..schema import LABEL_PREFIXES, LABELS, OUTLIER_LEAST_ROWS, WET_MONTHS
from ..sources.sinks import reread

#: Columns made from the target; they never take part in imputation.
TARGET_COLUMNS = ("overrun", "overrun_pct", "actual_days", "standard_days")
#: Ranges to a unit of value, for exact quartiles.
RANGES = 256
#: Cluster of a place that has none.
UNCLUSTERED = "Unclustered"


def date_features(df: DataFrame, column: str, horizon: str) -> DataFrame:
    """Month, quarter, days to a horizon, and wet season (null if the date is)."""
    c = F.col(column)
    return df.withColumns({"month": F.month(c), "quarter": F.quarter(c), "days_to_horizon": F.datediff(F.lit(horizon).cast("date"), c.cast("date")), "wet_season": F.when(c.isNotNull(), F.month(c).isin(*WET_MONTHS).cast("int"))})


def quantiles(df: DataFrame, value: str, stratum: str, shares: Sequence[float], per_unit: int = RANGES) -> DataFrame:
    """Exact (stratum, n, q0, q1, ...) of a column by linear interpolation, for strata of any size.

    Values are counted first; counts by ranges, `per_unit` to a unit of value, tell which ranges hold the wanted ranks, and
    only values of these are put in order, range by range. So no stratum is sorted or held as a whole."""
    by_value = df.filter(F.col(value).isNotNull() & F.col(stratum).isNotNull()).groupBy(stratum, F.col(value).alias("v")).agg(F.count("*").alias("c")).withColumn("range", F.floor(F.col("v") * per_unit))
    in_order = Window.partitionBy(stratum).orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = by_value.groupBy(stratum, "range").agg(F.sum("c").alias("c")).withColumns({"upto": F.sum("c").over(in_order), "n": F.sum("c").over(Window.partitionBy(stratum))})
    place = [q * (F.col("n") - 1) for q in shares]
    ranks = [f(p) for p in place for f in (F.floor, F.ceil)]
    held = F.exists(F.array(*ranks), lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("c")))
    wanted = ranges.filter(held).select(stratum, "range", "n", (F.col("upto") - F.col("c")).alias("before"))
    inside = Window.partitionBy(stratum, "range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    near = by_value.join(wanted, [stratum, "range"]).withColumn("upto", F.col("before") + F.sum("c").over(inside))
    at = near.groupBy(stratum).agg(F.max("n").alias("n"), *(F.min(F.when(F.col("upto") > r, F.col("v"))).alias(f"v{i}") for i, r in enumerate(ranks)))
    between = lambda low, high, p: F.col(low) + (F.col(high) - F.col(low)) * (p - F.floor(p))
    return at.select(stratum, "n", *(between(f"v{2 * i}", f"v{2 * i + 1}", p).alias(f"q{i}") for i, p in enumerate(place)))


def quartiles(df: DataFrame, value: str, stratum: str) -> DataFrame:
    """Exact (stratum, n, q1, q3)."""
    return quantiles(df, value, stratum, (0.25, 0.75)).select(stratum, "n", F.col("q0").alias("q1"), F.col("q1").alias("q3"))


def outliers(df: DataFrame, amount: str, stratum: str, least: int = OUTLIER_LEAST_ROWS) -> DataFrame:
    """Flag of log amounts outside 1.5 interquartile ranges of their stratum; small strata have none."""
    logged = df.withColumn("_log", F.log1p(F.greatest(F.col(amount), F.lit(0))))
    # a row a stratum, staged so that its size is known: a small table goes to the rows, which a join by few strata would gather in few tasks
    bounds = reread(quartiles(logged, "_log", stratum), "quartiles").select(stratum, F.col("n").alias("_n"), F.col("q1").alias("_q1"), F.col("q3").alias("_q3"))
    joined = logged.join(bounds, stratum, "left")
    width = 1.5 * (F.col("_q3") - F.col("_q1"))
    outside = (F.col("_log") < F.col("_q1") - width) | (F.col("_log") > F.col("_q3") + width)
    return joined.withColumn("outlier", F.coalesce((F.col("_n") >= least) & outside, F.lit(False))).drop("_log", "_n", "_q1", "_q3")


def one_hot(df: DataFrame, column: str, values: Sequence[str], with_null: bool = False) -> DataFrame:
    """A 0/1 column for each value, and one for null if asked."""
    made = {f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values}
    if with_null:
        made[f"{column}_null"] = F.col(column).isNull().cast("int")
    return df.withColumns(made)


def categories(df: DataFrame, columns: Sequence[str], least: int = 1) -> dict[str, list[str]]:
    """The values of each column that at least `least` rows have, in order: one pass, counted before they come to the driver.

    Meant for columns of few values, as each becomes a column."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns)))
    counted = df.select(cells.alias("x")).select("x.*").filter("value is not null").groupBy("name", "value").count().filter(F.col("count") >= least)
    out: dict[str, list[str]] = {c: [] for c in columns}
    for r in counted.orderBy("name", "value").collect():
        out[r["name"]].append(r["value"])
    return out


def one_hot_frame(df: DataFrame, columns: Sequence[str], with_null: Sequence[str] = (), least: int = 1, known: Mapping[str, Sequence[str]] | None = None) -> tuple[DataFrame, list[str]]:
    """df with 0/1 columns for the values that its columns have, and a null column for those in with_null; and their names.

    known: these values, where they are known already."""
    names = []
    for c, values in (categories(df, columns, least) if known is None else known).items():
        df = one_hot(df, c, values, c in with_null)
        names += [f"{c}_{v}" for v in values] + [f"{c}_null"] * (c in with_null)
    return df, names


def least_squares(moments: np.ndarray, y: int) -> np.ndarray:
    """Intercept and coefficients of a column on all others, from the sums of products of (1, columns); 0 for the column itself."""
    others = [i for i in range(len(moments)) if i != y + 1]
    out = np.zeros(len(moments))
    out[others] = np.linalg.lstsq(moments[np.ix_(others, others)], moments[others, y + 1], rcond=None)[0]
    return out


def bayesian_ridge(moments: np.ndarray, y: int, most: int = 300, tolerance: float = 1e-3, prior: float = 1e-6) -> np.ndarray:
    """As least_squares, with coefficients shrunk by a precision that is set from the data itself: precisions of the noise
    and of the coefficients are iterated to the highest evidence."""
    others = np.array([i for i in range(1, len(moments)) if i != y + 1])
    n = moments[0, 0]
    mean = moments[0] / n
    centred = moments - np.outer(mean, mean) * n
    gram, cross, total = centred[np.ix_(others, others)], centred[others, y + 1], max(centred[y + 1, y + 1], 0.0)
    values, vectors = np.linalg.eigh(gram)
    values = np.maximum(values, 0.0)
    turned = vectors.T @ cross
    noise, own, last = 1.0 / (total / n + np.finfo(float).eps), 1.0, None
    for _ in range(most):
        w = vectors @ (turned / (values + own / noise))
        rest = max(total - 2 * w @ cross + w @ gram @ w, 0.0)
        gamma = (noise * values / (own + noise * values)).sum()
        own = (gamma + 2 * prior) / (w @ w + 2 * prior)
        noise = (n - gamma + 2 * prior) / (rest + 2 * prior)
        if last is not None and np.abs(last - w).sum() < tolerance:
            break
        last = w
    w = vectors @ (turned / (values + own / noise))
    out = np.zeros(len(moments))
    out[others] = w
    out[0] = mean[y + 1] - w @ mean[others]
    return out


def impute(df: DataFrame, columns: Sequence[str], rounds: int = 15, barred: Sequence[str] = TARGET_COLUMNS, fit: Callable[[np.ndarray, int], np.ndarray] = bayesian_ridge) -> DataFrame:
    """df with <column>_full for each of the columns: missing values by chained regression on the other columns.

    Means stand in at first. In each round each column in turn is fitted on all others, where it is known, and its missing
    values are set from the fit. Columns made from the target are barred, even if asked for, and columns without any
    value stay null.

    What a row's missing values are set to is linear in its known ones, in every round, by a map that rows with the same
    missing columns share. So sums of products by pattern of missing columns are all that the rounds need: two aggregates
    in all, whatever the number of rounds and columns, and one join with the maps."""
    asked = [c for c in columns if c not in barred]
    mean = df.agg(*(F.avg(c).alias(c) for c in asked)).first().asDict() if asked else {}
    known = [c for c in asked if mean[c] is not None]
    if len(known) < 2:
        return df.withColumns({f"{c}_full": F.coalesce(F.col(c).cast("double"), F.lit(mean[c])) for c in asked})
    k = len(known)
    z = [F.lit(1.0), *(F.coalesce(F.col(c).cast("double") - F.lit(float(mean[c])), F.lit(0.0)) for c in known)]
    pattern = F.concat(*(F.when(F.col(c).isNull(), "1").otherwise("0") for c in known))
    pairs = [(i, j) for i in range(k + 1) for j in range(i + 1)]
    sums = df.groupBy(pattern.alias("pattern")).agg(*(F.sum(z[i] * z[j]).alias(f"s{i}_{j}") for i, j in pairs)).collect()  # a row for each pattern of missing columns
    moments, maps = {}, {}
    for r in sums:
        m = np.zeros((k + 1, k + 1))
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"s{i}_{j}"]
        moments[r["pattern"]] = m
        maps[r["pattern"]] = np.eye(k + 1) * np.array([1.0, *(x == "0" for x in r["pattern"])])  # full row from (1, known values)
    for _ in range(rounds):
        for c in range(k):
            total = sum(maps[p] @ moments[p] @ maps[p].T for p in maps if p[c] == "0")
            line = fit(total, c)
            for p in maps:
                if p[c] == "1":
                    maps[p][c + 1] = line @ maps[p]
    rows = [(p, [[float(x) for x in maps[p][c + 1]] for c in range(k)]) for p in maps]
    table = df.sparkSession.createDataFrame(rows, "_pattern string, _maps array<array<double>>")
    out = df.withColumn("_pattern", pattern).join(F.broadcast(table), "_pattern")
    full = lambda c: sum((F.col("_maps")[c][i] * x for i, x in enumerate(z)), F.lit(float(mean[known[c]])))
    made = {f"{name}_full": F.coalesce(F.col(name).cast("double"), full(c)) for c, name in enumerate(known)}
    made |= {f"{c}_full": F.lit(None).cast("double") for c in asked if c not in known}
    return out.withColumns(made).select(*df.columns, *(f"{c}_full" for c in asked))


def bucket(key: Column | str, n: int = 100) -> Column:
    """Bucket of a key by its MD5, the same in any engine and for any order of rows."""
    return F.pmod(F.conv(F.left(F.md5(F.col(key).cast("string") if isinstance(key, str) else key), F.lit(8)), 16, 10).cast("bigint"), F.lit(n)).cast("int")


def split(df: DataFrame, key: str, test: int = 30) -> DataFrame:
    """Train or test by key, so all rows of a key are on one side."""
    return df.withColumn("split", F.when(bucket(key) < test, "test").otherwise("train"))


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: minimum and maximum of each column."""
    return df.agg(*(F.struct(F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")).alias(c) for c in columns))


def scale(df: DataFrame, scaler: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns to 0..1 by a fitted scaler, clipped; a constant becomes 0 and null stays null."""
    joined = df.crossJoin(F.broadcast(scaler.select(*(F.col(c).alias(f"_{c}") for c in columns))))
    out = {}
    for c in columns:
        span = F.col(f"_{c}.max") - F.col(f"_{c}.min")
        x = (F.col(c) - F.col(f"_{c}.min")) / F.when(span == 0, 1.0).otherwise(span)
        out[c] = F.when(F.col(c).isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))
    return joined.withColumns(out).drop(*(f"_{c}" for c in columns))


def unscale(df: DataFrame, scaler: DataFrame, columns: Sequence[str]) -> DataFrame:
    joined = df.crossJoin(F.broadcast(scaler.select(*(F.col(c).alias(f"_{c}") for c in columns))))
    return joined.withColumns({c: F.col(c) * (F.col(f"_{c}.max") - F.col(f"_{c}.min")) + F.col(f"_{c}.min") for c in columns}).drop(*(f"_{c}" for c in columns))


def varying(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with more than one value, nulls aside. One pass."""
    row = df.agg(*(x for c in columns for x in (F.min(c).alias(f"{c}_0"), F.max(c).alias(f"{c}_1")))).first()
    return [c for c in columns if row[f"{c}_0"] != row[f"{c}_1"]]


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight of each class, and the ratio of negatives to positives. Totals are taken over the few classes."""
    counted = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    of = lambda y: F.sum(F.when(F.col(label) == y, F.col("n")).otherwise(0)).over(every)
    return counted.select(label, "n", (F.sum("n").over(every) / (2 * F.col("n"))).alias("weight"), (of(0) / of(1)).alias("positive_ratio"))


def clusters(df: DataFrame, table: DataFrame, key: str = "municipality") -> DataFrame:
    """Cluster of a municipality, Unclustered if it has none."""
    return df.join(table.withColumnRenamed("cluster", "_cluster"), key, "left").withColumn("cluster", F.coalesce("_cluster", F.lit(UNCLUSTERED))).drop("_cluster")


def check_folds(df: DataFrame, label: str, k: int) -> None:
    """An error if a class has fewer rows than folds, so that some fold would lack it."""
    small = df.groupBy(label).agg(F.count("*").alias("n")).filter(F.col("n") < k).orderBy(label).collect()
    if small:
        raise ValueError(f"{k} folds need {k} rows of each class; too few: " + ", ".join(f"{r[label]} ({r['n']})" for r in small))


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5) -> DataFrame:
    """Fold 0..k-1 of each row, dealt evenly in each class in MD5 order of its key; classes smaller than k are refused.

    Rows are ranked inside MD5 lanes of their class, so a large class is spread; a lane's fold begins where the lane
    before it ended."""
    check_folds(df, label, k)
    lane = bucket(key, 256)
    laned = df.withColumn("_lane", lane)
    sizes = laned.groupBy(label, "_lane").agg(F.count("*").alias("_c"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_c").over(Window.partitionBy(label).orderBy("_lane").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    nth = F.row_number().over(Window.partitionBy(label, "_lane").orderBy(F.md5(F.col(key).cast("string")), key)) - 1
    return laned.withColumn("_nth", nth).join(before, [label, "_lane"]).withColumn("fold", F.pmod(F.col("_before") + F.col("_nth"), F.lit(k)).cast("int")).drop("_lane", "_nth", "_before")


def label_of(feature: Column | str, prefixes: Mapping[str, str] = LABEL_PREFIXES, exact: Mapping[str, str] = LABELS) -> Column:
    """Readable label of a feature's name: by its prefix, else an exact table, else its words as a title; null for null."""
    c = text.col(feature)
    words = lambda x: F.trim(F.replace(x, F.lit("_"), F.lit(" ")))
    out = F.coalesce(text.lookup(c, exact), text.title(words(c)))
    for prefix, name in reversed(prefixes.items()):
        out = F.when(c.startswith(prefix), F.concat(F.lit(f"{name}: "), words(c.substr(len(prefix) + 1, 1_000_000)))).otherwise(out)
    return out
