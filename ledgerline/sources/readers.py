"""Readers of ledger tables: CSV with checked columns, JSON cubes, staged Parquet."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require(df: DataFrame, columns: Iterable[str], name: str = "table") -> DataFrame:
    """df, if it has all columns; an error that names the missing ones otherwise."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{name} lacks columns: {', '.join(missing)}")
    return df


def read_sheet(spark: SparkSession, path: str, columns: Iterable[str], name: str = "sheet") -> DataFrame:
    """A sheet saved as CSV with a header, all text, with its required columns checked."""
    return require(spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path), columns, name)


def read_import(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV upload with bad lines kept in _bad."""
    full = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    return spark.read.schema(full).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("quote", '"').option("escape", '"').csv(path)


def prune(df: DataFrame) -> DataFrame:
    """Trim headers, drop columns with a blank name or only nulls, and rows of only nulls. One pass over df."""
    named = df.toDF(*[c.strip() or f"_blank{i}" for i, c in enumerate(df.columns)])
    named = named.select([c for c in named.columns if not c.startswith("_blank")])
    filled = named.agg(*(F.count(F.col(f"`{c}`")).alias(c) for c in named.columns)).first().asDict()
    return named.select([f"`{c}`" for c in named.columns if filled[c]]).dropna(how="all")


def fold_in(base: DataFrame, extra: DataFrame, names: Mapping[str, str], tag: str, key: str) -> DataFrame:
    """base with rows of extra under base's names, tagged by source; rows of extra without a key are left out."""
    moved = extra.withColumnsRenamed(dict(names)).filter(F.col(key).isNotNull())
    moved = moved.select([c for c in moved.columns if c in base.columns]).withColumn("source_sheet", F.lit(tag))
    return base.withColumn("source_sheet", F.lit("core")).unionByName(moved, allowMissingColumns=True)


CUBE = "struct<id: array<string>, size: array<int>, value: array<double>, label: map<string, array<string>>>"


def unravel_cube(df: DataFrame, dims: list[str], payload: str = "payload") -> DataFrame:
    """Long rows of a flat-array cube, one column per dimension, the last of which varies fastest."""
    cube = df.withColumn("_cube", F.from_json(payload, CUBE)).drop(payload)
    rows = cube.select("*", F.posexplode("_cube.value").alias("_at", "value"))
    stride = F.lit(1)
    for k in range(len(dims) - 1, -1, -1):
        size = F.col("_cube.size")[k]
        place = F.pmod(F.floor(F.col("_at") / stride).cast("int"), size)
        rows = rows.withColumn(dims[k], F.element_at(F.col("_cube.label")[dims[k]], place + 1))
        stride = stride * size
    return rows.drop("_cube", "_at")
