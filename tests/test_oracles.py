"""Every registered query with SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from ledgerline.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return v
    try:
        x = float(v)
        return "0" if x == 0 else f"{x:.9g}" if math.isfinite(x) else str(x)
    except (TypeError, ValueError):
        return str(v)


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)
    return sorted((tuple(map(cell, r)) for r in df.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck(data):
    db = duckdb.connect()
    for t in TABLES:
        if Path(f"{data}/{t}.parquet").exists():
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, data, duck, name):
    ours, theirs = registry.QUERIES[name](spark, data).toPandas(), duck.sql(registry.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_every_query_is_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert len(registry.QUERIES) > 120
