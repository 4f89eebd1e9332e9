"""Every registered query with SQL, against DuckDB over the same tables."""

import math

import duckdb
import numpy as np
import pytest

from lamella.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="session")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return c


def normal(df):
    def value(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return repr(round(float(v), 6)) if isinstance(v, (float, np.floating)) else str(v)

    return sorted(tuple(map(value, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, sf_dir, con, name):
    mine = registry.QUERIES[name](spark, sf_dir).toPandas()
    other = con.execute(registry.SQL[name]).df()
    assert sorted(mine.columns) == sorted(other.columns)
    assert normal(mine) == normal(other)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0
