"""Every query with SQL gives what DuckDB gives on the same tables."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__
from parapet.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def norm(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    sql = duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(sql.columns)
    at = [sql.columns.index(c) for c in df.columns]
    assert Counter(tuple(map(norm, r)) for r in df.collect()) == Counter(tuple(norm(r[i]) for i in at) for r in sql.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 200
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
