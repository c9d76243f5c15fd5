"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest
from spindrift.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    if name not in ORACLE_SQL:
        return
    found = duck.execute(ORACLE_SQL[name])
    other, columns = found.fetchall(), [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in sorted(columns)) for r in rows), key=repr)
    theirs = sorted((tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in other), key=repr)
    assert mine == theirs


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).schema
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
