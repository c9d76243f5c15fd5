"""Registered queries against their SQL on tables that are larger than the smallest, or that have what these lack."""

import duckdb
import pytest
from pyspark.sql import functions as F
from spindrift.operators import postings
from spindrift.operators.catalog import Store
from spindrift.plans.queries import ORACLE_SQL, QUERIES

from .test_queries import TABLES, plain

DATA = "/root/testdata/sf0.01"


@pytest.fixture
def tables(tmp_path):
    """(folder, con): a folder of sf0.01's tables, and views of them; a test may put another table over one of them."""
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        (tmp_path / f"{t}.parquet").symlink_to(f"{DATA}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    return tmp_path, con


def replaced(tables, name, sql):
    folder, con = tables
    (folder / f"{name}.parquet").unlink()
    con.execute(f"copy ({sql}) to '{folder}/{name}.parquet' (format parquet)")


def same_as_sql(spark, tables, name):
    folder, con = tables
    df = QUERIES[name](spark, str(folder))
    found = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert mine == sorted((tuple(map(plain, r)) for r in found.fetchall()), key=repr)
    return mine


def test_the_best_are_those_of_the_rounded_scores(spark, tmp_path):
    """Scores that differ beyond the digits asked for are equal, so the smaller key goes first, in a slot of lower bound too."""
    docs = spark.range(4000).select("id", F.concat(F.lit("common "), F.repeat(F.lit("pad "), (50 - F.col("id") / 80).cast("int"))).alias("text"))
    store = Store(spark, f"file://{tmp_path}/ix")
    store.commit(postings.relations_of({"t": postings.word_lists(docs, "id", None, ["text"], stemmed=False)}))
    ix = postings.TextIndex({n: store.read(n) for n in postings.RELATIONS})
    every = sorted(((-round(r["score"], 6), r["key"]) for r in ix.scores("t", ["common"]).collect()))
    assert [r["key"] for r in ix.scores("t", ["common"], 30, digits=6).collect()] == [k for _, k in every[:30]]


def test_context_symbol_of_a_name_that_a_class_has(spark, tables):
    """The first symbol of the first method's name is a class."""
    replaced(tables, "part", f"select * replace (case when p_partkey = 100 then (select p_name from '{DATA}/part.parquet' where p_partkey = 3) else p_name end as p_name) from '{DATA}/part.parquet'")
    assert ("symbol" in {r[0] for r in same_as_sql(spark, tables, "context_symbol")})


def test_sources_of_one_task_are_parsed_in_many(spark):
    from spindrift.sources import files as source_files

    made = spark.range(400).coalesce(1).selectExpr("concat('m_', id, '.py') AS rel_path", "concat('def f_', id, '(): pass') AS content")
    parsed = source_files.parse(made)["symbols"].select("name", F.spark_partition_id().alias("p")).collect()
    assert len(parsed) == 400 and len({r["p"] for r in parsed}) == 4
