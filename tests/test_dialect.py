"""User rules in SQLite's dialect: the same rows as sqlite3 gives."""

import sqlite3

import pytest
from spindrift.functions.dialect import RuleSqlError, to_spark_sql
from spindrift.operators.index import Index
from spindrift.operators.rules import query_sql, try_rule

ROWS = [(1, 1, "run_a", 10, 35, 3), (2, 1, "Run_b", 20, 27, 0), (3, 2, "x'y", 5, 6, 7), (4, 2, None, 1, 100, None)]
STATEMENTS = [
    "SELECT group_concat(symbol_id) FROM symbols", "SELECT group_concat(name, '; ') FROM symbols WHERE symbol_id < 3", "SELECT 7/2, 7/2.0, -7/2, 7%0, 1/0", "SELECT max(1,2), min(line_start, line_end), max(complexity, 2) FROM symbols",
    "SELECT total(complexity), total(symbol_id) FROM symbols WHERE symbol_id > 10", "SELECT name FROM symbols WHERE name GLOB 'run_*'", "SELECT name FROM symbols WHERE name LIKE 'RUN\\_%' ESCAPE '\\'", "SELECT name FROM symbols WHERE name GLOB '[Rr]un_?'",
    "SELECT file_id, (line_end - line_start) / count(*) FROM symbols GROUP BY file_id, line_end, line_start", "SELECT s.name, s.line_end / s.line_start * 2 FROM symbols AS s WHERE s.complexity / 2 > 1 OR s.name = 'x''y'",
    "SELECT iif(complexity > 2, 'a', 'b'), ifnull(name, 'none') || '!' FROM symbols", "SELECT file_id, group_concat(DISTINCT k) FROM (SELECT file_id, 'k' AS k FROM symbols) GROUP BY file_id", "SELECT sum(line_end)/count(*), avg(line_end)/2 FROM symbols",
    "SELECT CASE WHEN line_end/10 > 2 THEN 'x' ELSE 'y' END, CAST(line_start AS TEXT) FROM symbols", "WITH t AS (SELECT max(line_end) AS m FROM symbols) SELECT m FROM t", "SELECT count(*) FROM symbols WHERE name IN ('run_a', 'q')",
    "SELECT 2*7/4, (1+2)/2, length(name)/2 FROM symbols WHERE symbol_id = 1", "SELECT name FROM symbols WHERE name NOT LIKE '%RUN%' /* not these */ -- nor those\n",
]


@pytest.fixture(scope="module")
def both(spark):
    spark.createDataFrame(ROWS, "symbol_id long, file_id long, name string, line_start int, line_end int, complexity int").createOrReplaceTempView("symbols")
    lite = sqlite3.connect(":memory:")
    lite.execute("CREATE TABLE symbols (symbol_id, file_id, name, line_start, line_end, complexity)")
    lite.executemany("INSERT INTO symbols VALUES (?, ?, ?, ?, ?, ?)", ROWS)
    return spark, lite


@pytest.mark.parametrize("sql", STATEMENTS)
def test_rows_are_those_of_sqlite(both, sql):
    spark, lite = both
    assert sorted(map(str, map(tuple, spark.sql(to_spark_sql(sql)).collect()))) == sorted(map(str, lite.execute(sql).fetchall()))


@pytest.mark.parametrize("sql", ["", "DELETE FROM symbols", "SELECT 1; SELECT 2", "WITH t AS (SELECT 1) DELETE FROM symbols", "SELECT (1", "PRAGMA x"])
def test_what_is_refused(sql):
    with pytest.raises(RuleSqlError):
        to_spark_sql(sql)


def test_rules_leave_the_views_of_the_session(spark):
    own = spark.createDataFrame([("mine",)], "name string")
    own.createOrReplaceTempView("symbols")
    spark.sql("CREATE OR REPLACE TEMP VIEW calls AS SELECT 7 AS seven")
    ix = Index.empty(spark).with_tables(files=spark.createDataFrame([(5, "a.py")], "file_id long, rel_path string"))
    try:
        found = query_sql(ix, "SELECT f.file_id, count(s.symbol_id) AS n FROM files f LEFT JOIN symbols s ON s.file_id = f.file_id GROUP BY f.file_id")
        assert spark.table("symbols").collect() == own.collect() and spark.table("calls").first()["seven"] == 7
        assert not any(t.name in ("files", "imports", "refs") and t.isTemporary for t in spark.catalog.listTables())
        assert [tuple(r) for r in found.collect()] == [(5, 0)]  # read after its views are gone
        assert "error" in try_rule(ix, "SELECT nothing FROM symbols")[0] and spark.table("symbols").columns == ["name"]
    finally:
        spark.catalog.dropTempView("symbols")
        spark.catalog.dropTempView("calls")
