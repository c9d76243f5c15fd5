import re
import sqlite3

import pytest
from pyspark.sql import functions as F
from spindrift.functions import dialect, patterns, text
from spindrift.functions.porter import stem


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column).first()[0]


@pytest.mark.parametrize(
    "expr, category",
    [("self.run", "self_method"), ("self.db.run", "self_attr_method"), ("self", "self_method"), ("len", "builtin"), ("x.sorted", "builtin"), ("os.path.join", "external"), ("helper", "local")],
)
def test_call_category(spark, expr, category):
    assert one(spark, text.call_category(F.col("e")), e=expr) == category


@pytest.mark.parametrize("name, score", [("main", 100), ("main_loop", 50), ("MAIN", 90), ("Mainly", 40), ("do_main", 10)])
def test_name_score_ladder(spark, name, score):
    assert one(spark, text.name_score(F.col("n"), "main"), n=name) == score


def test_called_name_of_other_languages_q21(spark):
    for expr, name in [("new Foo", "Foo"), ("a::b", "b"), ("p->f", "f"), ("println!", "println"), ("a.b.c", "c")]:
        assert one(spark, text.callee_name(F.col("e")), e=expr) == name


def test_wildcards_in_names_only_in_compat_mode_q3(spark):
    hit = lambda compat: one(spark, text.names_symbol(F.col("e"), "load_file", compat), e="y.loadXfile")
    assert not hit(False) and hit(True)


def test_module_keys_q5(spark):
    assert one(spark, text.module_key(F.col("p")), p="pkg/pyutils.py") == "pkg.pyutils"
    assert one(spark, text.module_key_compat(F.col("p")), p="pkg/pyutils.py") == "pkgutils"


@pytest.mark.parametrize("word", ["Café", "cafe\u0301s", "Łódź", "Ångström", "ệ", "ạb", "Ǽon", "ſo", "Žižek", "naïve"])
def test_folding_is_that_of_sqlite(spark, word):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(x, tokenize='unicode61')")
    db.execute("create virtual table v using fts5vocab(t, 'instance')")
    db.execute("insert into t values (?)", (word,))
    expected = [r[0] for r in db.execute("select term from v order by offset")]
    assert one(spark, text.word_tokens(F.col("t")), t=word) == expected
    assert one(spark, text.token_count(F.col("t")), t=word) == len(expected)
    assert [text.fold_word(word.lower())] == expected


def test_source_slice(spark):
    assert one(spark, text.source_slice(F.col("t"), F.lit(2), F.lit(3)), t="a\nb\nc\nd") == "b\nc"


def test_tokens(spark):
    assert one(spark, text.word_tokens(F.col("t")), t="Load_file.Café(x2)") == ["load", "file", "cafe", "x2"]
    assert text.query_tokens(" load_file  Now ") == ["load", "file", "now"]


@pytest.mark.parametrize(
    "word, root",
    [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"),
     ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("adjustment", "adjust"), ("adoption", "adopt"), ("controlling", "control"), ("rate", "rate"), ("sky", "sky")],
)
def test_porter(word, root):
    assert stem(word) == root


@pytest.mark.parametrize(
    "pattern, path, hit",
    [("*.log", "a/b.log", True), ("/top.py", "top.py", True), ("/top.py", "a/top.py", False), ("gen/", "a/gen/x.py", True), ("gen/", "gen", False), ("a/**/z.py", "a/b/c/z.py", True), ("a/**/z.py", "a/z.py", True), ("x[0-9].py", "x7.py", True), ("docs", "docs/a.py", True)],
)
def test_ignore_patterns(spark, pattern, path, hit):
    assert bool(re.search(patterns.ignore_regex(pattern), path)) is hit
    assert one(spark, patterns.is_ignored(F.col("p"), [pattern]), p=path) is hit


def test_ignore_brings_back(spark):
    kept = ["*.py", "!keep.py", "# comment", ""]
    assert one(spark, patterns.is_ignored(F.col("p"), kept), p="a.py") and not one(spark, patterns.is_ignored(F.col("p"), kept), p="d/keep.py")


def test_skipped_folders(spark):
    for path, hit in [("a/__pycache__/x.py", True), ("pkg.egg-info/x.py", True), ("build.py", False), ("src/dist/x.py", True)]:
        assert one(spark, patterns.in_skipped_folder(F.col("p")), p=path) is hit


def test_layer_prefix_quirk_q23(spark):
    assert one(spark, patterns.in_layer(F.col("p"), "views/**"), p="views_old/a.py")


@pytest.mark.parametrize("sql", ["DELETE FROM files", "SELECT 1; SELECT 2", "", "WITH x AS (SELECT 1) DELETE FROM files"])
def test_rules_only_read_q16(sql):
    with pytest.raises(dialect.RuleSqlError):
        dialect.to_spark_sql(sql)


def test_dialect(spark):
    out = dialect.to_spark_sql(r"SELECT name FROM t WHERE name LIKE '%AB%' AND name NOT LIKE '\_%' ESCAPE '\' AND x = 'it''s' -- note")
    assert "ILIKE '%AB%'" in out and r"r'\_%'" in out and "note" not in out
    spark.createDataFrame([("xaby", "it's"), ("_ab", "it's")], "name string, x string").createOrReplaceTempView("t")
    assert [r[0] for r in spark.sql(out).collect()] == ["xaby"]
