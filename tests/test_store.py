"""Stored relations: what an update writes, what a reader then sees, and searches of the stored text index."""

import random
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from spindrift.operators import history, lookup, postings, search
from spindrift.operators.project import Project

WORDS = ["load", "loader", "loading", "store", "stored", "reader", "row", "fold", "queue", "parse", "token", "naïve"]


def module(rng, k):
    functions = [f"def {rng.choice(WORDS)}_{rng.choice(WORDS)}_{k}_{i}(x):\n    \"\"\"{' '.join(rng.choices(WORDS, k=6))}.\"\"\"\n    return {rng.choice(WORDS)}(x)\n" for i in range(5)]
    return "import os\n\n\nclass Thing" + str(k) + ":\n    def run(self):\n        return self.run()\n\n\n" + "\n\n".join(functions)


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    rng, root = random.Random(2), tmp_path_factory.mktemp("many")
    for k in range(40):
        (root / f"m{k}.py").write_text(module(rng, k))
    p = Project(spark, str(root), f"file://{tmp_path_factory.mktemp('rows')}")
    p.rebuild()
    return p, root, rng


def rows_on_disk(store):
    """Rows in all files of the store, by relation, whoever names them."""
    read = lambda f: pq.read_metadata(f).num_rows
    return {name: sum(map(read, (Path(store.root.removeprefix("file://")) / name).rglob("*.parquet"))) for name in ("files", "symbols", "calls", "imports", "text_postings", "gone_files")}


def rows(df):
    return sorted(map(str, df.collect()))


def same_answers(p):
    """Every search from the stored index equals the search of the texts themselves."""
    stored, plain = p.index, p.index
    plain.text_index = None
    assert stored.text_index is not None
    scores = lambda df: {r[0]: round(r[1], 6) for r in df.collect()}
    for query in ("load rows", "naive tokens Thing3 nothing_here"):
        for f, key in ((search.search_symbols, "symbol_id"), (search.search_files, "file_id")):
            assert scores(f(stored, query, 7).select(key, "score")) == scores(f(plain, query, 7).select(key, "score"))
    for name in ("er_ro", "e%_1", "xyz_no", "ad", "QUEUE"):
        assert rows(lookup.find_symbols(stored, name=name)) == rows(lookup.find_symbols(plain, name=name))
    assert rows(search.search(stored, "load stored")) == rows(search.search(plain, "load stored"))


def test_an_update_writes_what_changed(tree):
    p, root, rng = tree
    before = rows_on_disk(p.store)
    names = {r["rel_path"]: r["file_id"] for r in p.index.files.collect()}
    (root / "m7.py").write_text(module(rng, 700))
    (root / "m8.py").unlink()
    (root / "extra.py").write_text(module(rng, 900))
    assert p.update() == {"changed": 1, "added": 1, "removed": 1}
    written = {name: n - before[name] for name, n in rows_on_disk(p.store).items()}
    assert (written["files"], written["symbols"], written["imports"], written["gone_files"]) == (2, 14, 2, 2)  # of 40 files and 280 symbols
    assert written["calls"] < 0.1 * before["calls"] and written["text_postings"] < 0.5 * before["text_postings"]
    assert len(p.store.folders("symbols")) == 2
    after = {r["rel_path"]: r["file_id"] for r in p.index.files.collect()}
    assert set(after) == set(names) - {"m8.py"} | {"extra.py"}
    assert all(after[k] == names[k] for k in after if k not in ("m7.py", "extra.py")) and after["m7.py"] > max(names.values())
    assert p.index.symbols.where("name like '%700%'").count() == 6 and p.index.located_symbols().where("rel_path = 'm8.py'").isEmpty()
    assert p.index.symbols.groupBy("symbol_id").count().where("count > 1").isEmpty()
    assert p.update() == {"changed": 0, "added": 0, "removed": 0} and len(p.store.folders("symbols")) == 2
    same_answers(p)


def test_counts_after_changes_are_those_of_live_rows(tree):
    p, _, _ = tree
    ix = p.index
    for kind, lists in search.text_rows(ix).items():
        n, mean = ix.text_index.collection(kind)
        row = lists.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("m")).first()
        assert n == row["n"] and mean == pytest.approx(row["m"])
    held = search.text_rows(ix)["symbol"].select("key", F.explode(F.array_distinct("tokens")).alias("t")).groupBy("t").count().collect()
    assert ix.text_index.frequencies("symbol", [r["t"] for r in held]) == {r["t"]: r["count"] for r in held}


def test_compaction_and_vacuum(tree):
    p, root, rng = tree
    before, live = rows(lookup.find_symbols(p.index, limit=1000).drop("symbol_id")), p.index.files.count()
    assert not p.compact()
    assert p.compact(most_folders=1) and not p.store.folders("gone_files") and len(p.store.folders("symbols")) == 1
    assert rows(lookup.find_symbols(p.index, limit=1000).drop("symbol_id")) == before and p.index.files.count() == live
    top = p.store.top()["file_id"]
    same_answers(p)
    assert p.store.vacuum(hours=1) == 0 and p.store.vacuum() > 0 and p.store.vacuum() == 0
    assert p.index.files.count() == live
    (root / "m9.py").write_text(module(rng, 901))
    p.update()
    assert p.index.files.where("rel_path = 'm9.py'").first()["file_id"] > top


def test_snapshots_share_what_did_not_change(tree):
    p, root, rng = tree
    folder = Path(p.store.root.removeprefix("file://")) / "snapshot_symbols"
    count = lambda: sum(pq.read_metadata(f).num_rows for f in folder.rglob("*.parquet"))
    p.snapshot("one")
    whole = count()
    assert whole == p.index.symbols.count()
    p.snapshot("two")
    assert count() == whole
    (root / "m11.py").write_text("def only_one_left():\n    return only_one_left()\n")
    p.update()
    found = p.diff("two")
    then = {r["n"]: r for r in p.store.read("snapshot_symbols").collect()}
    full = history.diff(p.store.read("snapshot_symbols").drop("snapshot_id", "bucket"), p.store.read("snapshot_calls").drop("snapshot_id", "bucket"), history.symbol_state(p.index), history.call_state(p.index))
    assert len(then) and {k: rows(v) for k, v in found.items()} == {k: rows(v) for k, v in full.items()}
    assert [r["name"] for r in found["symbols_added"].collect()] == ["only_one_left"] and found["symbols_removed"].count() == 7
    p.snapshot("three")
    assert whole < count() < 2 * whole
    assert all(v.isEmpty() for k, v in p.diff("three").items() if k != "summary")
    p.snapshot("four", keep=1)  # what it shares with those that go stays
    assert all(v.isEmpty() for k, v in p.diff("four").items() if k != "summary")


def test_only_slots_that_can_reach_the_best_are_scored(spark, tmp_path):
    """Many slots of weak rows and one of strong ones: the bound of a slot keeps the weak ones out, and ties stay right."""
    from spindrift.operators.catalog import Store

    docs = spark.range(20_000).select(F.col("id"), F.when(F.col("id").between(5_000, 5_040), F.lit("rare rare rare")).otherwise(F.concat(F.lit("rare "), F.repeat(F.lit("pad "), 40))).alias("text"))
    lists = postings.word_lists(docs.where("id % 3 = 2 or id between 5000 and 5040"), "id", None, ["text"], stemmed=False)
    store = Store(spark, f"file://{tmp_path}/ix")
    store.commit(postings.relations_of({"t": lists}))
    ix = postings.TextIndex({n: store.read(n) for n in postings.RELATIONS})
    best = [r["key"] for r in ix.scores("t", ["rare"], 41).collect()]
    assert best == list(range(5_000, 5_041))
    every = [(r["key"], round(r["score"], 9)) for r in ix.scores("t", ["rare", "pad"]).collect()]
    assert every[:60] == [(r["key"], round(r["score"], 9)) for r in ix.scores("t", ["rare", "pad"], 60).collect()]
    assert ix.scores("t", ["absent"], 5).isEmpty() and ix.scores("t", [], 5).isEmpty() and ix.scores("other", ["rare"], 5).isEmpty()
    plan = ix._of_terms("text_postings", "t", ["rare"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1][:80]


def test_patterns_give_trigrams_that_every_match_holds():
    assert postings.trigrams_of_pattern("a_bcd%xyzw") == ["bcd", "xyz", "yzw"]
    assert postings.trigrams_of_pattern("ab") == [] and postings.trigrams_of_pattern("ABC") == ["abc"]


def test_postings_are_made_without_a_shuffle_of_words(spark, tmp_path):
    """Blocks come from the task of their slot; repeated and null keys, empty texts and slots over many batches included."""
    from spindrift.operators.catalog import Store

    ids = F.when(F.col("id") % 500 == 3, F.lit(None)).when(F.col("id") % 100 == 4, F.lit(7)).otherwise(F.col("id"))
    docs = spark.range(9000).select(ids.alias("id"), F.when(F.col("id") % 3 > 0, F.concat_ws(" ", F.lit("all all"), F.concat(F.lit("w"), F.col("id") % 50))).alias("text")).repartition(7)
    made = postings.relations_of({"t": postings.word_lists(docs, "id", None, ["text"], stemmed=False)})
    assert "Aggregate" not in made["text_postings"]._jdf.queryExecution().executedPlan().toString()
    store = Store(spark, f"file://{tmp_path}/ix")
    store.commit(made)
    blocks = store.read("text_postings")
    assert blocks.groupBy("term", "slot").count().where("count > 1").isEmpty()
    held = blocks.select("term", "slot", F.explode("rows").alias("x")).select("term", "slot", "x.*")
    want = docs.where("text is not null").select("id", F.explode(F.split("text", " ")).alias("term"))
    assert {(r["term"], r["id"]): r["n"] for r in want.groupBy("term", "id").agg(F.count("*").alias("n")).collect()} == {(r["term"], r["key"]): r["n"] for r in held.groupBy("term", "key").agg(F.sum("tf").alias("n")).collect()}
    assert held.where("length <> 3 or slot <> floor(key / 1024)").isEmpty()
    ix = postings.TextIndex({n: store.read(n) for n in postings.RELATIONS})
    assert ix.frequencies("t", ["all", "w7"]) == {"all": 6000, "w7": 120} and ix.collection("t") == (9000, 2.0)


def test_symbols_without_a_parent_are_not_one_task(spark):
    from spindrift.operators.index import Index

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ix = Index.empty(spark)
        symbols = spark.range(400).selectExpr("id AS symbol_id", "0L AS file_id", "CASE WHEN id % 10 = 1 THEN 0L END AS parent_id", "concat('s', id) AS name")
        found = ix.with_tables(symbols=symbols, files=spark.range(1).selectExpr("id AS file_id", "'a.py' AS rel_path")).located_symbols()
        rows = found.select("symbol_id", "qualified_name", F.spark_partition_id().alias("p")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert {r["symbol_id"]: r["qualified_name"] for r in rows} == {i: f"s0.s{i}" if i % 10 == 1 else f"s{i}" for i in range(400)}
    assert len({r["p"] for r in rows if r["symbol_id"] % 10 != 1}) == 4
