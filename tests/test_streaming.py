from datetime import datetime

from pyspark.sql import functions as F
from spindrift.operators.history import AUTO_END
from spindrift.streaming import events

DATA = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet(f"{DATA}/events.parquet")
    batch.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = events.read_events(spark, f"{tmp_path}/in", batch.schema)
    q = events.windowed_counts(stream, "1000 days").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    total = lambda df: df.agg(F.count("*"), F.sum("n"), F.round(F.sum("value"), 2)).first()
    assert total(spark.table("w")) == total(events.windowed_counts(batch))
    assert events.activity_sessions(batch).agg(F.sum("n")).first()[0] == batch.count()


def test_watch_sources(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    seen = []
    events.watch_sources(spark, f"{tmp_path}/src", f"{tmp_path}/cp", lambda df: seen.extend(r["path"] for r in df.collect())).awaitTermination()
    assert len(seen) == 1
    (tmp_path / "src" / "b.py").write_text("y = 1\n")
    events.watch_sources(spark, f"{tmp_path}/src", f"{tmp_path}/cp", lambda df: seen.extend(r["path"] for r in df.collect())).awaitTermination()
    assert len(seen) == 2 and seen[1].endswith("b.py")


def run_batches(spark, tmp_path, name, schema, batches, transform):
    """The rows that a stream emits when every batch comes as a file of its own."""
    (tmp_path / name).mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        q = transform(stream).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}-cp").format("parquet").option("path", f"{tmp_path}/{name}-out").trigger(availableNow=True).start()
        q.awaitTermination()
    return [tuple(r) for r in spark.read.parquet(f"{tmp_path}/{name}-out").collect()]


def test_listings_become_changes(spark, tmp_path):
    t = lambda h: datetime(2024, 1, 1, h)
    listings = [
        [("a", "1", t(1)), ("b", "1", t(1))],
        [("a", "2", t(2)), ("b", "1", t(2)), ("c", "1", t(2))],
        [("a", "2", t(3)), ("c", "1", t(3))],
        [("a", "3", t(4)), ("b", "9", t(4)), ("c", "1", t(4))],
    ]
    found = run_batches(spark, tmp_path, "lists", "rel_path string, file_hash string, at timestamp", listings, lambda s: events.source_changes(s, 50 * 60 * 1000))
    assert len(found) == 7 and {tuple(x[:4]) for x in found} == {("a", "added", None, "1"), ("a", "modified", "1", "2"), ("a", "modified", "2", "3"), ("b", "added", None, "1"), ("b", "deleted", "1", None), ("b", "added", None, "9"), ("c", "added", None, "1")}


def test_sessions_end_by_themselves_by_the_next_or_when_idle(spark, tmp_path):
    t = lambda h, m=0: datetime(2024, 1, 1, h, m)
    batches = [
        [("p", 1, "start", t(1), None), ("q", 7, "start", t(1), None)],
        [("p", 1, "end", t(2), "done"), ("q", 8, "start", t(2), None)],
        [("p", 2, "start", t(3), None)],
        [("r", 9, "start", t(12), None)],
        [("r", 9, "end", t(13), "late one")],
    ]
    found = run_batches(spark, tmp_path, "sessions", "project string, session_id long, event string, at timestamp, summary string", batches, lambda s: events.closed_sessions(s, 5 * 3600 * 1000))
    assert {(p, s, a.hour, b.hour, x) for p, s, a, b, x in found} == {
        ("p", 1, 1, 2, "done"), ("q", 7, 1, 2, AUTO_END), ("q", 8, 2, 7, AUTO_END), ("p", 2, 3, 8, AUTO_END), ("r", 9, 12, 13, "late one"),
    }
