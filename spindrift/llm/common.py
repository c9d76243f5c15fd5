"""What the corpus operators share: table access, shared-folder tables, Arrow helpers."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of ``documents``, in order; pipeline stages return exactly these.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Rows of two longs that one task of an iterative join writes.
ROWS_A_TASK = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session (a test) without that setting gets a temporary folder of its own; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spindrift-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    release(spark)
    return out


def in_fewer_files(df: DataFrame) -> DataFrame:
    """df in a third of the session's shuffle partitions, for a table to write: fewer and larger files."""
    return df.coalesce(max(4, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 3))


def hold(df: DataFrame) -> DataFrame:
    """Keep df's rows on the executors' disks, for what is read in a few actions and soon given up by ``unpersist``.

    What a lost executor held is computed again from its inputs.
    """
    return df.persist(StorageLevel.DISK_ONLY)


def settle(df: DataFrame, label: str) -> DataFrame:
    """A table of df in as few files as its rows need, though df is computed in all its tasks.

    Plans of what reads it stay small, as they would not over a chain of held tables.
    """
    held = hold(df)
    out = materialize(held.coalesce(1 + held.count() // ROWS_A_TASK), label)
    held.unpersist()
    return out


@contextmanager
def holding() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """``hold`` within a with statement, at whose end all is given up."""
    held: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        held.append(hold(df))
        return held[-1]

    try:
        yield keep
    finally:
        for df in held:
            df.unpersist()


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of finished plans now rather than at some later collection.

    The driver holds on to the plan it ran last, so a one-row plan takes its place first.
    """
    spark.range(1).write.format("noop").mode("overwrite").save()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows of an Arrow batch of texts or pages.  Spark's 10,000 rows of some KB each would be held several times over, by
#: the JVM outside its heap and by each Python worker.
BATCH_ROWS = 1000


def in_small_batches(spark: SparkSession) -> None:
    """Let Python workers of this session get at most BATCH_ROWS rows at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def doc_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, data binary): the two columns an operator reads, whatever else df carries."""
    in_small_batches(df.sparkSession)
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("data"))


def slices(batches: Iterable[pa.RecordBatch], column: int, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the binary column holds about max_bytes in each (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        if batch.column(column).nbytes <= max_bytes:
            yield batch
            continue
        sizes = [len(v) if v is not None else 0 for v in (x.as_py() for x in batch.column(column))]
        at, held = 0, 0
        for i, n in enumerate(sizes):
            if i > at and held + n > max_bytes:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += n
        yield batch.slice(at)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of written edges (a, b) of longs, in any order and repeated or not: rows (node, root), root the
    smallest node.

    Alternates large-star and small-star rounds, each a join and an aggregate on node keys, until every node has one edge,
    to a root.  Each step shortens paths or ends, so no limit on rounds is needed.  Every round is written to the shared
    folder; only whether it is the last reaches the driver.
    """

    def round_of(cur: DataFrame) -> DataFrame:
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(cur.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        return small.where("a <> b").distinct()

    def done(cur: DataFrame) -> bool:
        """Every node is the end of one edge at most, or only the start of edges to it."""
        ends = cur.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))).alias("e")).select("e.*")
        return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or out = 1 and into = 1").isEmpty()

    cur = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    parts, ours = 1 + cur.count() // ROWS_A_TASK, False  # few links need no more tasks and files than that
    while True:
        new = materialize(round_of(cur).coalesce(parts), "links")
        if ours:
            discard(cur)
        cur, ours = new, True
        if done(cur):
            break
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
