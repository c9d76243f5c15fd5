"""The store: each relation a Parquet table, all of them swapped at once by a version pointer.

A transaction writes what it changes or adds under a new version and then replaces one small pointer file, which names
the folders of every relation.  Readers see the old pointer or the new one.  There is one writer at a time.

A file that changes is a new file with a new id: its rows are added in folders of their own, and the old id joins
``gone_files``, which every reading of a relation leaves out.  So a change writes what changed, and nothing else, until the
project compacts.  The pointer also keeps the highest id ever given of each kind.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FILE_RELATIONS, FOLDERS_BY, SCHEMA_VERSION, SCHEMAS
from . import postings
from .index import Index


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        self._fs = self._path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointer(self) -> dict:
        path = self._path("CURRENT.json")
        if not self._fs.exists(path):
            return {"schema_version": SCHEMA_VERSION, "tables": {}}
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.root}/CURRENT.json").collect()))

    def read(self, name: str) -> DataFrame:
        """A relation as of now, without what belongs to files that are gone; empty if it was never written.  Columns that
        an older version lacks are null."""
        return self._read(self._pointer()["tables"], name)

    def _read(self, tables: dict, name: str) -> DataFrame:
        folders = _listed(tables.get(name))
        if not folders:
            return self.spark.createDataFrame([], SCHEMAS[name])
        reader, paths = self.spark.read.schema(SCHEMAS[name]), [f"{self.root}/{folder}" for folder in folders]
        # Each folder of folders has its own partition columns.
        found = reduce(DataFrame.unionByName, map(reader.parquet, paths)) if name in FOLDERS_BY else reader.parquet(*paths)
        if tables.get("gone_files") and name in ("files", *FILE_RELATIONS):
            found = found.join(self._read(tables, "gone_files"), "file_id", "left_anti").select(*SCHEMAS[name].names)
        return found

    def folders(self, name: str) -> list[str]:
        return _listed(self._pointer()["tables"].get(name))

    def top(self) -> dict[str, int]:
        """The highest id given so far, by key."""
        return dict.fromkeys(KEYS.values(), 0) | self._pointer().get("top", {})

    def commit(self, tables: dict[str, DataFrame | Callable], added: dict[str, DataFrame | Callable] | None = None, label: str = "", dropped: tuple[str, ...] = (), cleared: tuple[str, ...] = ()) -> None:
        """Replace relations, add rows to others and clear yet others, together.  If any write fails, nothing changes.

        A relation may be a function of a reader of those that this commit wrote before it.  Rows added under a label are a folder of their own, which a later commit may drop by that label.
        """
        pointer, version, added = self._pointer(), uuid.uuid4().hex, added or {}
        top = pointer.setdefault("top", {})
        written = lambda name: self._read({name: f"{name}/{label}-{version}"}, name)
        for name, df in [*tables.items(), *added.items()]:
            df = df(written) if callable(df) else df
            typed = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMAS[name].fields])
            writer = typed.write.partitionBy(FOLDERS_BY[name]) if name in FOLDERS_BY else typed.write
            writer.parquet(folder := f"{self.root}/{name}/{label}-{version}")
            if name in KEYS:  # of what was written, which has its statistics
                top[KEYS[name]] = max(top.get(KEYS[name], 0), self.spark.read.schema(SCHEMAS[name]).parquet(folder).agg(F.max(KEYS[name])).first()[0] or 0)
        for name in cleared:
            pointer["tables"].pop(name, None)
        stays = lambda folder: folder.rsplit("/", 1)[1].split("-")[0] not in dropped
        for name in tables:
            pointer["tables"][name] = [f"{name}/{label}-{version}"]
        for name in added:
            pointer["tables"][name] = [*filter(stays, _listed(pointer["tables"].get(name))), f"{name}/{label}-{version}"]
        temp = self._path(f".CURRENT-{version}.json")
        out = self._fs.create(temp)
        out.write(bytearray(json.dumps(pointer).encode()))
        out.close()
        final = self._path("CURRENT.json")
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri() if self.root.startswith("file:") else self._path().toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(self._fs.makeQualified(temp), self._fs.makeQualified(final), options)

    def vacuum(self, hours: float = 0) -> int:
        """Delete the folders that the pointer does not name and that are older than so many hours; how many."""
        before = (time.time() - 3600 * hours) * 1000
        live, gone = {folder for folders in self._pointer()["tables"].values() for folder in _listed(folders)}, 0
        for name in SCHEMAS:
            if self._fs.exists(self._path(name)):
                for status in self._fs.listStatus(self._path(name)):
                    if f"{name}/{status.getPath().getName()}" not in live and status.getModificationTime() <= before:
                        self._fs.delete(status.getPath(), True)
                        gone += 1
        return gone

    def index(self) -> Index:
        tables = self._pointer()["tables"]
        ix = Index.of({name: self._read(tables, name) for name in ("files", "symbols", "calls", "refs", "imports", "diagnostics", "annotations")})
        if tables.get("text_postings"):
            gone = self._read(tables, "gone_files") if tables.get("gone_files") else None
            ix.text_index = postings.TextIndex({name: self._read(tables, name) for name in postings.RELATIONS}, gone)
        return ix

    def append(self, name: str, rows: DataFrame, key: str | None = None) -> None:
        """Add rows in a folder of their own; a key column that they lack counts on from the largest there is.

        After MOST_FOLDERS of them the relation is written anew as one.
        """
        old = self.read(name)
        if key and key not in rows.columns:
            last = old.agg(F.coalesce(F.max(key), F.lit(0)).alias("m")).first()["m"]
            rows = numbered(rows, key, *rows.columns[:2], start=last)
        if len(_listed(self._pointer()["tables"].get(name))) >= MOST_FOLDERS:
            self.commit({name: old.unionByName(rows, allowMissingColumns=True)})
        else:
            self.commit({}, {name: rows})


MOST_FOLDERS = 50
#: The id of each relation that has one of its own in an index.
KEYS = {"files": "file_id", "symbols": "symbol_id", "calls": "call_id", "refs": "ref_id", "imports": "import_id"}


def _listed(folders: str | list[str] | None) -> list[str]:
    return [folders] if isinstance(folders, str) else folders or []


def numbered(df: DataFrame, name: str, *order: str, start: int = 0, held: list[DataFrame] | None = None) -> DataFrame:
    """df with ids start + 1, start + 2, ... in the given order, by sorted ranges: no task sees more than its range.

    The driver receives the size of each range.  The ranges stay on the executors' disks, for the rows must not be dealt
    anew; ``held`` receives them for a caller that gives them up.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()).persist(StorageLevel.DISK_ONLY)
    if held is not None:
        held.append(ranged)
    part = F.shiftright("__at", 33)
    sizes = {r["p"]: r["n"] for r in ranged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    bases, total = [], start
    for p in sorted(sizes):
        bases += [F.lit(p), F.lit(total + 1)]
        total += sizes[p]
    base = F.create_map(*bases)[part] if bases else F.lit(0)
    return ranged.withColumn(name, (base + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("__at")


def without_files(ix: Index, paths: DataFrame) -> Index:
    """The index without some files (rel_path) and without all that belongs to them."""
    gone = ix.files.join(paths.select("rel_path"), "rel_path", "left_semi").select("file_id")
    tables = {"files": ix.files.join(gone, "file_id", "left_anti").select(*ix.files.columns)}
    for name in FILE_RELATIONS:
        if (df := getattr(ix, name)) is not None:
            tables[name] = df.join(gone, "file_id", "left_anti").select(*df.columns)
    return ix.with_tables(**tables)


def of_files(ix: Index, file_ids: DataFrame, most: int = 1000) -> Index:
    """The index of some files alone.  Of few files the ids enter as literals, by which a scan skips row groups."""
    few = [r[0] for r in file_ids.limit(most + 1).collect()]
    pick = (lambda df: df.where(F.col("file_id").isin(few))) if len(few) <= most else (lambda df: df.join(file_ids, "file_id", "left_semi").select(*df.columns))
    return ix.with_tables(**{name: pick(getattr(ix, name)) for name in KEYS})


def shifted(new: Index, top: dict[str, int]) -> Index:
    """An index whose ids count on from the highest given so far."""
    shift = top | {"parent_id": top["symbol_id"], "caller_id": top["symbol_id"]}
    return new.with_tables(**{name: getattr(new, name).withColumns({c: F.col(c) + F.lit(n) for c, n in shift.items() if c in getattr(new, name).columns}) for name in KEYS})
