"""The index: its relations as DataFrames, and the columns that queries derive from them."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..schema import SCHEMAS


@dataclass
class Index:
    files: DataFrame
    symbols: DataFrame
    calls: DataFrame
    refs: DataFrame
    imports: DataFrame
    diagnostics: DataFrame | None = None
    annotations: DataFrame | None = None

    #: A stored text index of these relations, if there is one; other relations made from them have none.
    text_index = None

    @property
    def spark(self) -> SparkSession:
        return self.files.sparkSession

    @classmethod
    def of(cls, tables: dict[str, DataFrame]) -> Index:
        return cls(**{f.name: tables[f.name] for f in fields(cls) if f.name in tables})

    @classmethod
    def empty(cls, spark: SparkSession) -> Index:
        return cls(**{f.name: spark.createDataFrame([], SCHEMAS[f.name]) for f in fields(cls)})

    def with_tables(self, **tables: DataFrame) -> Index:
        return replace(self, **tables)

    @contextmanager
    def registered(self) -> Iterator[None]:
        """Temp views under the relations' names while rule SQL is analysed; then the session has its own views again."""
        views = {f.name: df for f in fields(self) if (df := getattr(self, f.name)) is not None}
        catalog = self.spark.catalog
        before = {t.name: self.spark.table(t.name) for t in catalog.listTables(pattern="|".join(views)) if t.isTemporary}
        try:
            for name, df in views.items():
                df.createOrReplaceTempView(name)
            yield
        finally:
            for name in views:
                catalog.dropTempView(name)
                if name in before:
                    before[name].createOrReplaceTempView(name)

    # -- derived relations ---------------------------------------------------------------------------------------

    def located_symbols(self, only: DataFrame | None = None) -> DataFrame:
        """Symbols (of the keys in only, if given) with the path of their file and the name of their parent.

        Symbols without a parent look up a key of their own that none has, or one task would get them all.
        """
        parents = self.symbols.select(F.col("symbol_id").alias("__up"), F.col("name").alias("parent_name"))
        up = F.coalesce(F.col("parent_id"), -1 - F.col("symbol_id"))
        paths = self.files.select("file_id", "rel_path")
        symbols = self.symbols if only is None else self.symbols.join(only.withColumnRenamed("key", "symbol_id"), "symbol_id", "left_semi")
        return symbols.join(paths, "file_id").withColumn("__up", up).join(parents, "__up", "left").drop("__up").withColumn("qualified_name", text.qualified(F.col("parent_name"), F.col("name")))

    def call_sites(self) -> DataFrame:
        """Calls with their file, caller and the caller's class (null for calls outside any symbol)."""
        return self.with_callers(self.placed_calls())

    def placed_calls(self) -> DataFrame:
        """Calls with the last segment of their expression and the path of their file."""
        calls = self.calls.withColumn("callee_last", text.last_segment(F.col("callee_expr")))
        return calls.join(self.files.select("file_id", "rel_path"), "file_id")

    def with_callers(self, calls: DataFrame) -> DataFrame:
        """calls with the name and kind of their caller and the name of its class."""
        callers = self.symbols.select(F.col("symbol_id").alias("caller_id"), F.col("name").alias("caller_name"), F.col("kind").alias("caller_kind"), F.col("parent_id").alias("class_id"))
        classes = self.symbols.select(F.col("symbol_id").alias("class_id"), F.col("name").alias("caller_class"))
        return calls.join(callers, "caller_id", "left").join(classes, "class_id", "left").drop("class_id")
