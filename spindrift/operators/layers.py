"""Architectural layers: which layer each file is in, and imports that a layer does not allow."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.patterns import in_layer
from .index import Index


@dataclass(frozen=True)
class Layer:
    name: str
    paths: list[str]
    allowed_imports: list[str] = field(default_factory=list)
    description: str = ""


def file_layers(files: DataFrame, layers: list[Layer]) -> DataFrame:
    """(rel_path, layer): the last layer that matches; null if none does.  One expression, no join."""
    layer = F.lit(None).cast("string")
    for x in layers:
        layer = F.when(text.any_of([in_layer(F.col("rel_path"), p) for p in x.paths]), F.lit(x.name)).otherwise(layer)
    return files.select("rel_path", layer.alias("layer"))


def module_files(files: DataFrame) -> DataFrame:
    """(module, rel_path): the module each file defines, also without a leading src."""
    own = files.select(text.module_key(F.col("rel_path")).alias("module"), "rel_path")
    return own.unionByName(own.where(own["module"].startswith("src.")).select(F.substring("module", 5, 1_000_000).alias("module"), "rel_path")).groupBy("module").agg(F.max("rel_path").alias("rel_path"))


def violations(ix: Index, layers: list[Layer]) -> DataFrame:
    """Imports from one layer into another that its allowed_imports does not name, by path and line."""
    columns = "rel_path string, line_no int, import_module string, import_name string, source_layer string, target_layer string"
    if not layers:
        return ix.spark.createDataFrame([], columns)
    of_file = file_layers(ix.files, layers).where("layer is not null")
    modules = module_files(ix.files).join(of_file, "rel_path").select("module", F.col("layer").alias("target"))
    source = ix.imports.join(ix.files.select("file_id", "rel_path"), "file_id").join(of_file.withColumnRenamed("layer", "source_layer"), "rel_path")
    known = module_files(ix.files).select(F.col("module").alias("known"))
    # A module that is a file decides, even one without a layer; only otherwise module.name is looked up.
    target_of = source.withColumn("longer", F.concat_ws(".", "module", "name"))
    target_of = target_of.join(known, F.col("module") == F.col("known"), "left").withColumn("looked_up", F.when(F.col("known").isNotNull() | F.col("name").isNull(), F.col("module")).otherwise(F.col("longer"))).drop("known")
    found = target_of.join(modules.select(F.col("module").alias("looked_up"), F.col("target").alias("target_layer")), "looked_up").where("source_layer <> target_layer")
    allowed = F.lit(False)
    for x in layers:
        allowed = F.when((F.col("source_layer") == x.name) & F.col("target_layer").isin(x.allowed_imports or [""]), F.lit(True)).otherwise(allowed)
    return found.where(~allowed).orderBy("rel_path", "line_no", "module", "name").select("rel_path", "line_no", F.col("module").alias("import_module"), F.col("name").alias("import_name"), "source_layer", "target_layer")
