"""Source files as relations: scan, hash, decode, parse, and number.

A scan reads files through Spark's binaryFile source; parsing deals the files out by path, for they may come in few
tasks, and is one pass of mapInArrow that yields tagged rows of all four relations; ids come from the order of (path, ordinal), so that equal input gives equal ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.patterns import in_skipped_folder, is_ignored
from ..operators.catalog import numbered
from ..operators.index import Index
from ..schema import SCHEMAS
from . import brace_source, python_source

#: Parsers by file suffix: source text and path to the tagged rows of python_source.ROW.
PARSERS: dict[str, tuple[str, Callable[[str, str], list[dict]]]] = {".py": ("python", python_source.parse), **brace_source.PARSERS}
#: Tagged rows that a task holds before it gives them on.
ROWS_A_BATCH = 10_000


def register_parser(suffix: str, language: str, parse: Callable[[str, str], list[dict]]) -> None:
    """Add a language.  A suffix without a parser is not scanned: nothing is indexed half."""
    if not callable(parse):
        raise TypeError(f"no parser for {suffix}")
    PARSERS[suffix.lower()] = (language, parse)


def supported_suffixes() -> list[str]:
    return sorted(PARSERS)


def scan(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """(rel_path, content, file_hash) of the files under root that have a parser and are not skipped or ignored."""
    base = root.rstrip("/")
    plain = base.split("://", 1)[-1] if "://" in base else base
    plain = plain if plain.startswith("/") or "://" in base else f"/{plain}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.*").load(base)
    path = F.regexp_replace("path", r"^[a-z0-9]+:/+", "/")
    found = raw.select(F.substring_index(path, f"{plain}/", -1).alias("rel_path"), "content")
    suffix = F.lower(F.regexp_extract("rel_path", r"(\.[^./]+)$", 1))
    kept = found.where(suffix.isin(supported_suffixes()) & ~in_skipped_folder(F.col("rel_path")) & ~is_ignored(F.col("rel_path"), ignore or []))
    return kept.select("rel_path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"), F.sha2("content", 256).alias("file_hash"))


def parse(sources: DataFrame) -> dict[str, DataFrame]:
    """The relations symbols, calls, refs, imports and errors, still keyed by path, of sources (rel_path, content)."""
    parsers = dict(PARSERS)
    spark = sources.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    kinds = pa.schema([(n, pa.int32() if k == "int" else pa.string()) for n, k in (f.split() for f in python_source.ROW.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, parser = parsers["." + path.rsplit(".", 1)[-1].lower()]
                rows.extend(r | {"rel_path": path} for r in parser(content or "", path))
                if len(rows) >= ROWS_A_BATCH:
                    yield pa.RecordBatch.from_pylist(rows, kinds)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, kinds)

    tagged = sources.select("rel_path", "content").repartition(tasks, "rel_path").mapInArrow(run, python_source.ROW)
    pick = lambda tag, *columns: tagged.where(F.col("tag") == tag).select("rel_path", "ordinal", *columns)
    return {
        "symbols": pick("symbol", "parent", "kind", "name", "params_json", "return_type", "decorators_json", "bases_json", "docstring", "line_start", "line_end", "complexity", "is_async"),
        "calls": pick("call", F.col("parent").alias("caller"), F.col("name").alias("callee_expr"), F.col("line_start").alias("line_no")),
        "refs": pick("ref", F.col("parent").alias("owner"), F.col("kind").alias("ref_kind"), F.col("return_type").alias("target"), "name", F.col("line_start").alias("line_no")),
        "imports": pick("import", F.col("return_type").alias("module"), F.col("docstring").alias("name"), F.col("params_json").alias("alias"), F.col("is_async").alias("is_from"), F.col("line_start").alias("line_no")),
        "errors": pick("error", F.col("docstring").alias("parse_error")),
    }


def build(sources: DataFrame, parsed: dict[str, DataFrame] | None = None, held: list[DataFrame] | None = None) -> Index:
    """An index of sources (rel_path, content, file_hash): parents, callers and owners are linked by (path, ordinal).

    Ids follow the order of (path, ordinal) by sorted ranges.  A caller that writes several relations persists sources and
    parsed for that long, or each relation parses anew; the numbered ranges are kept too, and ``held`` receives them.
    """
    parsed = parsed or parse(sources)

    def _numbered(df: DataFrame, *order: str, name: str) -> DataFrame:
        return numbered(df, name, *order, held=held)

    suffix = F.lower(F.regexp_extract("rel_path", r"(\.[^./]+)$", 1))
    language = F.create_map(*[F.lit(x) for s, (name, _) in PARSERS.items() for x in (s, name)])[suffix]
    lines = (F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))) + 1).cast("int")
    listed = sources.select("rel_path", "file_hash", language.alias("language"), lines.alias("line_count")).join(parsed["errors"].drop("ordinal"), "rel_path", "left")
    files = _numbered(listed, "rel_path", name="file_id").withColumn("indexed_at", F.current_timestamp().cast("timestamp_ntz")).select(*SCHEMAS["files"].names)
    ids = files.select("rel_path", "file_id")
    symbols = _numbered(parsed["symbols"], "rel_path", "ordinal", name="symbol_id")
    links = lambda column: symbols.select("rel_path", F.col("ordinal").alias(column), F.col("symbol_id").alias(f"{column}_id"))
    linked = lambda name, column, key: _numbered(parsed[name], "rel_path", "ordinal", name=key).join(ids, "rel_path").join(links(column), ["rel_path", column], "left")
    return Index(
        files,
        symbols.join(ids, "rel_path").join(links("parent"), ["rel_path", "parent"], "left").select(*SCHEMAS["symbols"].names),
        linked("calls", "caller", "call_id").select(*SCHEMAS["calls"].names),
        linked("refs", "owner", "ref_id").withColumnRenamed("owner_id", "symbol_id").select(*SCHEMAS["refs"].names),
        _numbered(parsed["imports"], "rel_path", "ordinal", name="import_id").join(ids, "rel_path").select(*SCHEMAS["imports"].names),
    )


def qualified_symbols(ix: Index) -> DataFrame:
    return ix.located_symbols().select("symbol_id", "rel_path", text.qualified(F.col("parent_name"), F.col("name")).alias("qualified_name"))
