"""Counts, roll-ups and graphs over the whole index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .index import Index


def stats(ix: Index) -> DataFrame:
    """One row of counters; each relation is read once."""
    one = [
        ix.files.agg(F.count("*").alias("files"), F.count("parse_error").alias("parse_errors")),
        ix.symbols.agg(F.count("*").alias("symbols"), F.count_if(F.col("kind") == "class").alias("classes"), F.count_if(F.col("kind").isin("function", "method")).alias("functions")),
        ix.calls.agg(F.count("*").alias("calls")),
        ix.refs.agg(F.count("*").alias("refs")),
        ix.imports.agg(F.count("*").alias("imports")),
    ]
    if ix.diagnostics is not None:
        open_ones = ix.diagnostics.where("is_resolved = 0")
        one.append(open_ones.agg(F.count("*").alias("diagnostics"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings")))
    out = one[0]
    for row in one[1:]:
        out = out.crossJoin(row)  # one row each
    return out


def languages(ix: Index) -> DataFrame:
    return ix.files.groupBy("language").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "language")


def severities(ix: Index) -> DataFrame:
    return ix.diagnostics.where("is_resolved = 0").groupBy("severity").agg(F.count("*").alias("n"))


def modules(ix: Index) -> DataFrame:
    """Per top-level module: files, lines, symbols, classes and functions.  Symbols are counted per file before they meet the files."""
    per_file = ix.symbols.groupBy("file_id").agg(F.count("*").alias("s"), F.count_if(F.col("kind") == "class").alias("c"), F.count_if(F.col("kind").isin("function", "method")).alias("f"))
    joined = ix.files.select("file_id", "line_count", text.top_module(F.col("rel_path")).alias("module")).join(per_file, "file_id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return joined.groupBy("module").agg(F.count("*").alias("files"), F.sum("line_count").alias("lines"), total("s").alias("symbols"), total("c").alias("classes"), total("f").alias("functions"))


def key_classes(ix: Index, top: int = 5) -> DataFrame:
    """The classes of each module with most members."""
    counts = ix.symbols.where("parent_id is not null").groupBy(F.col("parent_id").alias("symbol_id")).agg(F.count("*").alias("methods"))
    classes = ix.symbols.where("kind = 'class'").join(ix.files.select("file_id", text.top_module(F.col("rel_path")).alias("module")), "file_id").join(counts, "symbol_id", "left")
    classes = classes.select("module", "symbol_id", "name", F.coalesce("methods", F.lit(0)).alias("methods"), (F.col("line_end") - F.col("line_start")).alias("lines"))
    rank = F.row_number().over(Window.partitionBy("module").orderBy(F.desc("methods"), "name", "symbol_id"))
    return classes.withColumn("rank", rank).where(F.col("rank") <= top).select("module", "rank", "name", "methods", "lines")


def module_dependencies(ix: Index) -> DataFrame:
    """(module, depends_on): from-imports whose module contains another module's name."""
    named = ix.files.select("file_id", text.top_module(F.col("rel_path")).alias("module"))
    pairs = ix.imports.where("is_from = 1 and module is not null").select("file_id", F.col("module").alias("imported")).join(named, "file_id").select("module", "imported").distinct()
    targets = named.select(F.col("module").alias("depends_on")).where("depends_on <> '(root)'").distinct()
    held = containing(pairs.select("imported").distinct(), "imported", targets, "depends_on")
    return pairs.join(held, "imported").where("module <> depends_on").select("module", "depends_on").distinct()


def containing(texts: DataFrame, text_col: str, names: DataFrame, name_col: str) -> DataFrame:
    """(text, name): texts that contain a name, by an equi join.

    Every name waits under the one of its grams (three characters, or all of a shorter name) that fewest texts hold, and a
    text asks under each of its grams.  So names that share a beginning do not meet every text; what meets is compared.
    """

    def grams(column: str, sizes: Column) -> Column:
        long = F.length(column)
        at = lambda n: F.when(long >= n, F.transform(F.sequence(F.lit(1), long - n + 1), lambda i: F.substring(F.col(column), i, n))).otherwise(F.array().cast("array<string>"))
        return F.array_distinct(F.flatten(F.transform(sizes, at)))

    asked = texts.select(text_col, F.explode(grams(text_col, F.array(F.lit(1), F.lit(2), F.lit(3)))).alias("gram"))
    counts = asked.groupBy("gram").agg(F.count("*").alias("n"))
    own = names.where(F.length(name_col) > 0).select(name_col, F.explode(grams(name_col, F.array(F.least(F.length(name_col), F.lit(3))))).alias("gram"))
    sized = own.join(counts, "gram", "left").groupBy(name_col).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g"))
    waiting = sized.where("g.n > 0").select(name_col, F.col("g.gram").alias("gram"))
    return asked.join(waiting, "gram").where(F.contains(text_col, name_col)).select(text_col, name_col)


def imports_graph(ix: Index, file_pattern: str | None = None) -> DataFrame:
    """(rel_path, modules): every import of a file in line order, repeats included."""
    files = ix.files.select("file_id", "rel_path")
    if file_pattern:
        files = files.where(text.contains_like(F.col("rel_path"), file_pattern))
    listed = ix.imports.join(files, "file_id").groupBy("rel_path").agg(F.array_sort(F.collect_list(F.struct("line_no", "module", "import_id"))).alias("x"))
    return listed.select("rel_path", F.transform("x", lambda x: x["module"]).alias("modules")).orderBy("rel_path")


def file_summary(ix: Index, rel_path: str) -> dict:
    """The file, its symbols, imports and open findings, as DataFrames."""
    file = ix.files.where(F.col("rel_path") == rel_path)
    here = file.select("file_id")
    out = {
        "file": file.select("rel_path", "language", "line_count", "parse_error"),
        "symbols": ix.located_symbols().where(F.col("rel_path") == rel_path).orderBy("line_start", "symbol_id").select("kind", "name", "parent_name", "line_start", "line_end", "complexity", text.first_line(F.col("docstring")).alias("docstring")),
        "imports": ix.imports.join(here, "file_id", "left_semi").orderBy("line_no", "module", "name").select("module", "name", "alias", "is_from", "line_no"),
    }
    if ix.diagnostics is not None:
        out["diagnostics"] = ix.diagnostics.where("is_resolved = 0").join(here, "file_id", "left_semi").orderBy("line_no").select("rule_id", "severity", "message", "line_no")
    return out


def overview(ix: Index, level: int = 1) -> dict:
    out = {"stats": stats(ix), "languages": languages(ix), "parse_errors": ix.files.where("parse_error is not null").orderBy("rel_path").select("rel_path", "parse_error").limit(5)}
    if level >= 1:
        out |= {"modules": modules(ix), "key_classes": key_classes(ix), "depends_on": module_dependencies(ix)}
    return out
