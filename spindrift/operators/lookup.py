"""Symbols, callers, callees, references and their context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .index import Index
from .postings import trigrams_of_pattern

SITE = ("rel_path", "line_no", "callee_expr", "caller_name", "caller_kind", "caller_class")
#: One order for call sites, whatever the plan.
SITE_ORDER = ("rel_path", "line_no", "callee_expr", "caller_name", "call_id")
SYMBOL = ("symbol_id", "rel_path", "parent_name", "kind", "name", "return_type", "docstring", "line_start", "line_end", "complexity", "is_async")


def _candidates(ix: Index, needles: list[str]) -> DataFrame | None:
    """(key): symbols whose names may contain one of the needles, by the stored trigrams; None if these cannot tell."""
    if ix.text_index is None or not needles:
        return None
    parts = [ix.text_index.holders("name", trigrams_of_pattern(n)) for n in needles]
    return None if any(p is None for p in parts) else reduce(DataFrame.unionByName, parts).distinct()


def matching_symbols(ix: Index, name: str | None = None, kind: str | None = None, file_pattern: str | None = None, parent_name: str | None = None, near: list[str] | None = None) -> DataFrame:
    """Symbols that meet every criterion.  near: what the caller will ask names to contain, any one of it."""
    found = ix.located_symbols(only=_candidates(ix, [name] if name else near or []))
    if name:
        found = found.where(text.contains_like(F.col("name"), name))
    if kind:
        found = found.where(F.col("kind") == kind)
    if file_pattern:
        found = found.where(text.contains_like(F.col("rel_path"), file_pattern))
    if parent_name:
        found = found.where(text.contains_like(F.col("parent_name"), parent_name))
    return found


def find_symbols(ix: Index, limit: int = 50, **criteria) -> DataFrame:
    """Symbols that meet every criterion given, by path and line."""
    return matching_symbols(ix, **criteria).orderBy("rel_path", "line_start", "symbol_id").limit(limit).select(*SYMBOL)


def callers(ix: Index, name: str, limit: int | None = 50, compat: bool = False) -> DataFrame:
    """Call sites of a name, by path and line."""
    found = ix.call_sites().where(text.names_symbol(F.col("callee_expr"), name, compat)).orderBy(*SITE_ORDER)
    return (found.limit(limit) if limit else found).select(*SITE)


def callers_of_each(ix: Index, seeds: DataFrame, limit: int) -> DataFrame:
    """Up to ``limit`` call sites of each name in seeds (column seed): one join on the last segment, ranked per seed.

    The rank by path, line and expression comes before callers are looked up, and Spark takes it in every task before the
    shuffle too: of a name in half of all calls, ``limit`` sites a task go on (and those that tie with the last).
    """
    named = ix.calls.withColumn("callee_last", text.last_segment(F.col("callee_expr"))).join(seeds, F.col("seed") == F.col("callee_last"))
    placed = named.join(ix.files.select("file_id", "rel_path"), "file_id")
    near = F.rank().over(Window.partitionBy("seed").orderBy("rel_path", "line_no", "callee_expr"))
    joined = ix.with_callers(placed.withColumn("near", near).where(F.col("near") <= limit).drop("near"))
    rank = F.row_number().over(Window.partitionBy("seed").orderBy(*SITE_ORDER))
    return joined.withColumn("rank", rank).where(F.col("rank") <= limit).select("seed", "rank", *SITE)


def callees(ix: Index, symbol_id: int) -> DataFrame:
    """Calls that a symbol makes, with their category, by line."""
    own = ix.calls.where(F.col("caller_id") == symbol_id).join(ix.files.select("file_id", "rel_path"), "file_id")
    return own.orderBy("line_no", "callee_expr", "call_id").select("rel_path", "line_no", "callee_expr", text.call_category(F.col("callee_expr")).alias("category"))


def references(ix: Index, name: str) -> DataFrame:
    found = ix.refs.where(F.col("name") == name).join(ix.files.select("file_id", "rel_path"), "file_id")
    return found.orderBy("rel_path", "line_no", "target").select("rel_path", "line_no", "ref_kind", "target", "name")


def resolve(ix: Index, name: str, kind: str | None = None) -> dict | None:
    """The symbol a name means: the first of exactly this name, else the first that contains it."""
    exact = ix.located_symbols().where(F.col("name") == name)
    if kind:
        exact = exact.where(F.col("kind") == kind)
    row = exact.orderBy("symbol_id").first() or matching_symbols(ix, name=name, kind=kind).orderBy("rel_path", "line_start", "symbol_id").first()
    return row.asDict() if row else None


def diagnostics_between(ix: Index, file_id: int, first: int, last: int) -> DataFrame:
    here = ix.diagnostics.where((F.col("file_id") == file_id) & F.col("line_no").between(first, last) & (F.col("is_resolved") == 0))
    return here.orderBy("line_no", "rule_id").select("rule_id", "severity", "message", "line_no")


def siblings(ix: Index, symbol: dict, limit: int = 20) -> DataFrame:
    """Other members of the symbol's parent; for a class, other top-level symbols of its file."""
    if symbol["parent_id"] is not None:
        same = ix.symbols.where(F.col("parent_id") == symbol["parent_id"])
    else:
        same = ix.symbols.where((F.col("file_id") == symbol["file_id"]) & F.col("parent_id").isNull())
    return same.where(F.col("symbol_id") != symbol["symbol_id"]).orderBy("line_start", "symbol_id").limit(limit).select("kind", "name", "line_start")


def members(ix: Index, class_id: int) -> DataFrame:
    own = ix.symbols.where(F.col("parent_id") == class_id)
    return own.orderBy("line_start", "symbol_id").select("symbol_id", "kind", "name", "line_start", "line_end", "complexity", text.preview(F.col("docstring"), 80).alias("docstring"))


def class_callers(ix: Index, class_id: int, class_name: str, limit: int = 30, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Call sites outside the class of the class itself and of its members (up to ``limit`` per name), one row per
    (caller, file, line), under the first of the names in the order class, members by name.  via_member is ``__init__``
    for the class."""
    inner = ix.symbols.where(F.col("parent_id") == class_id)
    if kinds:
        inner = inner.where(F.col("kind").isin(*kinds))
    seeds = inner.select("name").distinct().select(F.col("name").alias("seed"), F.lit(1).alias("step"))
    seeds = seeds.unionByName(ix.spark.range(1).select(F.lit(class_name).alias("seed"), F.lit(0).alias("step")))
    found = seeds.join(callers_of_each(ix, seeds.select("seed").distinct(), limit), "seed").where(~F.coalesce(F.col("caller_class") == class_name, F.lit(False)))
    first = Window.partitionBy(F.coalesce("caller_name", F.lit("")), "rel_path", "line_no").orderBy("step", "seed", "rank")
    kept = found.withColumn("k", F.row_number().over(first)).where("k = 1")
    return kept.select(F.when(F.col("step") == 0, F.lit("__init__")).otherwise(F.col("seed")).alias("via_member"), *SITE)


def function_context(ix: Index, symbol: dict) -> dict:
    """What is around a symbol's row, taken as a function or method: siblings in its parent, callers, callees, references
    and findings, as DataFrames."""
    sid = symbol["symbol_id"]
    out: dict = {"symbol": symbol, "siblings": siblings(ix, symbol) if symbol["parent_id"] is not None else None}
    if ix.diagnostics is not None:
        out["diagnostics"] = diagnostics_between(ix, symbol["file_id"], symbol["line_start"], symbol["line_end"])
    out["callers"] = callers(ix, symbol["name"], 30)
    out["callees"] = callees(ix, sid)
    out["refs"] = ix.refs.where(F.col("symbol_id") == sid).orderBy("line_no", "target").select("ref_kind", "target", "name", "line_no")
    return out


def context(ix: Index, name: str, kind: str | None = None, source: DataFrame | None = None, inline_lines: int = 0) -> dict | None:
    """Everything around a symbol: a dict of the symbol's row and DataFrames (lazy, but for the symbol itself).

    source: (rel_path, content), for the text of symbols of at most inline_lines lines.
    """
    symbol = resolve(ix, name, kind)
    if symbol is None:
        return None
    out = function_context(ix, symbol)
    if ix.annotations is not None:
        out["annotations"] = ix.annotations.where((F.col("rel_path") == symbol["rel_path"]) & (F.col("qualified_name") == symbol["qualified_name"])).orderBy("created_at", "annotation_id")
    if symbol["kind"] == "class":
        sid = symbol["symbol_id"]
        own = ix.symbols.where(F.col("parent_id") == sid).select(F.col("symbol_id").alias("caller_id"), F.col("name").alias("from_method"))
        called = ix.calls.join(own, "caller_id").orderBy("line_no", "callee_expr", "call_id")
        del out["refs"]
        out["siblings"] = siblings(ix, symbol)
        out["members"] = members(ix, sid)
        out["callers"] = class_callers(ix, sid, symbol["name"])
        out["callees"] = called.select("from_method", "line_no", "callee_expr", text.call_category(F.col("callee_expr")).alias("category"))
    if source is not None and symbol["line_end"] - symbol["line_start"] + 1 <= inline_lines:
        here = source.where(F.col("rel_path") == symbol["rel_path"])
        out["source"] = here.select(text.source_slice(F.col("content"), F.lit(symbol["line_start"]), F.lit(symbol["line_end"])).alias("source"))
    return out
