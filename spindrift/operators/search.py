"""Ranked search: the name ladder, token counts, and BM25 over texts or over a stored index of them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.porter import stem, stem_tokens
from . import postings
from .index import Index
from .lookup import matching_symbols
from .postings import K1, LEAST_IDF, B

HIT = ("type", "symbol_id", "kind", "name", "parent_name", "rel_path", "line_start", "score")


def by_name(ix: Index, query: str, kind: str | None = None, limit: int = 40) -> DataFrame:
    """Symbols whose name contains the query, best score first."""
    found = matching_symbols(ix, name=query, kind=kind).withColumn("score", text.name_score(F.col("name"), query).cast("double"))
    return found.orderBy(F.desc("score"), "rel_path", "line_start", "symbol_id").limit(limit)


def by_tokens(ix: Index, query: str, kind: str | None = None, limit: int = 60) -> DataFrame:
    """Symbols whose name contains tokens of the query, 20 a distinct token; up to ``limit`` by path for each token."""
    tokens = sorted(set(text.query_tokens(query)))
    if not tokens:
        return matching_symbols(ix).limit(0).withColumn("score", F.lit(0.0))
    hits = F.array_compact(F.array(*[F.when(text.contains_like(F.col("name"), t), F.lit(t)) for t in tokens]))
    found = matching_symbols(ix, kind=kind, near=tokens).withColumn("token", F.explode(hits))
    rank = F.row_number().over(Window.partitionBy("token").orderBy("rel_path", "line_start", "symbol_id"))
    counted = found.withColumn("k", rank).where(F.col("k") <= limit).groupBy("symbol_id").agg((F.count("*") * 20.0).alias("score"))
    return ix.located_symbols().join(counted, "symbol_id")


# -- BM25 ---------------------------------------------------------------------------------------------------------------


def collection(docs: DataFrame, columns: list[str]) -> dict:
    """Number of rows and their average length in tokens, as one small row."""
    length = sum((text.token_count(F.coalesce(F.col(c), F.lit(""))) for c in columns), F.lit(0))
    row = docs.agg(F.count("*").alias("n"), F.avg(length).alias("mean")).first()
    return row.asDict()


def bm25(docs: DataFrame, key: str, columns: list[str], query: str, limit: int | None = 20, stemmed: bool = True) -> DataFrame:
    """(key, score) of rows that hold a term of the query.

    Only postings of the query's terms leave the scan: the filter runs before the shuffle, and rows without any term as
    a substring are not cut into tokens.  Terms in half of the rows or more weigh next to nothing, but not nothing.
    """
    terms = sorted({stem(t) if stemmed else t for t in _tokens_of(query)})
    facts = collection(docs, columns)
    tokens: Column = F.concat(*[text.word_tokens(F.coalesce(F.col(c), F.lit(""))) for c in columns])
    if not stemmed:  # a stem need not be a substring of its word
        low = [text.fold_accents(F.lower(F.coalesce(F.col(c), F.lit("")))) for c in columns]
        docs = docs.where(text.any_of([F.contains(x, F.lit(t)) for t in terms for x in low]))
    tokens = stem_tokens(tokens) if stemmed else tokens
    listed = docs.select(F.col(key).alias("key"), tokens.alias("t"))
    counts = F.transform(F.array(*[F.lit(t) for t in terms]), lambda q: F.struct(q.alias("term"), F.size(F.filter("t", lambda x: x == q)).alias("tf")))
    hits = listed.select("key", F.size("t").alias("length"), F.explode(F.filter(counts, lambda x: x["tf"] > 0)).alias("p")) if terms else listed.select("key", F.size("t").alias("length"), F.struct(F.lit("").alias("term"), F.lit(0).alias("tf")).alias("p")).limit(0)
    hits = hits.select("key", "length", "p.term", "p.tf")
    n, mean = facts["n"] or 0, facts["mean"] or 1.0
    seen = F.col("n_term")
    idf = hits.groupBy("term").agg(F.count("*").alias("n_term")).select("term", F.greatest(F.log((F.lit(n) - seen + 0.5) / (seen + 0.5)), F.lit(0.0)).alias("x"))
    idf = idf.select("term", F.when(F.col("x") > 0, F.col("x")).otherwise(F.lit(LEAST_IDF)).alias("idf"))  # one row per query term
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(float(mean))))
    scored = hits.join(F.broadcast(idf), "term").groupBy("key").agg(F.sum(part).alias("score"))
    ranked = scored.orderBy(F.desc(F.round("score", 9)), "key")  # equal terms score equally, whatever the order of a sum
    return ranked.limit(limit) if limit else ranked


def _tokens_of(query: str) -> list[str]:
    """Terms of a query as the text tokeniser makes them; none if the query has other syntax in it."""
    tokens = text.query_tokens(query)
    if any(re.search(r"[^A-Za-z0-9_\x80-\U0010ffff]", t) for t in tokens):
        return []
    return [text.fold_word(t) for t in tokens if t not in ("or", "and", "not")]


SYMBOL_TEXT, FILE_TEXT = ["name", "qualified_name", "docstring"], ["rel_path", "symbol_names", "docstrings"]


def text_rows(ix: Index) -> dict[str, DataFrame]:
    """What a stored text index of ix has: words of symbols and of files, by their stems, and trigrams of symbol names."""
    return {
        "symbol": postings.word_lists(ix.located_symbols(), "symbol_id", "file_id", SYMBOL_TEXT, True),
        "file": postings.word_lists(file_documents(ix), "file_id", "file_id", FILE_TEXT, True),
        "name": postings.trigram_lists(ix.symbols, "symbol_id", "file_id", "name"),
    }


def _stored(ix: Index, kind: str, query: str, limit: int, stemmed: bool) -> DataFrame | None:
    """Scores from the stored index, which has stems."""
    if ix.text_index is None or not stemmed:
        return None
    return ix.text_index.scores(kind, sorted({stem(t) for t in _tokens_of(query)}), limit)


def search_symbols(ix: Index, query: str, limit: int = 30, stemmed: bool = True) -> DataFrame:
    """BM25 over names, qualified names and docstrings of symbols; from the stored index, or else from the texts."""
    found = _stored(ix, "symbol", query, limit, stemmed)
    docs = ix.located_symbols() if found is None else ix.located_symbols(only=found.select("key"))
    found = bm25(docs, "symbol_id", SYMBOL_TEXT, query, limit, stemmed) if found is None else found
    return docs.join(found.withColumnRenamed("key", "symbol_id"), "symbol_id")


def file_documents(ix: Index) -> DataFrame:
    """(file_id, rel_path, symbol_names, docstrings): the symbols' names and docstrings of each file, joined by spaces."""
    listed = ix.symbols.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("symbol_id", "name", "docstring"))).alias("x"))
    own = listed.select("file_id", F.array_join(F.transform("x", lambda x: x["name"]), " ").alias("symbol_names"), F.array_join(F.transform("x", lambda x: x["docstring"]), " ").alias("docstrings"))
    return ix.files.select("file_id", "rel_path").join(own, "file_id", "left")


def search_files(ix: Index, query: str, limit: int = 20, stemmed: bool = True) -> DataFrame:
    """BM25 over paths, symbol names and docstrings of files; from the stored index, or else from the texts."""
    found = _stored(ix, "file", query, limit, stemmed)
    if found is None:
        found = bm25(file_documents(ix), "file_id", FILE_TEXT, query, limit, stemmed)
    return ix.files.select("file_id", "rel_path").join(found.withColumnRenamed("key", "file_id"), "file_id")


def search(ix: Index, query: str, kind: str | None = None, limit: int = 20) -> DataFrame:
    """The best hits of four strategies: name, tokens of the name, symbol texts (0.8 of BM25), file texts (0.3).

    A strategy counts only if the ones before it found fewer than ``limit``; a symbol keeps its first strategy.  All
    four are one plan, gated by running counts, rather than an action for each.
    """
    hit = lambda df, k, weight=1.0: df.select(F.lit("symbol").alias("type"), "symbol_id", "kind", "name", "parent_name", "rel_path", "line_start", (F.col("score") * weight).alias("score"), F.lit(k).alias("step"))
    branches = [hit(by_name(ix, query, kind, 2 * limit), 1)]
    if len(text.query_tokens(query)) > 1:
        branches.append(hit(by_tokens(ix, query, kind, 3 * limit), 2))
    fts = search_symbols(ix, query, limit)
    branches.append(hit(fts.where(F.col("kind") == kind) if kind else fts, 3, 0.8))
    found = branches[0]
    for other in branches[1:]:
        found = found.unionByName(other)
    once = found.withColumn("k", F.row_number().over(Window.partitionBy("symbol_id").orderBy("step"))).where("k = 1").drop("k")
    files = search_files(ix, query, limit).join(once.select("rel_path").distinct(), "rel_path", "left_anti")
    nothing = F.lit(None)
    files = files.select(F.lit("file").alias("type"), nothing.cast("long").alias("symbol_id"), nothing.cast("string").alias("kind"), nothing.cast("string").alias("name"), nothing.cast("string").alias("parent_name"), "rel_path", nothing.cast("int").alias("line_start"), (F.col("score") * 0.3).alias("score"), F.lit(4).alias("step"))
    counts = once.groupBy("step").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("step", "n"))).alias("n"))
    before = F.aggregate(F.sequence(F.lit(0), F.col("step") - 1), F.lit(0).cast("long"), lambda a, s: a + F.coalesce(F.col("n")[s], F.lit(0)))
    gated = once.unionByName(files).crossJoin(counts).where(before < limit)  # counts: one row
    return gated.orderBy(F.desc("score"), "step", "rel_path", "line_start", "symbol_id").limit(limit).select(*HIT)
