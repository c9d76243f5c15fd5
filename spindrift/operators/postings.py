"""A stored inverted index: postings in blocks by term and key range, term counts, and lengths, as relations of a store.

A block holds the postings of one term for one slot of ``SLOT`` consecutive keys, as arrays, with what bounds its scores
whatever the collection becomes: the largest term count and the smallest length.  Blocks lie in folders by a bucket of the
term's hash, sorted by term, so a query reads the row groups of its own terms and nothing else.

A change appends: the blocks of new rows, and for rows that go the same term counts and lengths with a minus sign.  Which
rows are gone is known by their file (``gone``), and compaction is the store's.  Ids are never used twice.

The best k: a slot's score is at most the sum of its blocks' bounds.  The slots of the highest bounds are scored first,
which gives the k-th best score so far, and then only slots whose bound reaches it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.porter import stem_tokens

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Keys of a slot, buckets of terms, parts in which a bucket is written, and slots that a task makes blocks of at a time.
SLOT, BUCKETS, PARTS, HELD_SLOTS = 1024, 16, 64, 4
RELATIONS = ("text_postings", "text_terms", "text_sizes")


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _by_slot(docs: DataFrame, key: str) -> DataFrame:
    """docs with every slot's rows together, by key: of each term a slot is then one block, made where its rows are."""
    return docs.repartition(F.floor(F.col(key) / SLOT)).sortWithinPartitions(key)


def word_lists(docs: DataFrame, key: str, file_id: str | None, columns: list[str], stemmed: bool) -> DataFrame:
    """(key, file_id, tokens) of the rows' columns together, dealt by slots of keys."""
    tokens: Column = F.concat(*[text.word_tokens(F.coalesce(F.col(c), F.lit(""))) for c in columns])
    own = F.col(file_id) if file_id else F.lit(None)
    return _by_slot(docs, key).select(F.col(key).cast("long").alias("key"), own.cast("long").alias("file_id"), (stem_tokens(tokens) if stemmed else tokens).alias("tokens"))


def trigram_lists(docs: DataFrame, key: str, file_id: str | None, column: str) -> DataFrame:
    """(key, file_id, tokens): the distinct three-letter parts of a column, letter case aside; dealt by slots of keys."""
    low = F.lower(F.coalesce(F.col(column), F.lit("")))
    parts = F.when(F.length(low) >= 3, F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))
    own = F.col(file_id) if file_id else F.lit(None)
    return _by_slot(docs, key).select(F.col(key).cast("long").alias("key"), own.cast("long").alias("file_id"), F.array_distinct(parts).alias("tokens"))


BLOCK = "term string, slot long, max_tf int, min_length int, rows array<struct<key:long,tf:int,length:int,file_id:long>>"


def _blocks_of(rows: pa.Table) -> pa.RecordBatch:
    """The blocks of whole slots of rows (key, file_id, tokens), by key."""
    ids, lists = rows.column(0).combine_chunks(), rows.column(2).combine_chunks()
    n, keys, unnamed = len(ids), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    words = pc.list_flatten(lists).dictionary_encode()
    pairs, tf = np.unique(words.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), lengths), return_counts=True)
    code, at = pairs // n, pairs % n
    slot = keys // SLOT
    place = 2 * slot[at] + unnamed[at]
    start = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (place[1:] != place[:-1])])) if len(pairs) else np.zeros(0, np.int64)
    largest = lambda f, x: f.reduceat(x, start).astype(np.int32) if len(pairs) else np.zeros(0, np.int32)
    named = ["key", "tf", "length", "file_id"]
    own = pa.StructArray.from_arrays([pa.array(keys[at], pa.int64(), mask=unnamed[at]), pa.array(tf.astype(np.int32)), pa.array(lengths[at].astype(np.int32)), rows.column(1).combine_chunks().take(pa.array(at))], named)
    lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(pairs)).astype(np.int32)), own)
    slots = pa.array(slot[at[start]], pa.int64(), mask=unnamed[at[start]])
    return pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(code[start])), slots, pa.array(largest(np.maximum, tf)), pa.array(largest(np.minimum, lengths[at])), lists], ["term", "slot", "max_tf", "min_length", "rows"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, file_id, tokens) by key, each slot's together: their blocks, some slots at a time."""
    held: pa.Table | None = None
    for batch in batches:
        for at in range(0, batch.num_rows, SLOT):
            part = pa.Table.from_batches([batch.slice(at, SLOT)])
            held = part if held is None else pa.concat_tables([held, part])
            if held.num_rows >= HELD_SLOTS * SLOT:
                slot = pc.fill_null(held.column(0), -1).to_numpy() // SLOT
                whole = int(np.searchsorted(slot == slot[-1], True))  # the last slot may go on
                if whole:
                    yield _blocks_of(held.slice(0, whole))
                    held = held.slice(whole)
    if held is not None:
        yield _blocks_of(held)


def _dealt(df: DataFrame, spread: Column, *then: str) -> DataFrame:
    """Rows in order of bucket, kind and term; a bucket in up to PARTS tasks and files."""
    order = ("bucket", "kind", "term", *then)
    return df.repartition("bucket", F.pmod(spread, F.lit(PARTS))).sortWithinPartitions(*order)


def _counts(blocks: DataFrame, sign: int) -> DataFrame:
    counted = blocks.groupBy("kind", "term").agg((F.sum(F.size("rows.tf")) * sign).alias("n")).withColumn("bucket", bucket_of(F.col("term")))
    return _dealt(counted, F.lit(0))


def relations_of(kinds: dict[str, DataFrame], sign: int = 1) -> dict[str, DataFrame | Callable]:
    """The relations' new rows for rows (key, file_id, tokens) of each kind, as the lists above deal them; with sign -1, only
    the counts to be taken away.

    A slot's blocks are made in its own task, so single words are not shuffled.  What is counted from the postings is a
    function of a reader of what the same commit has written.
    """
    together = lambda parts: reduce(DataFrame.unionByName, parts)
    blocks = together([rows.select("key", "file_id", "tokens").mapInArrow(_blocks, BLOCK).select(F.lit(kind).alias("kind"), "*", bucket_of(F.col("term")).alias("bucket")) for kind, rows in kinds.items()])
    if sign < 0:
        sizes = [rows.agg(F.lit(kind).alias("kind"), (F.count("*") * sign).alias("n"), (F.coalesce(F.sum(F.size("tokens")), F.lit(0)) * sign).alias("tokens")) for kind, rows in kinds.items()]
        return {"text_terms": _counts(blocks, sign), "text_sizes": together(sizes)}

    def sizes_of(written: Callable[[str], DataFrame]) -> DataFrame:
        n = together([rows.agg(F.lit(kind).alias("kind"), F.count("*").alias("n")) for kind, rows in kinds.items()])
        own = F.aggregate(F.col("rows.tf"), F.lit(0).cast("long"), lambda a, x: a + x)
        found = written("text_postings").groupBy("kind").agg(F.sum(own).alias("tokens"))
        return n.join(found, "kind", "left").select("kind", "n", F.coalesce("tokens", F.lit(0)).alias("tokens"))

    return {"text_postings": _dealt(blocks, F.xxhash64("term", F.floor(F.col("slot") / 64)), "slot"), "text_terms": lambda written: _counts(written("text_postings"), 1), "text_sizes": sizes_of}


class TextIndex:
    """Search over the relations RELATIONS of a store, and of the files that are gone (file_id)."""

    def __init__(self, tables: dict[str, DataFrame], gone: DataFrame | None = None):
        self.tables, self.gone = tables, gone

    def _of_terms(self, name: str, kind: str, terms: Iterable[str]) -> DataFrame:
        """The rows of some terms of a kind: the buckets prune folders, the terms row groups."""
        terms = list(terms)
        spark = self.tables[name].sparkSession
        listed = spark.range(1).select(F.array(*[bucket_of(F.lit(t)) for t in terms]).alias("b")).first()["b"] if terms else []
        return self.tables[name].where(F.col("bucket").isin(listed) & (F.col("kind") == kind) & F.col("term").isin(terms))

    def frequencies(self, kind: str, terms: Iterable[str]) -> dict[str, int]:
        """How many rows of a kind hold each of the terms; the driver gets a number a term."""
        found = self._of_terms("text_terms", kind, terms).groupBy("term").agg(F.sum("n").alias("n")).collect()
        return {r["term"]: r["n"] for r in found if r["n"] > 0}

    def collection(self, kind: str) -> tuple[int, float]:
        """The rows of a kind and their mean length."""
        row = self.tables["text_sizes"].where(F.col("kind") == kind).agg(F.sum("n").alias("n"), F.sum("tokens").alias("t")).first()
        return (row["n"] or 0, row["t"] / row["n"]) if row["n"] else (0, 1.0)

    def _exploded(self, blocks: DataFrame) -> DataFrame:
        rows = blocks.select("term", F.explode("rows").alias("x")).select("term", "x.*")
        return rows if self.gone is None else rows.join(self.gone.select("file_id"), "file_id", "left_anti")

    def scores(self, kind: str, terms: list[str], limit: int | None = None, digits: int = 9) -> DataFrame:
        """(key, score) by BM25 of the rows that hold any of the terms; the best ``limit``, first the best, or all.

        Scores that agree to so many digits are equal, and the smaller key goes first.  Terms in half of the rows or more
        weigh next to nothing, but not nothing.
        """
        seen, (n, mean) = self.frequencies(kind, terms), self.collection(kind)
        idf = {t: _idf(n, m) for t, m in seen.items()}
        weight = F.create_map(*[F.lit(x) for t in idf for x in (t, idf[t])])[F.col("term")] if idf else F.lit(0.0)
        part = lambda tf, length: weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(float(mean))))
        blocks = self._of_terms("text_postings", kind, idf)

        def exact(some: DataFrame) -> DataFrame:
            found = self._exploded(some).groupBy("key").agg(F.sum(part(F.col("tf"), F.col("length"))).alias("score"))
            ranked = found.orderBy(F.desc(F.round("score", digits)), "key")  # equal terms score equally, whatever the order of a sum
            return ranked.limit(limit) if limit else ranked

        if not limit:
            return exact(blocks)
        bounds = blocks.groupBy("slot").agg(F.sum(part(F.col("max_tf"), F.col("min_length"))).alias("bound"))
        first = bounds.orderBy(F.desc("bound"), "slot").limit(limit)  # a slot that counts has a row at least
        least = exact(blocks.join(F.broadcast(first.select("slot")), "slot", "left_semi")).agg(F.count("*").alias("n"), F.min("score").alias("s")).first()
        reached = least["s"] - 2 * 10.0**-digits if least["n"] == limit else 0.0  # what rounds to the least is within one
        return exact(blocks.join(bounds.where(F.col("bound") >= reached).select("slot"), "slot", "left_semi"))

    def holders(self, kind: str, terms: list[str], most: int = 3) -> DataFrame | None:
        """(key): rows that hold the ``most`` rarest of the terms; a superset of those that hold all.  None without terms."""
        terms = sorted(set(terms))
        if not terms:
            return None
        seen = self.frequencies(kind, terms)
        if len(seen) < len(terms):  # some term is nowhere
            return self._exploded(self._of_terms("text_postings", kind, [])).select("key")
        rare = sorted(terms, key=lambda t: (seen[t], t))[:most]
        found = self._exploded(self._of_terms("text_postings", kind, rare)).groupBy("key").agg(F.count_distinct("term").alias("n"))
        return found.where(F.col("n") == len(rare)).select("key")


def _idf(n: int, n_term: int) -> float:
    import math

    x = math.log((n - n_term + 0.5) / (n_term + 0.5))
    return x if x > 0 else LEAST_IDF


def trigrams_of_pattern(needle: str) -> list[str]:
    """Three-letter parts that every string which LIKE %needle% matches holds; % and _ in the needle match anything."""
    parts, out = needle.lower().replace("_", "%").split("%"), set()
    for part in parts:
        if "\\" not in part:
            out |= {part[i : i + 3] for i in range(len(part) - 2)}
    return sorted(out)
