"""Quality rules with cross-document line frequencies, in DataFrame functions only.

Base rules look at one text.  The corpus rule hashes normalised lines (lower-cased, digits as 0, white space as one
space), counts the distinct documents per host that hold each line (copies of one text count once), and removes lines
above both limits: more than ``max_docs`` documents and more than ``max_share`` of the host's.  A document that keeps
less than ``min_kept`` of its words is depleted and rejected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SPACE = r"[\x20\x09-\x0D]+"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeated_words(words: Column, window: int) -> Column:
    """Words covered by windows of ``window`` words that occur twice or more in the text, the first included."""

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(starts, k + 1) - p, F.lit(window))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def repeats(grams: Column) -> Column:
        keyed = F.array_sort(F.transform(grams, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))

        def starts(s: Column) -> Column:
            h = lambda k: F.get(s, k)["h"]
            twin = lambda x, k: (h(k - 1) == x["h"]) | (h(k + 1) == x["h"])
            return F.sort_array(F.transform(F.filter(s, lambda x, k: F.coalesce(twin(x, k), h(k - 1) == x["h"], h(k + 1) == x["h"], F.lit(False))), lambda x: x["k"]))

        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), 0).otherwise(let(let(keyed, starts), covered))

    grams = F.transform(F.sequence(F.lit(1), F.size(words) - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, window)))
    return F.when(F.size(words) < window + 1, 0).otherwise(let(grams, repeats))


def base_measures(text: Column) -> Column:
    """struct of the five per-text measures (longs), zero for a null text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.struct(
        let(words_of(text), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w, 8).alias("r"))).alias("w"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )


def normalised_lines(text: Column) -> Column:
    """array of struct(h, n): the hash of each normalised line that holds a word, and its words."""
    plain = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), "[0-9]", "0"), SPACE, " "))
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), plain), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.split(x, " ")).alias("n")))


def frequent_lines(df: DataFrame, max_docs: int, max_share: float, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(host, lines): per host the hashes of lines above both limits.

    Per-line counts are pre-aggregated before their shuffle, so a line in a third of all documents is one row a task.
    A host has at most (lines a document) / max_share such lines.
    """
    docs = df.select(F.col(f"`{host_col}`").alias("host"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("t"), F.col(f"`{text_col}`").alias("text"))
    hosts = docs.groupBy("host").agg(F.countDistinct("t").alias("n_host"))
    held = docs.select("host", "t", F.explode(F.array_distinct(F.transform(normalised_lines(F.col("text")), lambda x: x["h"]))).alias("h"))
    counts = held.groupBy("host", "h").agg(F.countDistinct("t").alias("n_docs")).where(F.col("n_docs") > max_docs)
    over = counts.join(hosts, counts["host"].eqNullSafe(hosts["host"])).where(F.col("n_docs") > F.col("n_host") * max_share)
    return over.groupBy(counts["host"].alias("host")).agg(F.collect_list("h").alias("lines"))


def judge(
    df: DataFrame, max_docs: int = 20, max_share: float = 0.10, min_kept: float = 0.2, min_words: int = 20,
    max_repeat_percent: int = 30, text_col: str = "text", host_col: str = "source", prefix: str = "quality", held: bool = False,
) -> DataFrame:
    """df with one more column, named prefix: struct(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_kept_words, kept), and with held also held_lines, the hashes of the frequent lines in the text.

    Null and empty texts have no words and fail the base rules; long texts and lines are read whole.  A null host is a host of its own.  Repeated rows are one
    document in the line counts and keep one verdict; an empty df gives no rows.  The per-host lists of frequent lines are written first, so that
    Spark knows their size when it chooses between a broadcast and a shuffled join.
    """
    frequent = materialize(frequent_lines(df, max_docs, max_share, text_col, host_col), "lines")
    frequent = frequent.select(F.col("host").alias("__host"), F.col("lines").alias("__lines"))
    text = F.col(f"`{text_col}`")
    joined = df.join(frequent, df[f"`{host_col}`"].eqNullSafe(F.col("__host")), "left")
    kept_words = F.when(F.col("__lines").isNull(), F.col("__m.w.n")).otherwise(
        F.aggregate(F.filter(normalised_lines(text), lambda x: ~F.array_contains(F.col("__lines"), x["h"])), F.lit(0), lambda a, x: a + x["n"])
    )
    n, r = F.col("__m.w.n").cast("long"), F.col("__m.w.r").cast("long")
    failed = (n < min_words) | (100 * r > max_repeat_percent * n)
    verdict = F.struct(
        n.alias("n_words"), F.col("__m.word_chars").alias("word_chars"), F.col("__m.n_symbols").alias("n_symbols"), F.col("__m.n_dup_lines").alias("n_dup_lines"), r.alias("n_repeat_words"),
        failed.alias("base_failed"), F.col("__k").cast("long").alias("n_kept_words"), (~failed & (F.col("__k") >= n * min_kept)).alias("kept"),
        *([F.coalesce(F.array_intersect(F.transform(normalised_lines(text), lambda x: x["h"]), F.col("__lines")), F.array().cast("array<long>")).alias("held_lines")] if held else []),
    )
    return joined.withColumn("__m", base_measures(text)).withColumn("__k", kept_words).select(*[df[f"`{c}`"] for c in df.columns], verdict.alias(prefix))


def passing(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **options) -> DataFrame:
    """The rows of df that judge keeps, and representatives of the depleted ones.

    Lines that more than ``max_share`` of a host's documents hold may be template output or the body of many near copies.
    So for each frequent line of a host that no kept document holds, the depleted document of smallest id that holds it
    stays (one without an id only where no other does); thus no line is lost with all of its documents.
    """
    judged = judge(df, text_col=text_col, host_col=host_col, prefix="__q", held=True, **options).where("not __q.base_failed")
    judged = materialize(judged.select(*[df[f"`{c}`"] for c in df.columns], F.col("__q.kept").alias("__kept"), F.col("__q.held_lines").alias("__held")), "judged")
    key = F.struct(F.col(f"`{id_col}`").isNull().alias("unnamed"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{text_col}`").alias("t"))
    held = judged.select(F.col(f"`{host_col}`").alias("host"), "__kept", key.alias("key"), F.explode("__held").alias("h"))
    first = held.groupBy("host", "h").agg(F.max("__kept").alias("safe"), F.min("key").alias("key")).where("not safe")
    first = first.select(F.col("host").alias("__host"), F.col("key.id").alias("__id"), F.col("key.t").alias("__t")).distinct()
    same = F.col(f"`{host_col}`").eqNullSafe(F.col("__host")) & F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.xxhash64(f"`{text_col}`") == F.col("__t"))
    rows = judged.where("__kept").unionByName(judged.where("not __kept").join(first, same, "left_semi"))
    return rows.drop("__kept", "__held")


def quality_rules(df: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """doc_id, the five measures, base_failed, n_kept_words and kept, one row per row of df (see judge)."""
    q = "quality"
    columns = [*MEASURES, "base_failed", "n_kept_words", "kept"]
    need = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{options.pop('text_col', 'text')}`").alias("text"), F.col(f"`{options.pop('host_col', 'source')}`").alias("source"))
    return judge(need, prefix=q, **options).select("doc_id", *[F.col(f"{q}.{c}").alias(c) for c in columns])


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, source FROM documents),
w AS (SELECT doc_id, source, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
g AS (SELECT doc_id, k, array_to_string(list_slice(words, k, k + 7), ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS k FROM w WHERE len(words) >= 8)),
rep AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
cov AS (SELECT doc_id, sum(least(8, coalesce(nxt - k, 8))) AS n FROM (SELECT doc_id, k, lead(k) OVER (PARTITION BY doc_id ORDER BY k) AS nxt FROM rep) GROUP BY doc_id),
l AS (SELECT doc_id, source, text, trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d)),
lw AS (SELECT *, len(string_split(line, ' ')) AS n FROM l WHERE line <> ''),
f AS (SELECT c.source, c.line FROM (SELECT source, line, count(DISTINCT text) AS n_docs FROM lw GROUP BY source, line) c JOIN (SELECT source, count(DISTINCT text) AS n_host FROM d GROUP BY source) h
      ON c.source IS NOT DISTINCT FROM h.source WHERE c.n_docs > 20 AND c.n_docs > h.n_host * 0.1),
k AS (SELECT lw.doc_id, sum(CASE WHEN f.line IS NULL THEN lw.n ELSE 0 END) AS n FROM lw LEFT JOIN f ON lw.source IS NOT DISTINCT FROM f.source AND lw.line = f.line GROUP BY lw.doc_id),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(k.n, 0) AS BIGINT) AS n_kept_words
  FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id LEFT JOIN k ON w.doc_id = k.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, n_kept_words,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_kept_words >= n_words * 0.2 AS kept FROM m
"""
