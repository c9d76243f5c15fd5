"""The corpus pipeline: quality rules, language ID, SimHash near-dedup, substring dedup, best-fit packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import langid, packing, quality, simhash, substrings
from spindrift.llm.common import DOCUMENT_COLUMNS, materialize, table
from spindrift.ship import ship

#: A document whose likeliest language has less probability than this is rejected, as is one without a letter.
LEAST_SCORE = 0.4


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are not depleted by lines frequent in their host, or represent such lines.

    Null, empty and short texts go; a null source is a host of its own; repeated rows share one verdict; texts are read whole.
    Other columns than those of documents are dropped, here and in the next stages; an empty table gives no rows.
    """
    ship(spark)
    return quality.passing(docs).select(*DOCUMENT_COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a recognised language; lang is kept where it is given and predicted where it is null.

    Null texts, texts without a letter, and all texts where no row has a label, go; each of repeated rows is judged by its
    text alone; an empty table gives no rows.
    """
    ship(spark)
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    model = langid.train(docs.where(fold.isNotNull() & (fold != 2)))
    found = docs.withColumn("p", langid.predict(F.col("text"), model)).where((F.col("p.lang") != langid.UNDETERMINED) & (F.col("p.score") >= LEAST_SCORE))
    return found.withColumn("lang", F.coalesce("lang", "p.lang")).select(*DOCUMENT_COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of smallest id, of each class of near duplicates: five-word shingles, similarity 0.8 or more.

    See simhash.distinct_documents for null, equal and repeated ids and texts.
    """
    ship(spark)
    return simhash.distinct_documents(docs).select(*DOCUMENT_COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that repeat a window of an earlier document; n_chars counts what stays.

    Every row stays, also one that loses all its words (an empty text).  Null texts stay null, with the n_chars they had; rows of
    one id do not remove each other's words; rows without an id lose none; an empty table gives no rows.
    """
    ship(spark)
    found = substrings.deduplicate(docs, layout=True)
    text = F.when(F.col("text").isNotNull(), F.col("substrings.kept"))
    return found.withColumn("text", text).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*DOCUMENT_COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences of 4096 tokens.

    Null and empty texts are their end id alone; repeated rows are packed as often as they occur; longer texts are cut; an empty
    table gives no rows.
    """
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_stage),
    ("language id", language_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("best-fit packing", packing_stage),
]

#: Training a network and 64-bit xxHash fingerprints are beyond SQL: tests/llm holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, "stage")
    return docs
