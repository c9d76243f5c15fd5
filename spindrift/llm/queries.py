"""The registered queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bytebpe, chat, forest, html, langid, merkle, packing, pathjoin, quality, records, simhash, substrings
from .common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = bytebpe.ByteBpe.from_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return bytebpe.round_trip(table(spark, sf_dir, "documents"), model)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(table(spark, sf_dir, "conversations"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.encode_to_records(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.nearest(table(spark, sf_dir, "embeddings"))


def op11_similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pathjoin.similar_documents(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), merkle.tampered_text(F.col("doc_id"), F.col("text")))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_quality_rules, op3_byte_bpe, op4_chat_format, op5_best_fit_packing, op6_substring_dedup,
        op7_token_records, op8_simhash, op9_main_text, op10_nearest, op11_similar_documents, op12_merkle_manifest, op13_alignment, pipeline,
    )
}

OP6_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT doc_id, k, sha256(array_to_string(list_slice(words, k, k + 12), ' ')) AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS k FROM w WHERE len(words) >= 13)),
dup AS (SELECT g.doc_id, g.k FROM g JOIN (SELECT gram, min(doc_id) AS own FROM g GROUP BY gram) o USING (gram) WHERE own < g.doc_id),
cov AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS k FROM dup),
c AS (SELECT doc_id, list(k) AS ks FROM cov GROUP BY doc_id),
kept AS (SELECT w.doc_id, len(words) AS n, coalesce(len(ks), 0) AS r,
  CASE WHEN ks IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(ks, i)) END AS kept FROM w LEFT JOIN c USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM kept
"""

ORACLE_SQL = {"op2_quality_rules": quality.ORACLE, "op6_substring_dedup": OP6_SQL, "op12_merkle_manifest": merkle.ORACLE}
