"""Registered queries of the operators: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from groundline.llm import chat, decontam, language, licenses, manifest, near, packing, quality, secrets, signature, substrings, topk, trie
from groundline.llm.base import documents


def op1_deleted_interpolation(spark: SparkSession, folder: str) -> DataFrame:
    return language.score_documents(documents(spark, folder))


def op2_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score_documents(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


def op3_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = topk.integer_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"))
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0)


def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.remove_repeats(documents(spark, folder))


def op5_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near.near_duplicates(documents(spark, folder), shingle_words=4)


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(documents(spark, folder))


def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(documents(spark, folder))


def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(documents(spark, folder))


def op9_chat_repair(spark: SparkSession, folder: str) -> DataFrame:
    return chat.repair(spark.read.parquet(f"{folder}/conversations.parquet"))


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.find_leaks(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.manifest(documents(spark, folder))


def op12_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return signature.jaccard_join(documents(spark, folder))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.prefix_trie(spark.read.parquet(f"{folder}/conversations.parquet"))


QUERIES = {f.__name__: f for f in (
    op1_deleted_interpolation, op2_quality_classifier, op3_exact_topk, op4_suffix_dedup, op5_minhash_dedup, op6_packing,
    op7_license_scan, op8_secret_scan, op9_chat_repair, op10_decontamination,
    op11_merkle_manifest, op12_jaccard_join, op13_prefix_trie)}
ORACLE: dict[str, str] = {
    "op3_exact_topk": """
WITH good AS (SELECT vec_id, min(list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0 GROUP BY vec_id),
scores AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scores QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""",
    "op7_license_scan": licenses.oracle(),
}
