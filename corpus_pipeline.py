"""From raw documents to packed training sequences.

Each stage reads what its predecessor kept and takes effect: rejected,
duplicate and contaminated documents go, secrets are replaced, and the rest is
cut into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from groundline.llm import decontam, near, packing, quality, secrets
from groundline.llm.base import Scratch, documents
from groundline.llm.ranks import ranked


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranker accepts."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of every group of near-duplicates; rows without a doc_id stay.

    Where several rows have a doc_id, each row is judged by its own text: rows
    are numbered in the order of doc_id and digest, and a text that is no near
    copy stays, whatever other texts its doc_id has.
    """
    scratch = Scratch(spark, "near-stage")
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if again.isEmpty():
        found = scratch.write(near.near_duplicates(docs), "groups")
        # the ids grow with the documents: never a broadcast, whatever their number
        return docs.join(found.where("not kept").select("doc_id").hint("merge"), "doc_id", "left_anti").select(docs.columns)
    rows = scratch.write(docs.select(F.struct(*docs.columns).alias("document"), F.monotonically_increasing_id().alias("row")), "rows")
    order = scratch.write(rows.where("document.doc_id is not null").select(
        F.lit("").alias("all"), F.col("document.doc_id").alias("doc_id"), F.sha2("document.text", 256).alias("digest"), "row"), "order")
    number = ranked(order, scratch, "ranked", "all", ["doc_id", "digest", "row"]).select("row", F.col("rank").alias("doc_id"))
    numbered = scratch.write(rows.select("row", F.col("document.text").alias("text")).join(number.hint("merge"), "row"), "numbered")
    gone = scratch.write(near.near_duplicates(numbered), "groups").where("not kept").select("doc_id")
    gone = numbered.select("row", "doc_id").join(gone.hint("merge"), "doc_id").select("row")
    return rows.join(gone.hint("merge"), "row", "left_anti").select("document.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("minhash_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("secret_scan", secrets_stage),
    ("packing", packing_stage),
]

#: The stages are not expressible in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written before the next stage reads it."""
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
