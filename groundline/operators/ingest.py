"""Ingestion: chunk provenance, de-duplication, change detection, status rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from groundline.functions import text as T
from groundline.functions.rules import null
from groundline.operators.ordering import first_per_key, join_per_key, position
from groundline.operators.pages import clean_pages, page_chunks, page_text
from groundline.session import materialize


def chunk_metadata(source_id: Column, revision: Column, file_path: Column, symbol: Column, content: Column, *,
                   source_type: Column, content_type: Column, language: Column, title: Column,
                   repository_url: Column | None = None) -> Column:
    """Provenance struct of a chunk."""
    return F.struct(
        F.concat(F.lit("dynamic:"), T.digest([source_id, revision, file_path, symbol, content], 20)).alias("chunk_id"),
        source_id.alias("source_id"), source_type.alias("source_type"), title.alias("source_title"),
        revision.alias("revision"), F.when(source_type == "repository", revision).alias("commit"),
        (repository_url if repository_url is not None else null()).alias("repository_url"),
        file_path.alias("file_path"), symbol.alias("symbol"), symbol.alias("qualified_symbol"), symbol.alias("section"),
        content_type.alias("content_type"), language.alias("language"), F.translate(symbol, "._", "  ").alias("symbol_tokens"))


def deduplicate(chunks: DataFrame, order: list[str]) -> DataFrame:
    """First chunk per (source, file, symbol, content); ``n_rows`` counts its copies."""
    return first_per_key(chunks.withColumn("_sha", T.sha("content")), ["source", "file_path", "symbol", "_sha"], order).drop("_sha")


def changed_sources(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Per incoming source: same ordered contents, same revision, and what to do.

    Rows are compared position by position in one equi-join, so no source is ever
    gathered; ``existing`` needs source, source_index, content, revision. Where both
    sides have metadata_json, a difference in it alone is a patch too.
    """
    described = "metadata_json" in existing.columns and "metadata_json" in incoming.columns

    def described_revision(df: DataFrame) -> Column:
        return F.struct("revision", *(["metadata_json"] if described else []))

    old = existing.select("source", "source_index", T.sha("content").alias("old_sha"), described_revision(existing).alias("old_rev"))
    new = incoming.select("source", "source_index", T.sha("content").alias("new_sha"), described_revision(incoming).alias("new_rev"))
    per = old.join(new, ["source", "source_index"], "full_outer").groupBy("source").agg(
        F.count("old_sha").alias("n_old"), F.count("new_sha").alias("n_new"),
        F.bool_and(F.col("old_sha").eqNullSafe(F.col("new_sha"))).alias("same_content"),
        F.bool_and(F.col("old_rev").eqNullSafe(F.col("new_rev"))).alias("same_revision"))
    return per.filter("n_new > 0").withColumn("unchanged", F.col("same_content") & F.col("same_revision") & (F.col("n_old") > 0)).withColumn(
        "action", F.when(F.col("unchanged"), F.lit("keep")).when(F.col("same_content"), F.lit("patch")).otherwise(F.lit("replace")))


def ingest_pages(blocks: DataFrame, existing: DataFrame, revisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Page blocks of many documents to (chunks, status rows).

    ``revisions`` is (doc, revision), one row per document. Documents without
    text become status ``failed``.
    """
    pages, chunks = cut_pages(blocks, revisions)
    return chunks, ingest_status(pages, chunks, existing)


def cut_pages(blocks: DataFrame, revisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cleaned pages, chunks) of page blocks, both written."""
    pages = materialize(clean_pages(page_text(blocks)), "pages")
    raw = page_chunks(pages).withColumns({
        "source": F.concat(F.lit("research:"), "doc"), "file_path": F.concat("doc", F.lit(".pdf")),
        "symbol": T.coalesce_text(T.first_line_section("content"), F.concat(F.lit("Page "), F.col("page").cast("string")))})
    columns = raw.select("doc", "source", "file_path", "symbol", "page", "section_no", "part", "content")
    unique = materialize(deduplicate(columns, ["page", "section_no", "part"]), "unique")
    numbered = position(unique, ["source"], F.floor(F.col("page") / 1024), ["page", "section_no", "part"], "source_index")
    described = join_per_key(numbered, revisions, ["doc"], "inner", "page").withColumn("metadata", chunk_metadata(
        F.col("source"), F.col("revision"), F.col("file_path"), F.col("symbol"), F.col("content"), source_type=F.lit("paper"),
        content_type=F.lit("paper"), language=F.lit("text"), title=F.col("doc")))
    return pages, materialize(described, "ingested")


def ingest_status(pages: DataFrame, chunks: DataFrame, existing: DataFrame) -> DataFrame:
    """One status row per document of a run that finds ``existing`` chunks stored."""
    made = chunks.groupBy("doc").agg(F.count("*").alias("chunks_total"), F.sum(F.col("n_rows") - 1).alias("duplicates"))
    empty = pages.groupBy("doc").agg(F.count_if(F.col("text") == "").alias("empty_pages"), F.count("*").alias("n_pages"))
    change = changed_sources(existing, chunks).select(F.substring("source", 10, 1_000_000).alias("doc"), "unchanged")
    return empty.join(made, "doc", "left").join(change, "doc", "left").select(
        "doc", F.when(F.col("chunks_total").isNull(), F.lit("failed")).when(F.col("unchanged"), F.lit("unchanged"))
        .otherwise(F.lit("completed")).alias("status"),
        F.when(F.col("chunks_total").isNull() | F.col("unchanged"), F.lit(0)).otherwise(F.col("chunks_total")).cast("long").alias("chunks_created"),
        F.coalesce("chunks_total", F.lit(0)).cast("long").alias("chunks_total"),
        (F.col("empty_pages") + F.coalesce("duplicates", F.lit(0))).cast("long").alias("skipped_chunks"), "n_pages")
