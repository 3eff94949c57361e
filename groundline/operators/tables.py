"""Upkeep of the chunk, registry, translation and checkpoint tables.

Each function returns the next version of a table as a DataFrame; ``replace_table``
in ``sources.files`` writes one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from groundline import config as C
from groundline.functions import text as T
from groundline.functions.rules import upload_error
from groundline.operators.ingest import changed_sources
from groundline.operators.ordering import first_per_key, join_per_key, lookup, split_lookup
from groundline.session import materialize


# ---- chunk table --------------------------------------------------------------------------

def replace_sources(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """All rows of the incoming sources replaced; other sources untouched."""
    names = incoming.select("source").distinct()
    return join_per_key(existing, names, ["source"], "left_anti", "source_index").unionByName(incoming)


def ensure_sources(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Replace only sources whose contents changed; where just metadata did, patch it in place."""
    plan = materialize(changed_sources(existing, incoming).select("source", "action"), "plan")
    cols = ["source", "source_index", *[c for c in existing.columns if c not in ("source", "source_index")], "action"]
    new = join_per_key(incoming, plan, ["source"], "inner", "source_index")
    old = join_per_key(existing, plan, ["source"], "left", "source_index").withColumn("action", F.coalesce("action", F.lit("untouched")))
    described = [c for c in ("revision", "metadata_json") if c in existing.columns and c in incoming.columns]
    meta = new.filter("action = 'patch'").select("source", "source_index", F.struct(*described).alias("_new"))
    patched = old.filter("action <> 'replace'").join(meta, ["source", "source_index"], "left").withColumns(
        {c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in described})
    return new.filter("action = 'replace'").select(*cols).unionByName(patched.select(*cols))


def delete_sources(table: DataFrame, sources: DataFrame, spread_by: str = "source_index") -> tuple[DataFrame, DataFrame]:
    """(remaining rows, removed row count per deleted source)."""
    names = materialize(sources.select("source").distinct(), "deleted")
    removed = join_per_key(table, names, ["source"], "left_semi", spread_by).groupBy("source").agg(F.count("*").alias("removed"))
    return join_per_key(table, names, ["source"], "left_anti", spread_by), names.join(removed, "source", "left").select(
        "source", F.coalesce("removed", F.lit(0)).alias("removed"))


def with_registered_metadata(chunks: DataFrame, registered: DataFrame) -> DataFrame:
    """Registered metadata wins over the stored JSON; invalid or non-object JSON counts as empty."""
    names = registered.groupBy("source", F.sha2("content", 256).alias("_sha")).agg(F.max_by("metadata", "source_index").alias("_m"))
    parsed = F.from_json("metadata_json", "map<string,string>", {"mode": "PERMISSIVE"})
    stored = F.when(F.startswith(T.strip("metadata_json"), F.lit("{")), parsed)
    return lookup(chunks.withColumn("_sha", F.sha2("content", 256)), names, ["source", "_sha"]).withColumn(
        "metadata", F.coalesce("_m", stored, F.create_map().cast("map<string,string>"))).drop("_m", "_sha")


def index_status(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row of counts and settings."""
    both = chunks.select(F.lit(1).alias("c"), F.lit(0).alias("v")).unionByName(vectors.select(F.lit(0).alias("c"), F.lit(1).alias("v")))
    return both.agg(F.sum("c").cast("long").alias("database_chunks"), F.sum("v").cast("long").alias("vector_chunks")).withColumns({
        "candidate_k": F.lit(C.CANDIDATE_K).cast("long"), "vector_weight": F.lit(C.VECTOR_WEIGHT), "bm25_weight": F.lit(C.BM25_WEIGHT)})


def expired_snapshots(names: DataFrame, keep: int = C.SNAPSHOT_KEEP) -> DataFrame:
    """Snapshot names beyond the newest ``keep`` (names sort by time)."""
    newest = names.select("name").distinct().orderBy(F.col("name").desc()).limit(max(1, keep))
    return names.select("name").distinct().join(F.broadcast(newest), "name", "left_anti")


# ---- document registry ------------------------------------------------------------------------

def upload_batch(uploads: DataFrame, registry: DataFrame, hot_rows: int = 100_000) -> DataFrame:
    """Outcome per upload: rejected, duplicate, completed or failed.

    ``uploads``: upload_id, filename, mime, size, head, sha, created_at, chunk_count;
    ``registry``: document_id, sha (unique). The first valid upload of a content
    registers it; a content uploaded very often is joined by broadcast.
    """
    error = upload_error(F.col("filename"), F.col("mime"), F.col("size"), F.col("head"))
    checked = materialize(uploads.select("upload_id", "sha", "created_at", "chunk_count", error.alias("error")), "uploads")
    bad = checked.filter("error IS NOT NULL").withColumns({
        "status": F.lit("rejected"), "document_id": F.lit(None).cast("string"), "chunks": F.lit(0).cast("long")})
    good = checked.filter("error IS NULL")
    winners = first_per_key(good.select("sha", "created_at", "upload_id", "chunk_count"), ["sha"], ["created_at", "upload_id"])
    known = registry.select("sha", F.col("document_id").alias("_known"))
    values = winners.join(known, "sha", "left").select(
        "sha", F.col("upload_id").alias("_first"), "_known", F.col("chunk_count").alias("_chunks"), "n_rows")
    joined = split_lookup(good, values, ["sha"], "n_rows", hot_rows)
    own = F.col("_known").isNull() & (F.col("upload_id") == F.col("_first"))
    done = joined.withColumns({
        "status": F.when(~own, F.lit("duplicate")).when(F.col("_chunks") > 0, F.lit("completed")).otherwise(F.lit("failed")),
        "document_id": F.coalesce("_known", F.concat(F.lit("doc_"), F.col("_first").cast("string"))),
        "chunks": F.when(own, F.col("_chunks")).otherwise(F.lit(0)).cast("long")})
    cols = ["upload_id", "sha", "status", "document_id", "chunks", "error"]
    return done.select(*cols).unionByName(bad.select(*cols))


def public_documents(registry: DataFrame) -> DataFrame:
    """Registry as its public record."""
    return registry.select(
        "document_id", "source_id", F.col("original_filename").alias("filename"), "content_type", "size_bytes", "status",
        "chunk_count", F.col("ingestion_error").alias("error"), "created_at", "updated_at", F.lit(False).alias("duplicate"))


def list_documents(registry: DataFrame) -> DataFrame:
    return public_documents(registry).orderBy(F.col("created_at").desc())


def get_documents(registry: DataFrame, wanted: DataFrame) -> DataFrame:
    """Requested ids with their record; ``found`` is false for unknown ids."""
    docs = public_documents(registry).withColumn("_f", F.lit(True))
    return wanted.join(docs, "document_id", "left").withColumn("found", F.coalesce("_f", F.lit(False))).drop("_f")


def delete_documents(registry: DataFrame, chunks: DataFrame, vectors: DataFrame, wanted: DataFrame) -> dict[str, DataFrame]:
    """Next versions of the three tables and the removed chunk count per document."""
    gone = registry.join(wanted.select("document_id"), "document_id", "left_semi").select("document_id", F.col("source_id").alias("source"))
    rest, removed = delete_sources(chunks, gone)
    left, _ = delete_sources(vectors, gone)
    return {
        "registry": registry.join(gone.select("document_id"), "document_id", "left_anti"),
        "chunks": rest,
        "vectors": left,
        "removed": gone.join(removed, "source").select("document_id", "source", F.col("removed").alias("removed_chunks")),
    }


# ---- translations and checkpoints ---------------------------------------------------------------

def split_translations(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Chunks with their cached translation, or as pending work with a logical id."""
    usable = cache.filter((F.col("translation_status") == "success") & (F.coalesce("content_zh", F.lit("")) != "")).select(
        "source", "source_index", "content_hash", F.col("content_en").alias("_en"), F.col("content_zh").alias("_zh"))
    rows = chunks.withColumn("content_hash", T.sha("content")).join(usable, ["source", "source_index", "content_hash"], "left")
    hit = F.coalesce(F.col("_en") == F.col("content"), F.lit(False))
    name = F.regexp_replace("source", "^research:", "")
    return rows.select(
        "source", "source_index", "content_hash", hit.alias("cached"),
        F.concat(F.lit("research:"), name, F.lit(":"), F.format_string("%04d", "source_index"), F.lit(":"),
                 F.substring("content_hash", 1, 16)).alias("logical_chunk_id"),
        T.first_line_section("content").alias("section"),
        F.when(hit, F.lit("success")).otherwise(F.lit("pending")).alias("translation_status"),
        F.when(hit, F.col("_zh")).alias("content_zh"), F.col("content").alias("content_en"))


def finish_translations(split: DataFrame, outputs: DataFrame) -> DataFrame:
    """Pending rows completed by translator ``outputs`` (logical_chunk_id, translated); blank output fails."""
    done = split.join(outputs, "logical_chunk_id", "left")
    text = T.strip(F.coalesce("translated", F.lit("")))
    return done.withColumns({
        "content_zh": F.when(F.col("cached"), F.col("content_zh")).when(text != "", text),
        "translation_status": F.when(F.col("cached") | (text != ""), F.lit("success")).otherwise(F.lit("failed")),
    }).drop("translated")


def translation_stats(finished: DataFrame) -> DataFrame:
    return finished.agg(
        F.count("*").alias("total"), F.count_if("cached").alias("cached"),
        F.count_if(~F.col("cached") & (F.col("translation_status") == "success")).alias("translated"),
        F.count_if(F.col("translation_status") == "failed").alias("failed"))


def with_translation(chunks: DataFrame, translations: DataFrame) -> DataFrame:
    """Chunks with translated text and status; only ``research:`` sources have translations."""
    last = F.max_by(F.struct("content_zh", "translation_status"), "source_index").alias("_r")
    names = translations.groupBy("source", F.sha2("content_en", 256).alias("_sha")).agg(last).select(
        "source", "_sha", F.col("_r.content_zh").alias("_zh"), F.col("_r.translation_status").alias("_st"), F.lit(True).alias("_has"))
    research = F.startswith("source", F.lit("research:"))
    joined = lookup(chunks.withColumn("_sha", F.sha2("content", 256)), names, ["source", "_sha"])
    has = F.coalesce("_has", F.lit(False)) & research
    return joined.withColumns({
        "content_zh": F.when(has, F.col("_zh")),
        "translation_status": F.when(has, F.coalesce("_st", F.lit("missing")))
        .when(F.coalesce(F.col("content_type") == "source_code", F.lit(False)), F.lit("skipped_source_code"))
        .when(research, F.lit("missing")).otherwise(F.lit("not_applicable")),
    }).drop("_sha", "_zh", "_st", "_has")


def completed_cases(results: DataFrame) -> DataFrame:
    """Last stored result per case id; rows without an id are ignored."""
    return results.filter(F.coalesce("case_id", F.lit("")) != "").groupBy("case_id").agg(
        F.max_by("payload", "pos").alias("payload"), F.max("pos").alias("pos"))


def pending_cases(cases: DataFrame, results: DataFrame) -> DataFrame:
    return cases.join(completed_cases(results).select("case_id"), "case_id", "left_anti")
