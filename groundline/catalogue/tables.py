"""Catalogue: table upkeep, registry, vectors, translations, validation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from groundline import config as C
from groundline.catalogue import base as B
from groundline.functions import rules
from groundline.functions import text as T
from groundline.operators import chunking, ingest, tables, vectors
from groundline.plans import upkeep
from groundline.session import shared_folder
from groundline.sources.versions import VersionedTables


# ---- input views ------------------------------------------------------------------------------

def versions(spark, d):
    """(stored, incoming) chunk tables: per source number, same, changed text or changed revision."""
    number = F.substring("title", 4, 10).cast("long")
    base = B.chunks(spark, d).select("source", "source_index", "content", "title")
    old = base.select("source", "source_index", "content", F.lit("r1").alias("revision"))
    new = base.select("source", "source_index", F.when(number % 3 == 1, F.concat("content", F.lit(" edited"))).otherwise(F.col("content")).alias("content"),
                      F.when(number % 3 == 2, F.lit("r2")).otherwise(F.lit("r1")).alias("revision"))
    return old, new


def region_sources(spark, d):
    return B.table(spark, d, "region").select(F.concat(F.lit("research:src"), "r_regionkey").alias("source"))


def toxic_docs(spark, d):
    return B.table(spark, d, "labels").filter("toxic = 1").select("doc_id")


def uploads(spark, d):
    n = F.col("doc_id") % 9
    return B.table(spark, d, "documents").select(
        F.col("doc_id").alias("upload_id"),
        F.when(n == 0, F.lit("doc.txt")).when(n == 1, F.lit("DOC.PDF")).otherwise(F.concat(F.lit("doc-"), "doc_id", F.lit(".pdf"))).alias("filename"),
        F.when(n == 2, F.lit("text/html")).when(n == 3, F.lit("Application/Octet-Stream")).when(n == 4, F.lit("")).otherwise(F.lit("application/pdf")).alias("mime"),
        F.when(n == 5, F.lit(0)).when(n == 6, F.lit(30_000_000)).otherwise(F.length("text")).cast("long").alias("size"),
        F.when(n == 7, F.lit("no pdf")).otherwise(F.lit("\n %PDF-1.7")).alias("head"),
        T.sha("text").alias("sha"), (1_700_000_000 + F.col("doc_id") * 60).alias("created_at"),
        chunking.window_count(F.length(T.collapse("text"))).cast("long").alias("chunk_count"))


def registry(spark, d):
    """One registered document per labelled text."""
    docs = B.table(spark, d, "documents").join(B.table(spark, d, "labels"), "doc_id")
    return docs.groupBy(T.sha("text").alias("sha")).agg(F.min("doc_id").alias("doc_id"), F.min_by("source", "doc_id").alias("src"), F.min_by(F.length("text"), "doc_id").alias("n"), F.min_by("quality", "doc_id").alias("q")).select(
        F.concat(F.lit("doc_"), "doc_id").alias("document_id"), F.concat(F.lit("research:upload_"), "doc_id").alias("source_id"),
        F.concat("src", F.lit("-"), "doc_id", F.lit(".pdf")).alias("original_filename"), "sha", F.lit("application/pdf").alias("content_type"),
        (F.col("n") * 1000).cast("long").alias("size_bytes"), F.when(F.col("q") == 1, F.lit("completed")).otherwise(F.lit("failed")).alias("status"),
        F.col("n").cast("long").alias("chunk_count"), F.when(F.col("q") == 0, F.lit("PDF ingestion failed.")).alias("ingestion_error"),
        F.timestamp_seconds(1_700_000_000 + F.col("doc_id") * 60).alias("created_at"), F.timestamp_seconds(1_700_000_060 + F.col("doc_id") * 60).alias("updated_at"))


def translations(spark, d):
    """Cached translations: a third good, a third of another text, a third failed."""
    k = F.col("doc_id") % 3
    return B.chunks(spark, d).select(
        "source", "source_index", F.when(k == 1, F.concat("content", F.lit(" edited"))).otherwise(F.col("content")).alias("content_en"),
        F.when(k == 2, F.lit("failed")).otherwise(F.lit("success")).alias("translation_status"),
        F.concat(F.lit("译文 "), F.col("chunk_id").cast("string")).alias("content_zh")).withColumn("content_hash", T.sha("content_en"))


# ---- queries ------------------------------------------------------------------------------------

def change_detect(spark, d):
    return tables.changed_sources(*versions(spark, d)).select("source", "n_old", "n_new", "same_content", "unchanged", "action")


def replace_source(spark, d):
    old, new = versions(spark, d)
    only = new.join(F.broadcast(region_sources(spark, d)), "source", "left_semi")
    return tables.replace_sources(old, only).select("source", "source_index", "revision", T.sha("content").alias("sha"))


def ensure_source(spark, d):
    return tables.ensure_sources(*versions(spark, d)).select("source", "source_index", "revision", "action", T.sha("content").alias("sha"))


def delete_source(spark, d):
    rest, removed = tables.delete_sources(B.chunks(spark, d), region_sources(spark, d))
    return removed.select(F.lit("removed").alias("kind"), "source", F.col("removed").alias("n")).unionByName(
        rest.groupBy("source").agg(F.count("*").alias("n")).withColumn("kind", F.lit("kept")).select("kind", "source", "n"))


def _vector_inputs(spark, d):
    chunks = B.chunks(spark, d)
    stored = B.chunk_vectors(spark, d).select("chunk_id", "source", "source_index", F.lit("research").alias("corpus"), F.lit("").alias("section"), "embedding")
    kept = chunks.join(toxic_docs(spark, d), "doc_id", "left_anti")
    mine = kept.join(stored.select("chunk_id", "embedding"), "chunk_id").withColumn("content", F.concat(F.lit("## "), "symbol", F.lit("\n\n"), "content"))
    cols = ["chunk_id", "source", "source_index", "content", "embedding", "version"]
    updates = mine.withColumn("version", F.lit(1)).select(*cols).unionByName(
        mine.withColumn("embedding", F.reverse("embedding")).withColumn("version", F.lit(2)).select(*cols))
    return chunks, stored, kept, updates


def vector_sync(spark, d):
    _, stored, kept, updates = _vector_inputs(spark, d)
    return vectors.sync(stored, kept, updates).select("chunk_id", "source", "section", "corpus", F.round(F.get("embedding", 0).cast("double"), 6).alias("first_value"))


def vector_stale(spark, d):
    _, stored, kept, _ = _vector_inputs(spark, d)
    return vectors.stale_ids(stored, kept)


def vector_freshness(spark, d):
    """Against the whole chunk table and against the embedded chunks alone."""
    chunks, stored, _, _ = _vector_inputs(spark, d)
    with_e = chunks.join(stored.select("chunk_id", "embedding"), "chunk_id", "left")
    only = with_e.filter("embedding IS NOT NULL")
    return vectors.index_freshness(stored, with_e).withColumn("case", F.lit("all")).unionByName(
        vectors.index_freshness(stored, only).withColumn("case", F.lit("embedded")))


def index_status(spark, d):
    return tables.index_status(B.chunks(spark, d), B.chunk_vectors(spark, d))


def embedding_parse(spark, d):
    k = F.col("vec_id") % 6
    raw = F.when(k == 1, F.lit("not json")).when(k == 2, F.lit("[]")).when(k == 3, F.lit('["a", 1]')).when(k == 4, F.lit('{"a": 1}')).otherwise(F.to_json("embedding"))
    rows = B.table(spark, d, "embeddings").select("vec_id", vectors.parse_embedding(raw).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return rows.select("vec_id", F.col("e").isNotNull().alias("valid"), F.size("e").cast("long").alias("dims"), F.round(total, 4).alias("total"))


def embedding_prep(spark, d):
    pieces = B.table(spark, d, "documents").select("doc_id", F.posexplode(vectors.embedding_pieces(F.col("text"), 300)).alias("piece_no", "piece"))
    return pieces.select("doc_id", F.col("piece_no").cast("long").alias("piece_no"), F.length("piece").cast("long").alias("n_chars"), T.sha("piece").alias("sha"))


def embedding_response(spark, d):
    """Vectors answered in reverse order; one batch number in five lacks a vector."""
    rows = B.table(spark, d, "embeddings").select(
        F.floor(F.col("vec_id") / 64).alias("batch_id"), (63 - F.col("vec_id") % 64).alias("index"), F.lit(64).cast("long").alias("expected"), "vec_id",
        F.when((F.floor(F.col("vec_id") / 64) % 5 == 4) & (F.col("vec_id") % 64 == 7), F.array().cast("array<float>")).otherwise(F.col("embedding")).alias("embedding"))
    done = vectors.embedding_response(rows)
    return done.select(F.col("batch_id").cast("long").alias("batch_id"), "position", "complete", F.round(F.get("embedding", 0).cast("double"), 6).alias("first_value"))


def embedding_backfill(spark, d):
    """Work list of chunks without a usable stored vector."""
    e = B.table(spark, d, "embeddings").select((F.col("vec_id") * 1000000).alias("chunk_id"),
        F.when(F.col("vec_id") % 5 == 0, F.lit("broken")).otherwise(F.to_json("embedding")).alias("embedding_json"))
    rows = B.chunks(spark, d).join(e, "chunk_id", "left")
    return vectors.backfill_worklist(rows).select("chunk_id", "source", "range_no", "batch_no", T.sha("input").alias("sha"))


def registry_upload(spark, d):
    known = registry(spark, d).select("sha", "document_id")
    return tables.upload_batch(uploads(spark, d), known).select("upload_id", "status", "document_id", "chunks", "error")


def client_validation(spark, d):
    return uploads(spark, d).select("upload_id", rules.client_upload_error(F.col("filename"), F.col("mime"), F.col("size")).alias("error"))


def registry_list(spark, d):
    docs = tables.list_documents(registry(spark, d))
    return docs.select("document_id", "source_id", "filename", "size_bytes", "status", "chunk_count", "error", F.unix_timestamp("created_at").alias("created"),
                       "duplicate", rules.byte_size(F.col("size_bytes")).alias("size_text"),
                       rules.display_time(F.expr(
        "cast(timestamp_ntz'2023-11-14 22:13:20' + make_dt_interval(0, 0, cast(substring(document_id, 5) AS int), 0) AS string)")).alias("created_text"))


def registry_get(spark, d):
    wanted = B.table(spark, d, "benchmark").select(F.concat(F.lit("doc_"), F.col("item_id") * 3).alias("document_id"))
    return tables.get_documents(registry(spark, d), wanted).select("document_id", "found", "filename", "status")


def _versioned(spark, name):
    """Tables of their own for one query, in the shared folder."""
    return VersionedTables(spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")


def delete_cascade(spark, d):
    """Documents deleted from three stored tables in one commit; what readers of the next version see."""
    store = _versioned(spark, "delete")
    store.commit({"registry": registry(spark, d), "chunks": B.chunks(spark, d).withColumn("source", F.concat(F.lit("research:upload_"), "doc_id"))}, 0)
    kept = store.read()["chunks"].select("chunk_id", "source", "source_index").join(B.table(spark, d, "embeddings").select((F.col("vec_id") * 1000000).alias("chunk_id")), "chunk_id", "left_semi")
    store.commit({"vectors": kept}, 1)
    removed = upkeep.delete_documents(store, toxic_docs(spark, d).select(F.concat(F.lit("doc_"), "doc_id").alias("document_id")))
    now = store.read()
    left = [now[n].agg(F.count("*").alias("n")).select(F.lit(f"left in {n}").alias("what"), "n") for n in ("registry", "chunks", "vectors")]
    return removed.select(F.col("document_id").alias("what"), F.col("removed_chunks").alias("n")).unionByName(left[0]).unionByName(left[1]).unionByName(left[2])


def index_rebuild(spark, d):
    """Vectors of all chunks: those of an earlier text or of a chunk that is gone are replaced or dropped.

    Length and checksum of the text stand in for the model's vector.
    """
    store = _versioned(spark, "rebuild")
    store.commit({"chunks": B.chunks(spark, d).select("chunk_id", "source", "source_index", "content")}, 0)
    stored = B.table(spark, d, "embeddings").select("vec_id", "embedding", (F.col("vec_id") * 1000000).alias("chunk_id")).join(store.read()["chunks"], "chunk_id")
    earlier = F.when(F.col("vec_id") % 3 == 1, F.lit(" earlier")).otherwise(F.lit(""))
    cols = ["source", "source_index", "content_sha", F.col("embedding").cast("array<float>").alias("embedding")]
    stored = stored.withColumn("content_sha", F.sha2(F.concat("content", earlier), 256))
    store.commit({"vectors": stored.select("chunk_id", *cols).unionByName(stored.select((-1 - F.col("chunk_id")).alias("chunk_id"), *cols))}, 1)
    upkeep.rebuild_index(store, lambda rows: rows.withColumn("embedding", F.array(F.length("content"), F.crc32(F.col("content")) % 1000)), parts=4)
    return store.read()["vectors"].select("chunk_id", "source", "source_index", "content_sha", F.round(F.get("embedding", 0).cast("double"), 6).alias("first_value"))


def snapshot_retention(spark, d):
    """Hourly snapshots named after the event clock; all but the newest five expire."""
    names = B.table(spark, d, "events").select(F.date_format(F.date_trunc("hour", "ts"), "yyyyMMdd-HHmmss-SSSSSS").alias("name"))
    return tables.expired_snapshots(names)


def translation_split(spark, d):
    return tables.split_translations(B.chunks(spark, d), translations(spark, d)).select(
        "source", "source_index", "cached", "logical_chunk_id", "translation_status", "content_zh")


def translation_stats(spark, d):
    split = tables.split_translations(B.chunks(spark, d), translations(spark, d))
    outputs = split.select("logical_chunk_id", F.when(F.col("source_index") % 5 == 0, F.lit("  ")).otherwise(F.lit(" 译 ")).alias("translated"))
    return tables.translation_stats(tables.finish_translations(split, outputs))


def translated_chunks(spark, d):
    return tables.with_translation(B.chunks(spark, d).withColumn("source", F.when(F.col("lang") == "es", F.col("title")).otherwise(F.col("source"))), translations(spark, d)).select(
        "chunk_id", "translation_status", "content_zh")


def metadata_override(spark, d):
    """Stored JSON per chunk, good or broken; every third document has registered metadata."""
    k = F.col("doc_id") % 4
    stored = F.when(k == 0, F.lit("broken {")).when(k == 1, F.lit('["list"]')).otherwise(F.to_json(F.struct("file_path", F.lit("stored").alias("origin"))))
    chunks = B.chunks(spark, d).withColumn("metadata_json", stored)
    registered = B.chunks(spark, d).filter("lang = 'fr'").select("source", "source_index", "content", F.create_map(F.lit("origin"), F.lit("registered")).alias("metadata"))
    m = tables.with_registered_metadata(chunks, registered)
    return m.select("chunk_id", F.try_element_at("metadata", F.lit("origin")).alias("origin"), F.try_element_at("metadata", F.lit("file_path")).alias("file_path"))


def checkpoint_resume(spark, d):
    """Benchmark items without a stored result; a conversation's last turn is its result."""
    results = B.table(spark, d, "conversations").select(
        F.concat(F.lit("case-"), F.col("conv_id") * 3).alias("case_id"), F.col("turn").alias("pos"), F.col("text").alias("payload"))
    cases = B.table(spark, d, "benchmark").select(F.concat(F.lit("case-"), "item_id").alias("case_id"))
    pending = tables.pending_cases(cases, results).select("case_id", F.lit(None).cast("string").alias("sha"), F.lit("pending").alias("state"))
    return pending.unionByName(tables.completed_cases(results).select("case_id", T.sha("payload").alias("sha"), F.lit("completed").alias("state")))


def request_validation(spark, d):
    """Every conversation text as a question with a session id that is sometimes blank or long."""
    session = F.when(F.col("turn") % 4 == 0, F.lit("  ")).when(F.col("turn") % 4 == 1, F.repeat(F.lit("s"), 120 + F.col("conv_id").cast("int") % 20)).otherwise(F.concat(F.lit(" s-"), "conv_id"))
    query = F.when(F.col("turn") % 7 == 3, F.lit("")).when(F.col("turn") % 7 == 4, F.lit(" \t ")).when(F.col("turn") % 7 == 5, F.repeat("text", 60)).otherwise(F.col("text"))
    return B.table(spark, d, "conversations").withColumns({"session": session, "query": query}).select(
        "conv_id", "turn", rules.request_error(F.col("query"), F.col("session")).alias("error"), rules.session_id(F.col("session")).alias("session_id"))


def path_validation(spark, d):
    """Paths, ids, revisions and addresses derived from page addresses."""
    parts = F.split(F.regexp_replace("url", r"^https?://", ""), "[/?#]")
    host, lang = parts[0], parts[1]
    n = F.col("page_id")
    folder = F.element_at(T.strings(["src", "Build", "node_modules", "docs", "pkg.egg-info", ".Git", "a.min.js"]), (n % 7 + 1).cast("int"))
    path = F.concat_ws("/", lang, folder, F.concat(host, F.element_at(T.strings([".md", ".py", ".RST", "", ".min.js"]), (n % 5 + 1).cast("int"))))
    sid = F.concat(F.lit("research:"), F.when(n % 3 == 0, F.translate(host, ".", "_")).when(n % 3 == 1, host).otherwise(F.concat(F.lit("_"), lang)))
    rev = F.concat(lang, F.element_at(T.strings(["/main", "..x", "@{1}", ".lock", "-1.0", " bad"]), (n % 6 + 1).cast("int")))
    url = F.concat(F.element_at(T.strings(["https://github.com/", "http://github.com/", "https://www.github.com/", "https://gitlab.com/"]), (n % 4 + 1).cast("int")),
                   host, F.element_at(T.strings(["/repo", "/repo.git", "/repo/tree", "/repo?x=1", ""]), (n % 5 + 1).cast("int")))
    return B.table(spark, d, "pages").select(
        "page_id", rules.skipped_path(path).alias("skipped"), F.coalesce(rules.file_suffix(path), F.lit("")).alias("suffix"), rules.source_id_valid(sid).alias("source_ok"),
        rules.manifest_id_valid(F.substring(sid, 10, 1000)).alias("manifest_ok"), rules.revision_valid(rev).alias("revision_ok"), rules.repository_url(url).alias("repository"))


def redact_secrets(spark, d):
    """Secret hiding over every line of every document with planted keys."""
    rows = B.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    planted = F.concat(F.when(F.col("line_no") % 3 == 0, F.lit("Bearer abc.def failed; ")).when(F.col("line_no") % 3 == 1, F.lit("API_KEY = 123 sk-Ab_9 ")).otherwise(F.lit("")), "line")
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), T.sha(rules.redact(planted)).alias("sha"))


def source_names(spark, d):
    """Display names of chunk sources and registered uploads."""
    reg = registry(spark, d).select("source_id", F.col("original_filename").alias("filename"))
    docs = B.table(spark, d, "documents").select("doc_id", F.concat(F.lit("research:upload_"), "doc_id").alias("source_id"), F.when(F.col("doc_id") % 4 == 0, F.lit(" Raw "))
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("research:upload_"), "doc_id")).when(F.col("doc_id") % 4 == 2, F.lit("")).otherwise(F.concat(F.lit(" "), "source")).alias("title"))
    named = docs.join(reg, "source_id", "left")
    return named.select("doc_id", rules.display_name(F.col("filename"), F.col("title"), F.col("source_id")).alias("name"),
                        rules.source_incomplete(F.col("filename").isNotNull(), F.col("title"), F.col("source_id")).alias("incomplete"))


QUERIES = {f.__name__: f for f in (
    change_detect, replace_source, ensure_source, delete_source, vector_sync, vector_stale, vector_freshness, index_status, embedding_parse,
    embedding_prep, embedding_response, embedding_backfill, registry_upload, client_validation, registry_list, registry_get, delete_cascade, index_rebuild,
    snapshot_retention, translation_split, translation_stats, translated_chunks, metadata_override, checkpoint_resume, request_validation,
    path_validation, redact_secrets, source_names)}

# ---- the same in SQL ---------------------------------------------------------------------------

V, N = B.VIEWS, B.NEEDS
V |= {
    "oldv": "SELECT source, source_index, content, 'r1' AS revision FROM chunks",
    "newv": """SELECT source, source_index, CASE WHEN k % 3 = 1 THEN content || ' edited' ELSE content END AS content, CASE WHEN k % 3 = 2 THEN 'r2' ELSE 'r1' END AS revision, k
      FROM (SELECT *, substring(title, 4)::INT AS k FROM chunks)""",
    "regions": "SELECT 'research:src' || r_regionkey AS source FROM region",
    "toxic": "SELECT doc_id FROM labels WHERE toxic = 1",
    "plan": """SELECT source, count(o.source_index) AS n_old, count(n.source_index) AS n_new, bool_and(o.content = n.content) AS same_content, bool_and(o.content = n.content AND o.revision = n.revision) AS unchanged
      FROM oldv o FULL JOIN newv n USING (source, source_index) GROUP BY source""",
    "uploads": f"""SELECT doc_id AS upload_id, CASE doc_id % 9 WHEN 0 THEN 'doc.txt' WHEN 1 THEN 'DOC.PDF' ELSE 'doc-' || doc_id || '.pdf' END AS filename,
        CASE doc_id % 9 WHEN 2 THEN 'text/html' WHEN 3 THEN 'Application/Octet-Stream' WHEN 4 THEN '' ELSE 'application/pdf' END AS mime,
        CASE doc_id % 9 WHEN 5 THEN 0 WHEN 6 THEN 30000000 ELSE length(text) END AS size, doc_id % 9 = 7 AS nohead, sha256(text) AS sha,
        CASE WHEN length({B.d_collapse('text')}) > 0 THEN (length({B.d_collapse('text')}) - 1) // 1550 + 1 ELSE 0 END AS chunk_count FROM documents""",
    "upcheck": """SELECT *, CASE WHEN lower(filename) NOT LIKE '%.pdf' THEN 'only PDF files are supported' WHEN mime <> '' AND lower(mime) NOT IN ('application/pdf', 'application/octet-stream') THEN 'only PDF files are supported'
        WHEN size = 0 THEN 'uploaded PDF is empty' WHEN size > 20971520 THEN 'uploaded PDF exceeds the configured size limit' WHEN nohead THEN 'uploaded content is not a valid PDF' END AS error FROM uploads""",
    "reg": """SELECT 'doc_' || doc_id AS document_id, 'research:upload_' || doc_id AS source_id, source || '-' || doc_id || '.pdf' AS filename, sha, n * 1000 AS size_bytes,
        CASE WHEN quality = 1 THEN 'completed' ELSE 'failed' END AS status, n AS chunk_count, CASE WHEN quality = 0 THEN 'PDF ingestion failed.' END AS error, 1700000000 + doc_id * 60 AS created
      FROM (SELECT *, sha256(text) AS sha, length(text) AS n FROM documents JOIN labels USING (doc_id) QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1)""",
    "trans": """SELECT source, source_index, CASE WHEN doc_id % 3 = 1 THEN content || ' edited' ELSE content END AS content_en,
        CASE WHEN doc_id % 3 = 2 THEN 'failed' ELSE 'success' END AS status, '译文 ' || chunk_id AS zh FROM chunks""",
    "tsplit": """SELECT c.source, c.source_index, c.content, t.source IS NOT NULL AS cached, zh, 'research:' || substring(c.source, 10) || ':' || CASE WHEN c.source_index > 9999 THEN c.source_index::VARCHAR ELSE lpad(c.source_index::VARCHAR, 4, '0') END || ':' || sha256(c.content)[1:16] AS lid
      FROM chunks c LEFT JOIN trans t ON c.source = t.source AND c.source_index = t.source_index AND c.content = content_en AND status = 'success'""",
}
N |= {"oldv": ["chunks"], "newv": ["chunks"], "plan": ["oldv", "newv"], "upcheck": ["uploads"], "trans": ["chunks"], "tsplit": ["chunks", "trans"]}
_ROWS = "source, source_index, revision, sha256(content) AS sha"
_ANON = "[^\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_WS = B.WS
ORACLE = {
    "change_detect": B.oracle("""SELECT source, n_old, n_new, same_content, unchanged, CASE WHEN unchanged THEN 'keep' WHEN same_content THEN 'patch' ELSE 'replace' END AS action FROM plan""", "plan"),
    "replace_source": B.oracle(f"""SELECT {_ROWS} FROM oldv WHERE source NOT IN (SELECT source FROM regions) UNION ALL SELECT {_ROWS} FROM newv WHERE source IN (SELECT source FROM regions)""", "oldv", "newv", "regions"),
    "ensure_source": B.oracle(f"""SELECT {_ROWS}, CASE WHEN k % 3 = 2 THEN 'patch' WHEN k % 3 = 1 AND NOT same_content THEN 'replace' ELSE 'keep' END AS action FROM newv JOIN plan USING (source)""", "newv", "plan"),
    "delete_source": B.oracle("""SELECT 'removed' AS kind, source, count(chunk_id) AS n FROM regions LEFT JOIN chunks USING (source) GROUP BY source
        UNION ALL SELECT 'kept', source, count(*) FROM chunks WHERE source NOT IN (SELECT source FROM regions) GROUP BY source""", "regions", "chunks"),
    "vector_sync": B.oracle("""SELECT chunk_id, source, symbol AS section, 'research' AS corpus, round(embedding[-1]::DOUBLE, 6) AS first_value FROM chunks_meta JOIN embeddings ON chunk_id = vec_id * 1000000
        WHERE doc_id NOT IN (SELECT doc_id FROM toxic)""", "chunks_meta", "toxic"),
    "vector_stale": B.oracle("SELECT chunk_id FROM cvec WHERE chunk_id // 1000000 IN (SELECT doc_id FROM toxic)", "cvec", "toxic"),
    "vector_freshness": B.oracle("""SELECT 'all' AS "case", v AS vector_rows, c AS chunk_rows, v AS embedded_rows, 0 AS stale_rows, c - v AS missing_rows, c = v AS fresh FROM (SELECT (SELECT count(*) FROM cvec) AS v, (SELECT count(*) FROM chunks) AS c)
        UNION ALL SELECT 'embedded', count(*), count(*), count(*), 0, 0, true FROM cvec""", "cvec", "chunks"),
    "index_status": B.oracle("SELECT (SELECT count(*) FROM chunks) AS database_chunks, (SELECT count(*) FROM cvec) AS vector_chunks, 16::BIGINT AS candidate_k, 0.65e0 AS vector_weight, 0.35e0 AS bm25_weight", "chunks", "cvec"),
    "embedding_parse": """SELECT vec_id, vec_id % 6 IN (0, 5) AS valid, CASE WHEN vec_id % 6 IN (0, 5) THEN len(embedding) END AS dims, CASE WHEN vec_id % 6 IN (0, 5) THEN round(list_sum(embedding::DOUBLE[]), 4) END AS total FROM embeddings""",
    "embedding_prep": f"""SELECT doc_id, i AS piece_no, length(p) AS n_chars, sha256(p) AS sha FROM (SELECT doc_id, i, substring(t, i * 300 + 1, 300) AS p FROM
      (SELECT doc_id, t, unnest(range(0, (length(t) - 1) // 300 + 1)) AS i FROM (SELECT doc_id, coalesce(nullif({B.d_strip('text')}, ''), ' ') AS t FROM documents)))""",
    "embedding_response": """SELECT vec_id // 64 AS batch_id, row_number() OVER (PARTITION BY vec_id // 64 ORDER BY vec_id DESC) - 1 AS position,
        count(*) FILTER (WHERE NOT gap) OVER (PARTITION BY vec_id // 64) = 64 AS complete, CASE WHEN NOT gap THEN round(embedding[1]::DOUBLE, 6) END AS first_value FROM (SELECT *, vec_id // 64 % 5 = 4 AND vec_id % 64 = 7 AS gap FROM embeddings)""",
    "embedding_backfill": B.oracle(f"""SELECT chunk_id, source, source_index // 4096 AS range_no, (row_number() OVER (PARTITION BY source, source_index // 4096 ORDER BY source_index) - 1) // 64 AS batch_no,
        sha256(coalesce(nullif({B.d_strip('content')}, ''), ' ')) AS sha FROM chunks WHERE chunk_id NOT IN (SELECT vec_id * 1000000 FROM embeddings WHERE vec_id % 5 <> 0)""", "chunks"),
    "registry_upload": B.oracle("""SELECT upload_id, CASE WHEN u.error IS NOT NULL THEN 'rejected' WHEN document_id IS NOT NULL OR upload_id <> first THEN 'duplicate' WHEN chunk_count > 0 THEN 'completed' ELSE 'failed' END AS status,
        CASE WHEN u.error IS NULL THEN coalesce(document_id, 'doc_' || first) END AS document_id, CASE WHEN u.error IS NULL AND document_id IS NULL AND upload_id = first THEN u.chunk_count ELSE 0 END AS chunks, u.error
        FROM upcheck u LEFT JOIN (SELECT sha, min(upload_id) AS first FROM upcheck WHERE error IS NULL GROUP BY sha) USING (sha) LEFT JOIN (SELECT sha, document_id FROM reg) USING (sha)""", "upcheck", "reg"),
    "client_validation": B.oracle("""SELECT upload_id, CASE WHEN lower(filename) NOT LIKE '%.pdf' THEN 'Only PDF files can be uploaded.' WHEN mime <> '' AND mime <> 'application/pdf' THEN 'The selected file does not have a PDF content type.'
        WHEN size > 20971520 THEN 'The selected PDF exceeds the 20 MB client limit.' WHEN size = 0 THEN 'The selected PDF is empty.' END AS error FROM uploads""", "uploads"),
    "registry_list": B.oracle("""SELECT document_id, source_id, filename, size_bytes, status, chunk_count, error, created, false AS duplicate,
        CASE WHEN size_bytes < 1024 THEN size_bytes || ' B' WHEN size_bytes < 1048576 THEN printf('%.1f KB', round(size_bytes / 1024, 1)) ELSE printf('%.1f MB', round(size_bytes / 1024 / 1024, 1)) END AS size_text,
        strftime(make_timestamp(created * 1000000), '%b %-d, %Y, %-I:%M %p') AS created_text FROM reg""", "reg"),
    "registry_get": B.oracle("SELECT document_id, filename IS NOT NULL AS found, filename, status FROM (SELECT 'doc_' || item_id * 3 AS document_id FROM benchmark) LEFT JOIN reg USING (document_id)", "reg"),
    "snapshot_retention": """WITH s AS (SELECT DISTINCT strftime(date_trunc('hour', ts), '%Y%m%d-%H%M%S-%f') AS name FROM events) SELECT name FROM s QUALIFY row_number() OVER (ORDER BY name DESC) > 5""",
    "translation_split": B.oracle("SELECT source, source_index, cached, lid AS logical_chunk_id, CASE WHEN cached THEN 'success' ELSE 'pending' END AS translation_status, zh AS content_zh FROM tsplit", "tsplit"),
    "translation_stats": B.oracle("""SELECT count(*) AS total, count(*) FILTER (WHERE cached) AS cached, count(*) FILTER (WHERE NOT cached AND source_index % 5 <> 0) AS translated,
        count(*) FILTER (WHERE NOT cached AND source_index % 5 = 0) AS failed FROM tsplit""", "tsplit"),
    "translated_chunks": B.oracle("""SELECT chunk_id, CASE WHEN lang = 'es' THEN 'not_applicable' WHEN status IS NOT NULL THEN status WHEN content_type = 'source_code' THEN 'skipped_source_code' ELSE 'missing' END AS translation_status,
        CASE WHEN lang <> 'es' THEN zh END AS content_zh FROM chunks_meta c LEFT JOIN (SELECT source, content_en, arg_max(status, source_index) AS status, arg_max(zh, source_index) AS zh FROM trans GROUP BY ALL) t
        ON c.source = t.source AND c.content = content_en""", "chunks_meta", "trans"),
    "metadata_override": B.oracle("""SELECT chunk_id, CASE WHEN r.source IS NOT NULL THEN 'registered' WHEN doc_id % 4 > 1 THEN 'stored' END AS origin, CASE WHEN r.source IS NULL AND doc_id % 4 > 1 THEN file_path END AS file_path
        FROM chunks_meta c LEFT JOIN (SELECT DISTINCT source, content FROM chunks WHERE lang = 'fr') r ON c.source = r.source AND c.content = r.content""", "chunks_meta"),
    "checkpoint_resume": """SELECT 'case-' || item_id AS case_id, NULL AS sha, 'pending' AS state FROM benchmark WHERE item_id NOT IN (SELECT conv_id * 3 FROM conversations)
        UNION ALL SELECT 'case-' || conv_id * 3, sha256(arg_max(text, turn)), 'completed' FROM conversations GROUP BY conv_id""",
    "request_validation": f"""SELECT conv_id, turn, CASE WHEN length(query) < 1 THEN 'query_too_short' WHEN length(query) > 20000 THEN 'query_too_long' WHEN {B.d_strip('query')} = '' THEN 'query_blank' WHEN length(session) > 128 THEN 'session_too_long' END AS error,
        nullif(trim(session), '') AS session_id FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '  ' WHEN 1 THEN repeat('s', (120 + conv_id % 20)::INT) ELSE ' s-' || conv_id END AS session,
          CASE turn % 7 WHEN 3 THEN '' WHEN 4 THEN ' ' || chr(9) || ' ' WHEN 5 THEN repeat(text, 60) ELSE text END AS query FROM conversations)""",
    "path_validation": r"""WITH p AS (SELECT page_id AS n, regexp_split_to_array(regexp_replace(url, '^https?://', ''), '[/?#]') AS ps FROM pages),
        q AS (SELECT n, ps[1] AS host, ps[2] AS lang, ['src', 'Build', 'node_modules', 'docs', 'pkg.egg-info', '.Git', 'a.min.js'][n % 7 + 1] AS folder, ['.md', '.py', '.RST', '', '.min.js'][n % 5 + 1] AS ext FROM p),
        r AS (SELECT *, lang || '/' || folder || '/' || host || ext AS path, CASE n % 3 WHEN 0 THEN replace(host, '.', '_') WHEN 1 THEN host ELSE '_' || lang END AS sid,
          lang || ['/main', '..x', '@{1}', '.lock', '-1.0', ' bad'][n % 6 + 1] AS rev FROM q)
      SELECT n AS page_id, folder NOT IN ('src', 'docs') OR ext = '.min.js' AS skipped, CASE WHEN ext = '' THEN regexp_extract(host, '\.[a-z]+$') WHEN ext = '.min.js' THEN '.js' ELSE lower(ext) END AS suffix,
        regexp_full_match(sid, '[a-z0-9][a-z0-9_-]*') AS source_ok, regexp_full_match(sid, '[a-z0-9_]+') AS manifest_ok, n % 6 IN (0, 4) AS revision_ok,
        CASE WHEN n % 4 IN (0, 2) AND n % 5 IN (0, 1) THEN 'https://github.com/' || host || '/repo' END AS repository FROM r""",
    "redact_secrets": f"""SELECT doc_id, i - 1 AS line_no, sha256(regexp_replace(regexp_replace(regexp_replace(coalesce(nullif(CASE (i - 1) % 3 WHEN 0 THEN 'Bearer abc.def failed; ' WHEN 1 THEN 'API_KEY = 123 sk-Ab_9 ' ELSE '' END || ls[i], ''), 'vector backend unavailable'),
          '(?i)bearer{_WS}+{_ANON}+', 'Bearer [REDACTED]', 'g'), '(?i)(?:api[_-]?key|token|secret){_WS}*[=:]{_WS}*{_ANON}+', '[REDACTED]', 'g'), 'sk-[A-Za-z0-9_-]+', '[REDACTED]', 'g')) AS sha
        FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))""",
    "source_names": B.oracle("""SELECT doc_id, coalesce(filename, CASE WHEN doc_id % 4 = 3 THEN source END, sid) AS name, filename IS NULL AND doc_id % 4 IN (1, 2) AS incomplete
        FROM (SELECT *, 'research:upload_' || doc_id AS sid FROM documents) LEFT JOIN (SELECT source_id, filename FROM reg) ON sid = source_id""", "reg"),
}
V["gone"] = "SELECT document_id, t.doc_id FROM reg JOIN toxic t ON document_id = 'doc_' || t.doc_id"
N["gone"] = ["reg", "toxic"]
ORACLE["delete_cascade"] = B.oracle("""SELECT document_id AS what, count(chunk_id) AS n FROM gone LEFT JOIN chunks ON chunks.doc_id = gone.doc_id GROUP BY document_id UNION ALL
    SELECT 'left in registry', count(*) FROM reg WHERE document_id NOT IN (SELECT document_id FROM gone) UNION ALL
    SELECT 'left in chunks', count(*) FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM gone) UNION ALL
    SELECT 'left in vectors', count(*) FROM cvec WHERE chunk_id // 1000000 NOT IN (SELECT doc_id FROM gone)""", "reg", "chunks", "cvec", "gone")
ORACLE["index_rebuild"] = B.oracle("""SELECT chunk_id, source, source_index, sha256(content) AS content_sha,
    CASE WHEN embedding IS NULL OR vec_id % 3 = 1 THEN length(content)::DOUBLE ELSE round(embedding[1]::DOUBLE, 6) END AS first_value
    FROM chunks LEFT JOIN embeddings ON chunk_id = vec_id * 1000000""", "chunks")
