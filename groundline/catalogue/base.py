"""Input views of the query catalogue, in Spark and as SQL for the check.

Both sides derive from the given tables only and cover them whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from groundline.functions import text as T
from groundline.operators.chunking import window_chunks
from groundline.operators.lexical import term_index
from groundline.plans.retrieval import SearchTables, with_search_text
from groundline.session import materialize, spread


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return spread(df) if name == "documents" else df


_STORED: dict[tuple, object] = {}


def stored(spark: SparkSession, d: str, name: str, build):
    """``build()`` once per session and state of the table folder: what queries share is written once, like a kept index.

    The state is the listing of the tables that are read, so a changed file is built anew.
    """
    listing = spark.read.format("binaryFile").load([f"{d}/{t}.parquet" for t in ("documents", "embeddings", "benchmark")]).select(
        F.crc32(F.concat_ws("|", "path", "modificationTime", "length").cast("binary")).alias("c")).agg(F.count("*"), F.sum("c")).first()
    key = (spark.sparkContext.applicationId, spark._jsparkSession.hashCode(), d, name, tuple(listing))
    if key not in _STORED:
        _STORED[key] = build()
    return _STORED[key]


# ---- Spark views -----------------------------------------------------------------

def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Window chunks of all documents with provenance columns, cut and written once."""
    return stored(spark, d, "chunks", lambda: materialize(cut_chunks(spark, d), "chunks"))


def cut_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(
        "doc_id", "text", "lang", F.concat(F.lit("research:"), "source").alias("source"), F.col("source").alias("title"))
    return window_chunks(docs).select(
        (F.col("doc_id") * 1000000 + F.col("part")).alias("chunk_id"), "doc_id", F.col("part").cast("long").alias("part"),
        "source", "source_index", "title", "lang",
        F.concat("title", F.lit("/"), "doc_id", F.lit(".txt")).alias("file_path"),
        F.concat(F.lit("Section "), F.floor(F.col("source_index") / 3)).alias("symbol"),
        F.concat(F.lit("Section "), F.floor(F.col("source_index") / 3)).alias("symbol_tokens"),
        F.when(F.col("lang") == "de", F.lit("source_code")).otherwise(F.lit("paper")).alias("content_type"),
        F.when(F.col("lang") == "en", F.lit("paper")).when(F.col("lang") == "fr", F.lit("documentation")).alias("source_type"),
        F.lit(None).cast("string").alias("repository_url"),
        "content",
    )


def chunk_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The embedding of number v belongs to the first chunk of document v."""
    return table(spark, d, "embeddings").select((F.col("vec_id") * 1000000).alias("chunk_id"), "embedding").join(
        chunks(spark, d).filter("part = 0").select("chunk_id", "source", "source_index", "content"), "chunk_id")


def queries(spark: SparkSession, d: str) -> DataFrame:
    """All benchmark texts; question i asks with embedding 20 i, so later ones have none."""
    vec = table(spark, d, "embeddings").select("vec_id", "embedding")
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")).join(
        vec, F.col("query_id") * 20 == F.col("vec_id"), "left").drop("vec_id")


def term_lists(spark: SparkSession, d: str) -> DataFrame:
    """Term lists of all chunks, written once."""
    return stored(spark, d, "terms", lambda: materialize(term_index(with_search_text(chunks(spark, d))), "terms"))


def search_tables(spark: SparkSession, d: str) -> SearchTables:
    def build() -> SearchTables:
        return SearchTables.build(with_search_text(chunks(spark, d)), chunk_vectors(spark, d).select("chunk_id", "embedding"), written=True,
                                  index=term_lists(spark, d))

    return stored(spark, d, "search", build)


# ---- the same views in SQL ---------------------------------------------------------

WS = T.WS


def d_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def d_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def d_tokens(x: str) -> str:
    cjk = f"regexp_extract_all(lower({x}), '[\\x{{4e00}}-\\x{{9fff}}]')"
    return (f"list_concat(regexp_extract_all(lower({x}), '[a-z0-9_]+|[\\x{{4e00}}-\\x{{9fff}}]'), "
            f"list_transform(list_zip({cjk}[1:-2], {cjk}[2:]), lambda p: p[1] || p[2]))")


def d_alnum(x: str) -> str:
    return f"lower(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]', '', 'g'))"


def d_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def d_any(x: str, terms) -> str:
    return "(" + " OR ".join(f"contains({x}, '{t}')" for t in terms) + ")"


def d_lines(x: str) -> str:
    return (f"list_filter(list_transform(regexp_split_to_array({x}, '{T.LINE_BREAK}'), "
            f"lambda l: {d_strip('l')}), lambda l: l <> '')")


VIEWS: dict[str, str] = {
    "flat_docs": f"""SELECT doc_id, 'research:' || source AS source, source AS title, lang, {d_collapse('text')} AS t FROM documents""",
    "chunks": """SELECT doc_id * 1000000 + part AS chunk_id, doc_id, part, source,
        row_number() OVER (PARTITION BY source ORDER BY doc_id, part) - 1 AS source_index, title, lang,
        substring(t, part * 1550 + 1, 1800) AS content
      FROM (SELECT *, unnest(range(0, (length(t) - 1) // 1550 + 1)) AS part FROM flat_docs WHERE length(t) > 0)""",
    "chunks_meta": """SELECT *, title || '/' || doc_id || '.txt' AS file_path,
        'Section ' || (source_index // 3) AS symbol,
        CASE WHEN lang = 'de' THEN 'source_code' ELSE 'paper' END AS content_type,
        CASE lang WHEN 'en' THEN 'paper' WHEN 'fr' THEN 'documentation' END AS source_type
      FROM chunks""",
    "search_texts": """SELECT *, title || ' ' || file_path || ' ' || symbol || ' ' || symbol || '   ' || content_type || chr(10) || content AS search_text
      FROM chunks_meta""",
    "queries": """SELECT item_id AS query_id, text AS query, embedding FROM benchmark LEFT JOIN embeddings ON vec_id = item_id * 20""",
    "idx": f"""SELECT chunk_id, {d_tokens('search_text')} AS toks FROM search_texts""",
    "post": """SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(toks) AS term FROM idx) GROUP BY ALL""",
    "lens": """SELECT chunk_id, len(toks) AS dl FROM idx""",
    "stats": """SELECT count(*) AS n, coalesce(nullif(sum(dl) / count(*), 0), 1e0)::DOUBLE AS avgdl FROM lens""",
    "dfs": """SELECT term, count(*) AS df FROM post GROUP BY term""",
    "qt": f"""SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest({d_tokens('query')}) AS term FROM queries) GROUP BY ALL""",
    "bm": """SELECT query_id, chunk_id, sum(ln(1e0 + (n - df + 0.5e0) / (df + 0.5e0)) * (1e0 + ln(qf))
          * (tf * 2.5e0) / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl))) AS score
      FROM qt JOIN post USING (term) JOIN dfs USING (term) JOIN lens USING (chunk_id), stats GROUP BY ALL""",
    "bmk": """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank
      FROM bm QUALIFY rank <= 16""",
    "cvec": """SELECT chunk_id, embedding::DOUBLE[] AS e FROM embeddings JOIN chunks ON chunk_id = vec_id * 1000000""",
    "vk": """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM (
        SELECT query_id, chunk_id, 1e0 / (1e0 + greatest(0e0, 1e0 - list_cosine_similarity(q.embedding::DOUBLE[], e))) AS score
        FROM queries q, cvec WHERE q.embedding IS NOT NULL) QUALIFY rank <= 16""",
    "bmn": """SELECT *, CASE WHEN hi - lo <= 1e-9 * hi THEN 1e0 ELSE (score - lo) / (hi - lo) END AS norm FROM
        (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM bmk)""",
    "vn": """SELECT *, CASE WHEN hi - lo <= 1e-9 * hi THEN 1e0 ELSE (score - lo) / (hi - lo) END AS norm FROM
        (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM vk)""",
    "fusedall": """SELECT query_id, chunk_id, v.score AS v_raw, b.score AS b_raw,
        coalesce(v.norm, 0e0) AS v_norm, coalesce(b.norm, 0e0) AS b_norm,
        coalesce(v.rank, coalesce(nv, 0) + b.rank) AS insert_pos,
        CASE WHEN nv IS NULL THEN coalesce(b.norm, 0e0)
             ELSE (coalesce(v.norm, 0e0) * 0.65e0 + coalesce(b.norm, 0e0) * 0.35e0) / (0.65e0 + 0.35e0) END AS score
      FROM vn v FULL JOIN bmn b USING (query_id, chunk_id)
      LEFT JOIN (SELECT query_id, count(*) AS nv FROM vk GROUP BY query_id) USING (query_id)""",
    "fused": """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, insert_pos) AS rank
      FROM fusedall QUALIFY rank <= 16""",
    "feat": f"""SELECT f.*, coalesce(dot, 0) / (qn * cn) AS cosine, coalesce(common, 0) / nq AS coverage,
        CASE WHEN len(kt) = 0 THEN 0e0 ELSE len(list_filter(kt, lambda t: contains(lower(search_text), t))) / len(kt) END AS keyword,
        CASE WHEN contains(regexp_replace(lower(search_text), '{WS}+', '', 'g'), regexp_replace(lower(query), '{WS}+', '', 'g')) THEN 1e0
             WHEN len(kt) = 0 THEN 0e0
             ELSE len(list_filter(kt, lambda t: contains(lower(search_text), t))) / len(kt) END AS phrase
      FROM fused f
      JOIN (SELECT query_id, query, list_filter(regexp_split_to_array(lower(query), '{T.TERM_SPLIT}'), lambda t: length(t) >= 2) AS kt FROM queries) USING (query_id)
      JOIN (SELECT query_id, sqrt(sum(qf * qf)) AS qn, count(*) AS nq FROM qt GROUP BY 1) USING (query_id)
      JOIN search_texts USING (chunk_id)
      JOIN (SELECT chunk_id, sqrt(sum(tf * tf)) AS cn FROM post GROUP BY 1) USING (chunk_id)
      LEFT JOIN (SELECT query_id, chunk_id, sum(qf * tf) AS dot, count(*) AS common
                 FROM fused JOIN qt USING (query_id) JOIN post USING (chunk_id, term) GROUP BY 1, 2) USING (query_id, chunk_id)""",
    "reranked": """SELECT query_id, chunk_id, v_raw, b_raw, score AS fusion_score, rank AS fused_rank,
        score * 0.55e0 + (cosine * 0.75e0 + keyword * 0.25e0) * 0.25e0 + coverage * 0.15e0 + phrase * 0.05e0 AS rscore
      FROM feat""",
    "ranked": """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rscore, 9) DESC, fused_rank) AS final_rank FROM reranked""",
    "expanded": """SELECT a.chunk_id, count(*) AS n_neighbours, string_agg(b.content, chr(10) || chr(10) ORDER BY b.source_index) AS expanded
      FROM chunks_meta a JOIN chunks_meta b ON a.source = b.source AND b.source_index BETWEEN a.source_index - 1 AND a.source_index + 1
        AND a.symbol = b.symbol GROUP BY a.chunk_id""",
}

NEEDS: dict[str, list[str]] = {
    "chunks": ["flat_docs"], "chunks_meta": ["chunks"], "search_texts": ["chunks_meta"],
    "idx": ["search_texts"], "post": ["idx"], "lens": ["idx"], "stats": ["lens"], "dfs": ["post"],
    "qt": ["queries"], "bm": ["qt", "post", "dfs", "lens", "stats"], "bmk": ["bm"],
    "cvec": ["chunks"], "vk": ["queries", "cvec"], "bmn": ["bmk"], "vn": ["vk"],
    "fusedall": ["vn", "bmn", "vk"], "fused": ["fusedall"],
    "feat": ["fused", "queries", "qt", "search_texts", "post"],
    "reranked": ["feat"], "ranked": ["reranked"], "expanded": ["chunks_meta"],
}


def oracle(select: str, *needs: str) -> str:
    """``select`` with the views it needs in front, dependencies first."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for dep in NEEDS.get(name, []):
                visit(dep)
            order.append(name)

    for name in needs:
        visit(name)
    if not order:
        return select
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in order) + "\n" + select
