"""Search a chunk table with a table of questions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from groundline import config as C
from groundline.functions import text as T
from groundline.operators.hybrid import expand, fuse, rerank, rerank_features
from groundline.operators.lexical import bm25_topk, corpus_stats, document_frequency, term_index
from groundline.operators.vectors import vector_topk
from groundline.session import broadcast_if_small, materialize


@dataclass(frozen=True)
class SearchTables:
    """What a search reads: chunks, their term lists and vectors, document frequencies, corpus statistics."""

    chunks: DataFrame
    index: DataFrame
    vectors: DataFrame
    frequencies: DataFrame
    stats: DataFrame

    @classmethod
    def build(cls, chunks: DataFrame, vectors: DataFrame, *, written: bool = False, index: DataFrame | None = None) -> "SearchTables":
        """Write every table once; later steps read their columns from files, and no search counts the corpus again.

        ``written`` chunks are read from files already: only their term lists are added, unless ``index`` has them.
        """
        texts = chunks if written else materialize(chunks, "chunks")
        index = materialize(term_index(texts), "terms") if index is None else index
        return cls(texts, index, materialize(vectors, "vectors"),
                   materialize(document_frequency(index), "frequencies"), materialize(corpus_stats(index), "statistics"))

    def bm25(self, queries: DataFrame, k: int = C.CANDIDATE_K) -> DataFrame:
        return bm25_topk(self.index, queries, k, frequencies=self.frequencies, stats=self.stats)


def with_search_text(chunks: DataFrame) -> DataFrame:
    """Add the searchable text and the section (symbol, else leading heading)."""
    names = ("title", "file_path", "symbol", "symbol_tokens", "structural_tokens", "aliases_zh", "content_type")
    fields = [F.col(c) if c in chunks.columns else F.lit("") for c in names]
    zh = F.col("content_zh") if "content_zh" in chunks.columns else F.lit(None).cast("string")
    section = T.coalesce_text("symbol") if "symbol" in chunks.columns else F.lit(None).cast("string")
    return chunks.withColumn("search_text", T.retrieval_text(zh, fields, "content")).withColumn(
        "section", F.coalesce(section, T.markdown_section("content")))


def check_corpus(corpus: str | None) -> None:
    if corpus not in (None, "research"):
        raise ValueError(f"Unsupported corpus: {corpus}")


def ranked_hits(tables: SearchTables, queries: DataFrame, top_k: int = C.TOP_K, *, reranking: bool = True,
                corpus: str | None = None) -> DataFrame:
    """Hybrid hits per query before expansion, with every stage's scores."""
    check_corpus(corpus)
    k = max(top_k, C.CANDIDATE_K)
    n = queries.count()
    fused = fuse(vector_topk(tables.vectors, queries, k), tables.bm25(queries, k), k)
    if not reranking:
        return fused.filter(F.col("rank") <= top_k).withColumn("fusion_score", F.col("score"))
    return rerank(rerank_features(fused, queries, tables.chunks, n * k), top_k)


def retrieve(tables: SearchTables, queries: DataFrame, top_k: int = C.TOP_K, *, reranking: bool = True,
             corpus: str | None = None) -> DataFrame:
    """Final results: ranked hits, the best one expanded by its neighbours.

    Columns: query_id, rank, chunk_id, source, section, content, score, the stage
    scores and ``retrieved_by``.
    """
    n = queries.count()
    hits = materialize(ranked_hits(tables, queries, top_k, reranking=reranking, corpus=corpus), "hits")
    best = expand(hits.filter("rank = 1").select("query_id", "chunk_id"), tables.chunks, n).select(
        "query_id", "chunk_id", "expanded")
    details = [c for c in tables.chunks.columns if c not in ("content", "search_text", "chunk_id")]
    texts = tables.chunks.select("chunk_id", "content", *details)
    found = texts.join(broadcast_if_small(hits, n * top_k, 120), "chunk_id")
    return (
        found.join(broadcast_if_small(best, n, 6000), ["query_id", "chunk_id"], "left")
        .select(
            "query_id", "rank", "chunk_id", *details,
            F.when(F.col("rank") == 1, F.coalesce("expanded", "content")).otherwise(F.col("content")).alias("content"),
            "score", F.col("b_raw").alias("bm25_score"), F.col("v_raw").alias("vector_score"), "fusion_score",
            F.array_compact(F.array(
                F.when(F.col("b_raw") > 0, F.lit("bm25")), F.when(F.col("v_raw") > 0, F.lit("vector")),
            )).alias("retrieved_by"),
        )
    )
