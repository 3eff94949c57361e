"""Fusion of vector and BM25 hits, reranking and neighbour expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from groundline import config as C
from groundline.functions import text as T
from groundline.operators.lexical import normalize, rank_by_score
from groundline.session import BROADCAST_LIMIT, broadcast_if_small


def fuse(vector: DataFrame, bm25: DataFrame, k: int = C.CANDIDATE_K,
         vector_weight: float = C.VECTOR_WEIGHT, bm25_weight: float = C.BM25_WEIGHT) -> DataFrame:
    """Weighted sum of per-query normalized scores, top ``k``.

    A query without vector hits is ranked by BM25 alone. Ties keep insertion
    order: vector hits by rank, then BM25 hits by rank.
    """
    v = normalize(vector).select("query_id", "chunk_id", F.col("norm").alias("v_norm"), F.col("score").alias("v_raw"),
                                 F.col("rank").alias("v_rank"), F.lit(None).cast("double").alias("b_norm"),
                                 F.lit(None).cast("double").alias("b_raw"), F.lit(None).cast("long").alias("b_rank"))
    b = normalize(bm25).select("query_id", "chunk_id", F.lit(None).cast("double").alias("v_norm"),
                               F.lit(None).cast("double").alias("v_raw"), F.lit(None).cast("long").alias("v_rank"),
                               F.col("norm").alias("b_norm"), F.col("score").alias("b_raw"), F.col("rank").alias("b_rank"))
    both = v.unionByName(b).groupBy("query_id", "chunk_id").agg(
        *[F.max(c).alias(c) for c in ("v_norm", "v_raw", "v_rank", "b_norm", "b_raw", "b_rank")])
    per_query = Window.partitionBy("query_id")
    n_vector = F.count("v_rank").over(per_query)
    vw = F.when(n_vector > 0, F.lit(max(0.0, vector_weight))).otherwise(F.lit(0.0))
    bw = F.when((vw == 0.0) & F.lit(max(0.0, bm25_weight) == 0.0), F.lit(1.0)).otherwise(F.lit(max(0.0, bm25_weight)))
    scored = both.withColumn("n_vector", n_vector).select(
        "query_id", "chunk_id", "v_raw", "b_raw",
        F.coalesce("v_norm", F.lit(0.0)).alias("v_norm"), F.coalesce("b_norm", F.lit(0.0)).alias("b_norm"),
        F.coalesce("v_rank", F.col("n_vector") + F.col("b_rank")).alias("insert_pos"),
        ((F.coalesce("v_norm", F.lit(0.0)) * vw + F.coalesce("b_norm", F.lit(0.0)) * bw) / (vw + bw)).alias("score"),
    )
    return rank_by_score(scored, k, "insert_pos")


def rerank_features(candidates: DataFrame, queries: DataFrame, chunks: DataFrame, n_candidates: int) -> DataFrame:
    """Candidate rows with lexical features of (query, chunk search text).

    ``n_candidates`` bounds the candidate rows; under the broadcast limit the
    chunk table is only scanned, beyond it the join shuffles.
    """
    asked = candidates.join(queries.select("query_id", "query"), "query_id")
    texts = chunks.select("chunk_id", "search_text")
    pairs = texts.join(broadcast_if_small(asked, n_candidates, 600), "chunk_id")
    listed = pairs.withColumn("_q", T.tokens("query")).withColumn("_c", T.tokens("search_text"))
    return listed.select(
        *candidates.columns,
        T.token_cosine(F.col("_q"), F.col("_c")).alias("cosine"),
        T.token_coverage(F.col("_q"), F.col("_c")).alias("coverage"),
        T.keyword_score("query", "search_text").alias("keyword"),
        T.phrase_score("query", "search_text").alias("phrase"),
    ).withColumn("lexical", F.col("cosine") * C.LEXICAL_COSINE + F.col("keyword") * C.LEXICAL_KEYWORD)


def rerank(features: DataFrame, k: int) -> DataFrame:
    """Reranked top ``k``; ties keep fused order. ``score`` becomes the rerank score."""
    score = (F.col("score") * C.RERANK_BASE + F.col("lexical") * C.RERANK_LEXICAL
             + F.col("coverage") * C.RERANK_COVERAGE + F.col("phrase") * C.RERANK_PHRASE)
    renamed = features.withColumn("rerank_score", score).withColumnRenamed("score", "fusion_score")
    return rank_by_score(
        renamed.withColumnRenamed("rank", "fused_rank").withColumnRenamed("rerank_score", "score"), k, "fused_rank")


def expand(hits: DataFrame, chunks: DataFrame, n_hits: int) -> DataFrame:
    """Text of each hit with its direct neighbours: (…hits, expanded, n_neighbours).

    Neighbours share the source and differ by at most one in source_index; in
    ``research:`` sources also the section. Few hits ask for three exact keys each,
    by a broadcast; many are expanded range by range. No source is a hot key.
    """
    if 3 * n_hits * 160 > BROADCAST_LIMIT:
        return _expand_many(hits, chunks)
    me = chunks.select("chunk_id", "source", "source_index", "section")
    at = me.join(broadcast_if_small(hits.select("chunk_id").distinct(), n_hits, 16), "chunk_id")
    wanted = at.select(
        "chunk_id", "source", F.col("section").alias("_section"),
        F.explode(F.sequence(F.col("source_index") - 1, F.col("source_index") + 1)).alias("source_index"),
    )
    near = chunks.select("source", "source_index", "section", "content")
    same = ~F.startswith("source", F.lit("research:")) | F.col("section").eqNullSafe(F.col("_section"))
    found = near.join(broadcast_if_small(wanted, 3 * n_hits, 160), ["source", "source_index"]).filter(same)
    texts = found.groupBy("chunk_id").agg(
        F.array_sort(F.collect_list(F.struct("source_index", "content"))).alias("_n"))
    expanded = texts.select(
        "chunk_id", F.array_join(F.col("_n.content"), "\n\n").alias("expanded"),
        F.size("_n").cast("long").alias("n_neighbours"))
    return hits.join(expanded, "chunk_id", "left")


#: Source positions of a range; its chunks and hits stay below the rows a window holds in memory.
RANGE = 1024


def _expand_many(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """The same for any number of hits: each text moves once, to the range of its source that it lies in.

    Chunks at the edge of a range also go to the next one. Hits move without
    text and collect the contents beside them in a window over the range.
    """
    index, research = F.col("source_index"), F.startswith("source", F.lit("research:"))
    me = chunks.select("chunk_id", F.col("source").alias("_source"), F.col("source_index").cast("long").alias("_index"), F.col("section").alias("_section"))
    own = F.coalesce(F.floor(F.col("_index") / RANGE), F.pmod(F.xxhash64("chunk_id"), F.lit(RANGE)))
    asked = hits.join(me, "chunk_id", "left").select(
        F.struct(*hits.columns).alias("_hit"), F.col("_source").alias("source"), F.col("_index").alias("source_index"),
        F.col("_section").alias("section"), own.alias("_range"), F.lit(None).cast("string").alias("content"), F.lit(False).alias("_text"))
    placed = chunks.select("source", index.cast("long").alias("source_index"), "section", "content").filter("source IS NOT NULL AND source_index IS NOT NULL")
    ranges = F.array_distinct(F.array(*[F.floor((index + i) / RANGE) for i in (-1, 0, 1)]))
    texts = placed.withColumns({"_hit": F.lit(None).cast(asked.schema["_hit"].dataType), "_range": F.explode(ranges), "_text": F.lit(True)})
    w = Window.partitionBy("source", "_range").orderBy("source_index").rangeBetween(-1, 1)
    beside = F.collect_list(F.when(F.col("_text"), F.struct("source_index", "content", "section"))).over(w)
    found = asked.unionByName(texts).withColumn("_n", beside).filter(~F.col("_text")).withColumn(
        "_n", F.array_sort(F.filter("_n", lambda n: ~research | n["section"].eqNullSafe(F.col("section")))))
    return found.select("_hit.*", F.when(F.size("_n") > 0, F.array_join(F.col("_n.content"), "\n\n")).alias("expanded"),
                        F.when(F.size("_n") > 0, F.size("_n").cast("long")).alias("n_neighbours"))
