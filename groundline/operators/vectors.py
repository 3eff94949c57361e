"""Vector table upkeep and exact cosine top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from groundline import config as C
from groundline.functions import text as T
from groundline.operators.topk import LocalTopK, passes, query_passes


def parse_embedding(raw: Column) -> Column:
    """JSON text to array<double>; anything but a non-empty list of numbers is NULL."""
    listed = F.from_json(raw, "array<string>")
    numbers = F.from_json(raw, "array<double>")
    quoted = F.regexp_like(raw, F.lit(r'["{tfn]'))
    good = (F.size(listed) > 0) & ~quoted & ~F.exists(numbers, lambda x: x.isNull())
    return F.when(good, numbers)


def embedding_text(text: Column) -> Column:
    """Text sent to an embedding model: stripped, blank becomes one space."""
    return F.coalesce(F.nullif(T.strip(text), F.lit("")), F.lit(" "))


def embedding_pieces(text: Column, max_chars: int = C.EMBEDDING_MAX_CHARS) -> Column:
    """Consecutive pieces of the text of at most ``max_chars``; together they are the whole text."""
    limit = max(C.EMBEDDING_MIN_CHARS, max_chars)
    whole = embedding_text(text)
    starts = F.sequence(F.lit(0), F.floor((F.length(whole) - 1) / limit).cast("int"))
    return F.transform(starts, lambda i: F.substring(whole, i * limit + 1, F.lit(limit)))


def distance_score(distance: Column) -> Column:
    """Similarity in (0, 1]; a missing distance counts as 1."""
    return 1.0 / (1.0 + F.greatest(F.lit(0.0), F.coalesce(distance, F.lit(1.0))))


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norm == 0, 1.0, norm)


def _by_size(ids: pa.Array, lists: pa.Array) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(length, ids, unit vectors) for every vector length."""
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes).tolist():
        rows = pa.array(np.flatnonzero(sizes == size))
        flat = lists.take(rows).flatten().to_numpy(zero_copy_only=False)
        yield size, ids.take(rows), _unit_rows(flat.reshape(len(rows), size).astype(np.float64))


def _search(batches: Iterator[pa.RecordBatch], ids: pa.Array, queries: dict[int, tuple[int, np.ndarray]], k: int):
    """``queries``: first query and matrix per vector length."""
    best = LocalTopK(len(ids), k)
    for batch in batches:
        for lo in range(0, batch.num_rows, 4096):
            part = batch.slice(lo, 4096)
            for size, chunk_ids, rows in _by_size(part["chunk_id"], part["embedding"]):
                start, matrix = queries.get(size, (0, np.zeros((0, size))))
                for first in range(0, len(matrix), 512):
                    cosine = rows @ matrix[first:first + 512].T
                    best.add(start + first, chunk_ids.to_numpy(), 1.0 / (1.0 + np.maximum(0.0, 1.0 - cosine)))
    yield best.batch(ids)


def _searchable(c: str = "embedding") -> Column:
    """Neither missing nor empty nor with missing parts."""
    return F.coalesce((F.size(c) > 0) & ~F.exists(c, lambda x: x.isNull()), F.lit(False))


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = C.CANDIDATE_K) -> DataFrame:
    """Exact cosine top ``k`` per query among the vectors of its length: (query_id, chunk_id, score, rank).

    Queries are a broadcast matrix per length of checked size (split into passes
    beyond it); each task multiplies its own vectors with it and emits its local
    top k, so no pair of query and chunk is ever a row. ``vector_status`` tells
    which queries and vectors cannot take part.
    """
    spark = vectors.sparkSession
    asked = queries.filter(_searchable()).select("query_id", "embedding")
    n, total = asked.agg(F.count("*"), F.sum(F.size("embedding"))).first()
    id_type = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {id_type}, chunk_id long, score double"
    usable = vectors.filter(_searchable() & F.col("chunk_id").isNotNull()).select("chunk_id", "embedding")

    def run(table: pa.Table) -> DataFrame:
        table = table.combine_chunks()
        found = list(_by_size(table["query_id"].combine_chunks(), table["embedding"].combine_chunks()))
        starts = np.cumsum([0, *(len(ids) for _, ids, _ in found)]).tolist()
        shared = spark.sparkContext.broadcast((pa.concat_arrays([ids for _, ids, _ in found]),
                                               {size: (at, matrix) for (size, _, matrix), at in zip(found, starts, strict=False)}))
        return usable.mapInArrow(lambda it: _search(it, shared.value[0], shared.value[1], k), schema)

    return query_passes(spark, passes(asked, n, 8 * -(-(total or 0) // max(n, 1)) + 32), run, schema, k)


def vector_status(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query: (query_id, status, reason, vectors_searched); status is used or fallback (BM25 alone).

    Counts per vector length are small and combine before their shuffle.
    """
    known = vectors.filter(_searchable() & F.col("chunk_id").isNotNull()).groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n"))
    asked = queries.select("query_id", F.when(_searchable(), F.size("embedding")).alias("size"))
    searched = F.coalesce("n", F.lit(0))
    return asked.join(known, "size", "left").select(
        "query_id", F.when(searched > 0, F.lit("used")).otherwise(F.lit("fallback")).alias("status"),
        F.when(F.col("size").isNull(), F.lit("no_query_vector")).when(searched == 0, F.lit("no_vectors_of_this_size")).alias("reason"),
        searched.alias("vectors_searched"))


# ---- vector table upkeep -------------------------------------------------------

def upsert(vectors: DataFrame, updates: DataFrame) -> DataFrame:
    """Vectors after an upsert: rows without id or content are skipped, the latest row wins."""
    new = (
        updates.filter(F.col("chunk_id").isNotNull() & (T.strip("content") != ""))
        .groupBy("chunk_id")
        .agg(F.max_by(F.struct("source", "source_index", "content", "embedding"), "version").alias("_r"))
        .select(
            "chunk_id", "_r.source", "_r.source_index", F.lit("research").alias("corpus"),
            F.coalesce(T.markdown_section("_r.content"), F.lit("")).alias("section"), "_r.embedding",
        )
    )
    return vectors.join(new.select("chunk_id"), "chunk_id", "left_anti").unionByName(new)


def sync(vectors: DataFrame, chunks: DataFrame, updates: DataFrame) -> DataFrame:
    """Drop vectors whose chunk is gone, then upsert."""
    return upsert(vectors.join(chunks.select("chunk_id"), "chunk_id", "left_semi"), updates)


def stale_ids(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    return vectors.select("chunk_id").join(chunks.select("chunk_id"), "chunk_id", "left_anti")


def index_freshness(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: counts and whether the vector table mirrors the chunk table exactly."""
    v = vectors.select("chunk_id", F.lit(1).alias("_v"))
    c = chunks.select("chunk_id", F.col("embedding").isNotNull().alias("_e"), F.lit(1).alias("_c"))
    return v.join(c, "chunk_id", "full_outer").agg(
        F.count("_v").alias("vector_rows"),
        F.count("_c").alias("chunk_rows"),
        F.count_if("_e").alias("embedded_rows"),
        F.count_if(F.col("_c").isNull()).alias("stale_rows"),
        F.count_if(F.col("_v").isNull()).alias("missing_rows"),
        ((F.count("_v") == F.count("_c")) & (F.count_if("_e") == F.count("_c"))
         & (F.count_if(F.col("_c").isNull() | F.col("_v").isNull()) == 0)).alias("fresh"),
    )


def backfill_worklist(chunks: DataFrame, raw: str = "embedding_json", batch: int = C.EMBEDDING_BATCH) -> DataFrame:
    """Chunks whose stored vector is missing or invalid, with request batches of ``batch``.

    Batches are cut inside (source, 4096-chunk range), so numbering needs no
    global order.
    """
    todo = chunks.filter(parse_embedding(F.col(raw)).isNull())
    part = F.floor(F.col("source_index") / 4096)
    w = Window.partitionBy("source", part).orderBy("source_index")
    return todo.select(
        "chunk_id", "source", "source_index", part.cast("long").alias("range_no"),
        F.floor((F.row_number().over(w) - 1) / batch).cast("long").alias("batch_no"),
        embedding_text(F.col("content")).alias("input"),
    )


def embedding_response(rows: DataFrame) -> DataFrame:
    """Response vectors put back by ``index``; ``complete`` tells whether none is missing."""
    w = Window.partitionBy("batch_id")
    good = F.coalesce(F.size("embedding") > 0, F.lit(False))
    return rows.select(
        "batch_id",
        (F.row_number().over(w.orderBy(F.coalesce("index", F.lit(0)))) - 1).cast("long").alias("position"),
        "embedding",
        ((F.count_if(good).over(w) == F.count("*").over(w)) & (F.count("*").over(w) == F.col("expected"))).alias("complete"),
    )
