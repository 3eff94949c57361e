"""Exact top-k by inner product with a three-phase uniform threshold.

A vector's score is the sum of partial scores of ``NODES`` groups of dimensions.
Phase 1 gathers the best entries of every group's local score lists; the k-th
best exact score among them is a safe cutoff. Phase 2 sends the cutoff out: an
entry all of whose partial scores lie below cutoff / NODES cannot reach it.
Phase 3 resolves the other entries exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from groundline.llm.base import Scratch, flat

NODES = 4
#: Bytes of query vectors sent to the tasks in one pass, and rows of either side multiplied at once.
PASS_BYTES, QUERY_ROWS, VECTOR_ROWS = 8 << 20, 256, 4096
NOTHING = np.iinfo(np.int64).min


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers, exact: by floats while they hold every partial sum, else by longer integers."""
    bound = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if bound < 2.0 ** 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if bound < 2.0 ** 61:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    limit = np.iinfo(np.int64).max // (2 * NODES)
    return np.clip(exact, -limit, limit).astype(np.int64)


def partial_scores(queries: np.ndarray, vectors: np.ndarray) -> list[np.ndarray]:
    groups = np.array_split(np.arange(queries.shape[1]), NODES)
    return [products(queries[:, g], vectors[:, g]) for g in groups]


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of a batch, one pair for each vector length and some thousand rows."""
    column = flat(batch.column("vector"))
    sizes = np.diff(column.offsets.to_numpy())
    ids = batch.column("vec_id").to_numpy()
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        for start in range(0, len(rows), VECTOR_ROWS):
            some = rows[start:start + VECTOR_ROWS]
            values = column.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False)
            yield ids[some], values.reshape(len(some), size)


class Queries:
    """Query vectors of one pass by vector length; a query's number is its place in ``ids``."""

    def __init__(self, table: pa.Table):
        self.ids = table.column("vec_id").to_numpy()
        column = flat(table.column("vector"))
        sizes = np.diff(column.offsets.to_numpy())
        self.groups = {}
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size)
            values = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
            self.groups[size] = (rows, values.reshape(len(rows), size))

    def parts(self, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        rows, values = self.groups.get(size, (np.zeros(0, np.int64), None))
        for start in range(0, len(rows), QUERY_ROWS):
            yield rows[start:start + QUERY_ROWS], values[start:start + QUERY_ROWS]


def _gather(queries: Queries, k: int):
    """Phase 1 of a task: for each query the k best exact scores among the best entries of all groups."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(queries.ids), k), NOTHING)
        for batch in batches:
            for ids, vectors in matrices(batch):
                for rows, values in queries.parts(vectors.shape[1]):
                    parts = partial_scores(values, vectors)
                    own = queries.ids[rows][:, None] == ids[None, :]
                    top = min(k + 1, len(ids))
                    lists = [np.argpartition(p, len(ids) - top, axis=1)[:, len(ids) - top:] for p in parts]
                    found = np.sort(np.concatenate(lists, axis=1), axis=1)
                    total = np.take_along_axis(sum(parts), found, axis=1)
                    again = np.zeros(found.shape, bool)
                    again[:, 1:] = found[:, 1:] == found[:, :-1]
                    total[again | np.take_along_axis(own, found, axis=1)] = NOTHING
                    merged = np.concatenate([best[rows], total], axis=1)
                    best[rows] = np.sort(merged, axis=1)[:, -k:]
        for start in range(0, len(best), QUERY_ROWS):
            part = best[start:start + QUERY_ROWS]
            yield pa.RecordBatch.from_arrays([pa.array([start // QUERY_ROWS], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["part", "scores"])
    return run


def _cutoffs(k: int):
    """The k-th best score of each query over the lists of all tasks; the least long if there are fewer."""
    def run(table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(s, np.int64).reshape(-1, k) for s in table.column("scores").to_pylist()]
        cut = np.sort(np.concatenate(lists, axis=1), axis=1)[:, -k]
        return pa.table({"part": table.column("part")[:1], "scores": pa.array([cut.tobytes()], pa.binary())})
    return run


def _resolve(queries: Queries, cutoff: np.ndarray, k: int):
    """Phases 2 and 3 of a task: exact scores of entries that may reach the cutoff, at most k for each query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[tuple[int, int]]] = {}
        for batch in batches:
            for ids, vectors in matrices(batch):
                for rows, values in queries.parts(vectors.shape[1]):
                    parts = partial_scores(values, vectors)
                    # rounded down, so that the cutoff itself passes
                    share = np.floor_divide(cutoff[rows], NODES)[:, None]
                    may = parts[0] >= share
                    for p in parts[1:]:
                        may |= p >= share
                    q, v = np.nonzero(may)
                    total = sum(p[q, v] for p in parts)
                    enough = (total >= cutoff[rows][q]) & (queries.ids[rows][q] != ids[v])
                    q, v, total = rows[q[enough]], ids[v[enough]], total[enough]
                    order = np.lexsort((v, -total, q))
                    q, v, total = q[order], v[order], total[order]
                    first = np.searchsorted(q, q)
                    few = np.arange(len(q)) - first < k
                    for i, s, n in zip(q[few].tolist(), total[few].tolist(), v[few].tolist(), strict=True):
                        kept.setdefault(i, []).append((-s, n))
                for i in [i for i, found in kept.items() if len(found) > 4 * k]:
                    kept[i] = sorted(kept[i])[:k]
        rows = [(int(queries.ids[i]), n, -s) for i, found in kept.items() for s, n in sorted(found)[:k]]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["query_id", "vec_id", "score"])
    return run


def integer_vectors(table: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, vector) with floor(scale * x) of every component; rows with null, NaN or infinite parts are left out.

    Of rows with the same vec_id the least vector stands for it.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    vector = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return (table.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite)
            .groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(vector).alias("vector")))


def top_k(vectors: DataFrame, is_query, k: int = 5, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query vector its k largest integer inner products.

    ``vectors`` has vec_id and vector; rows where ``is_query`` holds are queries,
    all rows but a query's own are its candidates, ties go to the smaller vec_id.
    With fewer candidates there are fewer rows. Vectors of another length than a
    query's are no candidates of it; no vectors or no queries give no rows.
    Products beyond a long are cut to its range.

    Queries go to the tasks in passes of about ``pass_bytes``, chosen by a hash;
    each task multiplies blocks of its own vectors with them. Only score lists,
    cutoffs and at most k entries per query and task move.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    stored = scratch.write(vectors.select("vec_id", "vector"), "vectors")
    queries = stored.where(is_query)
    size = queries.agg(F.sum(8 * F.size("vector") + 8)).first()[0] or 0
    passes = max(1, -(-int(size) // pass_bytes))
    out = None
    for number in range(passes):
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == number).toArrow()
        if not rows.num_rows:
            continue
        wanted = Queries(rows)
        lists = stored.mapInArrow(_gather(wanted, k), "part int, scores binary")
        merged = lists.groupBy("part").applyInArrow(_cutoffs(k), "part int, scores binary").orderBy("part").toArrow()
        cutoff = np.concatenate([np.frombuffer(s, np.int64) for s in merged.column("scores").to_pylist()])
        found = stored.mapInArrow(_resolve(wanted, cutoff, k), "query_id long, vec_id long, score long")
        out = found if out is None else out.union(found)
    if out is None:
        out = spark.createDataFrame([], "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
