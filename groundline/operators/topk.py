"""Shared pieces of the exact block-wise top-k searches (terms and vectors)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from groundline.session import BROADCAST_LIMIT, materialize, ship_package


class LocalTopK:
    """Best k positive scores per query among the rows one task has seen.

    Order is (score rounded to 9 digits, descending; chunk id), the same as the
    final ranking, so cutting locally never loses a final result.
    """

    def __init__(self, queries: int, k: int):
        self.k = k
        self.floor = np.zeros(queries)
        self.q = np.empty(0, np.int64)
        self.ids = np.empty(0, np.int64)
        self.scores = np.empty(0)

    def add(self, first: int, ids: np.ndarray, scores: np.ndarray) -> None:
        """Offer a (rows × queries) score block for queries ``first``…"""
        key = np.round(scores, 9)
        floor = self.floor[first:first + scores.shape[1]]
        if scores.shape[0] > self.k:
            floor = np.maximum(floor, np.partition(key, -self.k, axis=0)[-self.k])
        row, column = np.nonzero((key >= floor) & (scores > 0))
        self.q = np.concatenate([self.q, column + first])
        self.ids = np.concatenate([self.ids, ids[row]])
        self.scores = np.concatenate([self.scores, scores[row, column]])
        self._cut()

    def _cut(self) -> None:
        key = np.round(self.scores, 9)
        order = np.lexsort((self.ids, -key, self.q))
        q = self.q[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        order = order[place < self.k]
        self.q, self.ids, self.scores = self.q[order], self.ids[order], self.scores[order]
        full = q[place == self.k - 1]
        self.floor[full] = np.round(self.scores[np.searchsorted(self.q, full, side="right") - 1], 9)

    def batch(self, query_ids: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [query_ids.take(pa.array(self.q)), pa.array(self.ids), pa.array(self.scores)],
            names=["query_id", "chunk_id", "score"],
        )


#: Groups of tasks whose local lists are merged before the final cut.
MERGE_GROUPS = 64


def passes(rows: DataFrame, count: int, row_bytes: int) -> Iterator[pa.Table]:
    """The rows as Arrow tables of bounded size, one at a time, all rows of a query in one table."""
    ship_package(rows.sparkSession)
    n = max(1, -(-count * row_bytes // BROADCAST_LIMIT))
    if n == 1:
        yield rows.toArrow()
        return
    stored = materialize(rows, "passes")
    number = F.pmod(F.xxhash64("query_id"), F.lit(n))
    for i in range(n):
        yield stored.filter(number == i).toArrow()


def query_passes(spark: SparkSession, tables: Iterable[pa.Table], run: Callable[[pa.Table], DataFrame],
                 schema: str, k: int) -> DataFrame:
    """Local results of all passes, ranked and cut to ``k`` per query.

    The lists of a query are cut within groups of scan tasks first, so the task
    that makes its final list reads at most MERGE_GROUPS × k rows. With several
    passes each is written before the next one's questions are fetched.
    """
    parts: list[DataFrame] = []
    held: pa.Table | None = None
    for table in tables:
        if not table.num_rows:
            continue
        if held is not None:
            parts.append(materialize(run(held), "pass"))
        held = table
    if held is not None:
        parts.append(materialize(run(held), "pass") if parts else run(held))
    found = parts[0] if parts else spark.createDataFrame([], schema)
    for p in parts[1:]:
        found = found.unionByName(p)
    order = [F.round("score", 9).desc(), "chunk_id"]
    group = F.spark_partition_id() % MERGE_GROUPS
    near = found.withColumn("_group", group).withColumn(
        "rank", F.row_number().over(Window.partitionBy("query_id", "_group").orderBy(*order))).filter(F.col("rank") <= k)
    w = Window.partitionBy("query_id").orderBy(*order)
    return near.drop("_group").withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
