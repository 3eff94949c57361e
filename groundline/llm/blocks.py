"""Blocks of documents that ask buckets of keys.

A block is a group of documents with a bounded number of text bytes. Tasks of
blocks turn texts into sorted distinct keys, send them in packed arrays to the
buckets of the key space, and get one packed answer per array back, in the same
order. A key comes at most once from each block, so a frequent key is no hot
key, and no row per token is ever shuffled. Blocks recompute their keys instead
of storing them: the same documents always give the same arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Text bytes in a block, and text bytes of the whole table for each bucket.
BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 4 << 20
ASKED = "block int, bucket int, keys binary, extra binary"
ANSWERED = "block int, bucket int, answer binary"


def blocked(docs: DataFrame, blocks: int, kind: Column | None = None, kinds: int = 1) -> DataFrame:
    """(block, doc_id, text): block * kinds + kind, by a hash of doc_id and text."""
    at = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int") * kinds + (kind if kind is not None else F.lit(0))
    return docs.select(at.cast("int").alias("block"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def bucket_cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range begins in sorted 64-bit keys (and where the last ends)."""
    limits = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, limits), [len(keys)]])


def request(block: int, keys: np.ndarray, extras: list[np.ndarray], buckets: int) -> pa.Table:
    """One row for each bucket that the block's sorted keys fall into; extras are parallel arrays."""
    cuts = bucket_cuts(keys, buckets)
    used = np.flatnonzero(cuts[1:] > cuts[:-1])
    ranges = [(int(cuts[i]), int(cuts[i + 1])) for i in used]
    return pa.table({
        "block": pa.array(np.full(len(used), block, np.int32)), "bucket": pa.array(used.astype(np.int32)),
        "keys": pa.array([keys[a:b].tobytes() for a, b in ranges], pa.binary()),
        "extra": pa.array([b"".join(e[a:b].tobytes() for e in extras) for a, b in ranges], pa.binary())})


def answer_all(requests: DataFrame, answer: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """``answer`` once for each bucket; buckets are dealt over all shuffle partitions, which are not merged again."""
    tasks = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return requests.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(answer, ANSWERED)


def in_order(answers: pa.Table, kind: np.dtype) -> np.ndarray:
    """A block's answers in the order of its keys."""
    rows = sorted(zip(answers.column("bucket").to_pylist(), answers.column("answer").to_pylist(), strict=True))
    return np.concatenate([np.frombuffer(a, kind) for _, a in rows]) if rows else np.zeros(0, kind)


def with_answers(source: DataFrame, answers: DataFrame, use: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``use`` once for each block, with its documents and its answers."""
    return source.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(use, schema)


def unpacked(table: pa.Table) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """(block, keys, extra bytes) of each request of a bucket."""
    for block, keys, extra in zip(*(table.column(c).to_pylist() for c in ("block", "keys", "extra")), strict=True):
        yield block, np.frombuffer(keys, np.uint64), extra
