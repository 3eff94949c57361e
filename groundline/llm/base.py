"""Shared helpers: stored intermediates, bounded slices of Arrow batches, word arrays."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from groundline.session import shared_folder, ship_package

#: Bytes of text that one vectorised step works on inside a task.
SLICE_BYTES = 1 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


@contextmanager
def shuffle_cleanup(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when their execution ends, not when the driver collects garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


class Scratch:
    """Tables of one operator run in the folder that all executors share.

    Written tables cut the lineage and survive lost executors. ``drop`` removes
    a table that later steps no longer read; what the returned (lazy) result
    reads has to stay until the caller has used it.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        ship_package(spark)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        with shuffle_cleanup(self.spark):
            df.write.option("compression", "zstd").mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batch: pa.RecordBatch | pa.Table, column: str, limit: int = SLICE_BYTES) -> Iterator:
    """Consecutive row ranges of a batch with about ``limit`` bytes of ``column`` each."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(size.to_numpy(zero_copy_only=False) if isinstance(size, pa.Array) else size.to_numpy())
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def flat(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):  # no rows
            column = pa.array([], type=column.type)
    return column


def words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts in order, and their number per text."""
    texts = pc.fill_null(flat(texts), "")
    parts = flat(pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts))
    found = parts.flatten()
    counts = np.diff(parts.offsets.to_numpy()).astype(np.int64)
    full = pc.greater(pc.binary_length(found), 0)
    keep = full.to_numpy(zero_copy_only=False)
    if len(keep) and not keep.all():
        before = np.concatenate([[0], np.cumsum(keep)])
        ends = np.cumsum(counts)
        counts = before[ends] - before[ends - counts]
        found = found.filter(full)
    return found, counts


def word_hashes(found: pa.Array) -> np.ndarray:
    """64-bit hash of each word's bytes (each distinct word is hashed once)."""
    coded = pc.dictionary_encode(found)
    distinct = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()),
                           np.uint64, len(coded.dictionary))
    return distinct[coded.indices.to_numpy(zero_copy_only=False)] if len(found) else np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of several ranges, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return np.arange(total, dtype=np.int64) + shift


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of text in a table; sizes blocks, so that tasks stay equally large at any scale."""
    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)
