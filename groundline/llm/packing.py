"""Sequence packing along a space-filling curve.

Each document's token counts are hashed to a few dimensions, the point's Hilbert
index orders the documents, and the ordered token stream is cut every
``SEQUENCE`` tokens. Neighbours on the curve have similar tokens, so sequences
mix related documents, and only the last sequence is padded.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from groundline.llm.base import Scratch, flat, mix, slices
from groundline.llm.secrets import vocabulary

SEQUENCE = 2048
END_ID = 1
DIMENSIONS, BITS = 4, 10
#: Characters beyond these are not read alike by both tokenizer libraries for certain.
OTHER_SCRIPT = re.compile("[^\x00-\u024f]")

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "curve_key long")


@lru_cache(maxsize=4)
def tokenizer(path: str | None):
    import public_tokenizers
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))


@lru_cache(maxsize=4)
def added_tokens(path: str | None) -> tuple[str, ...]:
    """Contents that the tokenizer reads as one id each and the rank file does not know."""
    return tuple(t.content for t in tokenizer(path).get_added_tokens_decoder().values())


def token_ids(texts: list[str], path: str | None = None, ranks_path: str | None = None,
              end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in order, each text closed by ``end_id``, and the number per text.

    Latin text goes through the rank file of the same vocabulary, which gives
    the same ids several times faster; any other script, and texts with the
    content of an added token, through the tokenizer itself.
    """
    quick, end, added = vocabulary(ranks_path), np.array([end_id], np.uint32), added_tokens(path)
    parts = []
    for text in texts:
        if text and (OTHER_SCRIPT.search(text) or any(t in text for t in added)):
            parts.append(np.array(tokenizer(path).encode(text, add_special_tokens=False).ids, np.uint32))
        elif text:
            parts.append(quick.encode_to_numpy(text, disallowed_special=()))
        else:
            parts.append(end[:0])
        parts.append(end)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)).reshape(-1, 2).sum(1)
    return (np.concatenate(parts) if parts else end[:0]), sizes


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer points (rows), after Skilling's transpose method."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(dims):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(up, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where(x[-1] & q, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros(points.shape[0], np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def curve_points(ids: np.ndarray, sizes: np.ndarray, dims: int = DIMENSIONS, bits: int = BITS) -> np.ndarray:
    """Signed random projections of hashed token counts, squashed to ``bits`` bits each."""
    signs = mix(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    starts = np.cumsum(sizes) - sizes
    scale = np.sqrt(sizes.astype(float)) * 4
    out = np.empty((len(sizes), dims), np.int64)
    for d in range(dims):
        sign = ((signs >> np.uint64(d)) & np.uint64(1)).astype(np.int64) * 2 - 1
        total = np.add.reduceat(sign, starts) if len(sizes) else np.zeros(0)
        out[:, d] = np.clip((np.tanh(total / scale) + 1) / 2 * (1 << bits), 0, (1 << bits) - 1)
    return out


def pack(docs: DataFrame, sequence: int = SEQUENCE, path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """Pieces of all documents in sequences of ``sequence`` tokens.

    Every id of every document (null text: only the end id) lies in one piece;
    each sequence but the last is full. Order: Hilbert key, then doc_id, then
    input row, so ties and repeated rows are placed one after the other. An
    empty table gives no rows; other columns are ignored. Documents of any
    length are cut at sequence borders. ``path`` and ``ranks_path`` are the
    vocabulary as tokenizer and as rank file (default: byte_bpe_50k).

    Ids are written once; only (key, doc_id, count) is range-sorted, running
    totals are taken per range, and starts return to the ids by row number.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ids, sizes = token_ids(pc.fill_null(flat(part.column("text")), "").to_pylist(), path, ranks_path)
                keys = hilbert_key(curve_points(ids, sizes))
                blob, ends = ids.astype("<u4"), np.cumsum(sizes)
                narrow = blob.astype("<u2") if len(ids) and ids.max() < 1 << 16 else blob
                packed = [narrow[e - s:e].tobytes() for e, s in zip(ends, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [flat(part.column("row")), flat(part.column("doc_id")), pa.array(keys), pa.array(sizes),
                     pa.array(packed, pa.binary())], names=["row", "doc_id", "curve_key", "n", "ids"])

    tokens = scratch.write(
        docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                    F.col("text").cast("string").alias("text"))
        .mapInArrow(encode, "row long, doc_id long, curve_key long, n long, ids binary"), "tokens")

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            ends = total + np.cumsum(n)
            total = int(ends[-1]) if len(n) else total
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("range"), pa.array(ends - n), batch.column("n")],
                                             names=["row", "range", "before", "n"])

    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = scratch.write(
        tokens.select("row", "doc_id", "curve_key", "n").repartitionByRange(ranges, "curve_key", "doc_id", "row")
        .sortWithinPartitions("curve_key", "doc_id", "row").withColumn("range", F.spark_partition_id())
        .mapInArrow(running, "row long, range int, before long, n long"), "ordered")
    # one row per range, at most ``ranges`` of them
    totals = ordered.groupBy("range").agg(F.max(F.col("before") + F.col("n")).alias("total"))
    offsets = totals.select("range", (F.sum("total").over(Window.orderBy("range")) - F.col("total")).alias("range_start"))
    starts = ordered.join(F.broadcast(offsets), "range").select("row", (F.col("range_start") + F.col("before")).alias("at"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "ids")):
            rows = []
            for doc, key, n, at, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "curve_key", "n", "at", "ids")), strict=True):
                values = np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4")
                start = 0
                while start < n:
                    length = min(n - start, sequence - (at + start) % sequence)
                    rows.append((doc, start, length, zlib.crc32(values[start:start + length].tobytes()), n,
                                 (at + start) // sequence, (at + start) % sequence, key))
                    start += length
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)],
                                                 names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "curve_key"])

    # both sides have a row for each document, so they always meet by a shuffle
    return tokens.join(starts.hint("merge"), "row").select("doc_id", "curve_key", "n", "at", "ids").mapInArrow(cut, PIECES)
