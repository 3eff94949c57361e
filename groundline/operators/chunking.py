"""Documents to chunks: sliding windows and heading-aware packing."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from groundline import config as C
from groundline.functions import text as T
from groundline.operators.ordering import running_offset
from groundline.session import BROADCAST_LIMIT, materialize, ship_package


#: Bytes of a (source, doc_id, offset) row in a broadcast, source names of up to some hundred characters included.
OFFSET_BYTES = 256


def windows(content: Column, size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP) -> Column:
    """Array of overlapping character windows over white-space-normalized text.

    ``content`` must already be normalized (see ``text.collapse``).
    """
    step = max(1, size - overlap)
    last = F.floor((F.length(content) - 1) / step).cast("int")
    return F.when(
        F.length(content) > 0,
        F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(content, i * step + 1, F.lit(size))),
    ).otherwise(T.strings([]))


def _collapsed(texts: pa.Array) -> list[str]:
    """``text.collapse`` row by row: ``str.split`` parts at the characters of ``text.WS_CHARS``, no others."""
    return [" ".join((t or "").split()) for t in texts.to_pylist()]


def _lengths(texts: pa.Array) -> pa.Array:
    return pa.array([len(t) for t in _collapsed(texts)], pa.int64())


def collapsed_length(text: str) -> Column:
    """Length of the normalized text, 0 when it is missing."""
    return F.arrow_udf(_lengths, LongType())(text)


def collapsed_windows(text: str, size: int, overlap: int) -> Column:
    """``windows`` over the normalized text, given the text as it is."""
    step = max(1, size - overlap)

    def cut(texts: pa.Array) -> pa.Array:
        return pa.array([[t[i:i + size] for i in range(0, len(t), step)] for t in _collapsed(texts)], pa.list_(pa.string()))

    return F.arrow_udf(cut, ArrayType(StringType()))(text)


def window_count(length: Column, size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP) -> Column:
    """Number of windows over normalized text of this length."""
    step = max(1, size - overlap)
    return F.when(length > 0, F.floor((length - 1) / step) + 1).otherwise(F.lit(0))


def window_chunks(docs: DataFrame, size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP,
                  bucket_docs: int = 4096) -> DataFrame:
    """Chunk (doc_id, source, text, …) rows; ``source_index`` counts chunks within a source.

    (source, doc_id) names a row. The number of windows follows from the length,
    so lengths are written first, in one scan of the texts, and offsets are summed
    over that table, bucket by bucket in a large source. They come back to the
    texts by a broadcast while that table is small; beyond that each text moves
    once, unsorted. Buckets are equal ranges of the ids there are, about
    ``bucket_docs`` documents each for dense and hashed ids.
    """
    ship_package(docs.sparkSession)
    lengths = materialize(docs.select("source", "doc_id", collapsed_length("text").alias("_length")), "lengths")
    low, high, n = lengths.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    width = max(1.0, (high - low + 1) * bucket_docs / n) if n else 1.0
    bucket = F.floor((F.col("doc_id").cast("double") - float(low or 0)) / width)
    narrow = lengths.filter("_length > 0").select("source", "doc_id", window_count(F.col("_length"), size, overlap).alias("_n"))
    offsets = running_offset(narrow, ["source"], bucket, ["doc_id"], F.col("_n"), "_offset").select("source", "doc_id", "_offset")
    small = n * OFFSET_BYTES <= BROADCAST_LIMIT
    # the hash table of a partition holds offsets, so the texts need no sort
    placed = docs.join(offsets.hint("broadcast" if small else "shuffle_hash"), ["source", "doc_id"])
    keep = [c for c in docs.columns if c != "text"]
    return placed.select(
        *keep, "_offset", F.posexplode(collapsed_windows("text", size, overlap)).alias("part", "content")
    ).withColumn("source_index", F.col("_offset") + F.col("part")).drop("_offset")


# ---- heading-aware chunks --------------------------------------------------------

_SECTION, _TITLE_END = "\x1d", "\x1e"  # line breaks themselves, so absent after normalization


def sections(document: Column) -> Column:
    """array<struct<section, body>>: text between ATX headings, blank bodies dropped."""
    unix = F.regexp_replace(document, T.LINE_BREAK, "\n")
    marked = F.regexp_replace(
        unix,
        rf"(?dm)^#{{1,6}}{T.INLINE_WS}+([^\n]+?){T.INLINE_WS}*$",
        f"{_SECTION}$1{_TITLE_END}",
    )
    pieces = F.split(F.concat(F.lit(f"Document{_TITLE_END}"), marked), _SECTION)
    parsed = F.transform(
        pieces,
        lambda p: F.struct(
            T.strip(F.substring_index(p, _TITLE_END, 1)).alias("section"),
            T.strip(F.substring_index(p, _TITLE_END, -1)).alias("body"),
        ),
    )
    return F.filter(parsed, lambda s: s["body"] != "")


def cut_oversized(text: Column, limit: Column) -> Column:
    """Pieces of at most ``limit`` characters, cut at the last blank past half of it."""
    whole = F.format_string("(?s)%s*+(.{1,%d}\\z|.{%d,%d}(?= )|.{%d})", F.lit(T.WS), limit,
                            F.greatest(F.floor(limit / 2), F.lit(1)).cast("int"),
                            F.greatest(limit - 1, F.lit(1)), limit)
    pieces = F.transform(F.regexp_extract_all(text, whole, F.lit(1)), lambda p: T.strip(p))
    return F.filter(pieces, lambda p: p != "")


def _pack(units: Column, limit: Column, glue: str) -> Column:
    """Greedy join of consecutive units with ``glue`` while the result fits ``limit``.

    Units are structs (text, sealed); a sealed unit stands alone.
    """
    state = F.struct(T.strings([]).alias("done"), F.lit("").alias("open"))

    def flush(s):
        return F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"])))

    def step(s, u):
        joined = F.concat(s["open"], F.lit(glue), u["text"])
        return (
            F.when(u["sealed"], F.struct(F.concat(flush(s), F.array(u["text"])).alias("done"), F.lit("").alias("open")))
            .when(s["open"] == "", F.struct(s["done"].alias("done"), u["text"].alias("open")))
            .when(F.length(joined) > limit, F.struct(flush(s).alias("done"), u["text"].alias("open")))
            .otherwise(F.struct(s["done"].alias("done"), joined.alias("open")))
        )

    return F.aggregate(units, state, step, flush)


def _unit(text: Column, sealed: Column) -> Column:
    return F.struct(text.alias("text"), sealed.alias("sealed"))


def section_chunks(docs: DataFrame, text: str, size: int = C.CHUNK_SIZE) -> DataFrame:
    """Explode documents into (section, part, content) with ``## section`` prefixes.

    Every step stays inside the document's row until the final explode, so
    nothing shuffles. Paragraphs that fit are units; longer ones become runs of
    sentences, and sentences longer than the limit are cut.
    """
    keep = [c for c in docs.columns if c != text]
    per_section = docs.select(*keep, F.posexplode(sections(F.col(text))).alias("section_no", "_s")).select(
        *keep, "section_no", "_s.section", "_s.body",
        F.greatest(F.lit(1), F.lit(size) - F.length(F.concat(F.lit("## "), F.col("_s.section"), F.lit("\n\n"))))
        .cast("int").alias("_limit"),
    )
    limit = F.col("_limit")
    paragraphs = F.filter(
        F.transform(F.split("body", rf"\n{T.WS}*\n"), lambda p: T.strip(p)), lambda p: p != ""
    )

    def sentence_units(paragraph):
        parts = F.filter(
            F.transform(F.split(paragraph, rf"(?<=[.!?。！？]){T.WS}+"), lambda s: T.strip(s)), lambda s: s != ""
        )
        return F.flatten(F.transform(
            parts,
            lambda s: F.when(F.length(s) <= limit, F.array(_unit(s, F.lit(False))))
            .otherwise(F.transform(cut_oversized(s, limit), lambda p: _unit(p, F.lit(True)))),
        ))

    def paragraph_units(paragraph):
        return F.when(F.length(paragraph) <= limit, F.array(paragraph)).otherwise(
            _pack(sentence_units(paragraph), limit, " "))

    units = F.flatten(F.transform(paragraphs, paragraph_units))
    packed = _pack(F.transform("_units", lambda u: _unit(u, F.lit(False))), limit, "\n\n")
    return (
        per_section.withColumn("_units", units)
        .select(*keep, "section_no", "section", F.posexplode(packed).alias("part", "_body"))
        .withColumn("content", F.concat(F.lit("## "), "section", F.lit("\n\n"), "_body"))
        .drop("_body")
    )
