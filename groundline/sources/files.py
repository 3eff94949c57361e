"""Files in, tables out."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from groundline import config as C
from groundline.functions import rules
from groundline.functions import text as T
from groundline.operators.chunking import section_chunks


#: Scheme and host in front of an absolute path.
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*"


def relative_path(path: Column, root: str) -> Column:
    """Path below ``root``, which is cut once at the front; a root without scheme may be relative."""
    base = re.sub(SCHEME, "/", root) if re.match(SCHEME, root) else os.path.abspath(root)
    base = base.rstrip("/") + "/"
    clean = F.regexp_replace(path, SCHEME, "/")
    return F.when(F.startswith(clean, F.lit(base)), F.substring(clean, F.lit(len(base) + 1), F.length(clean))).otherwise(clean)


def source_tree(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """(file_path, suffix, status, content) of every file under ``root``.

    ``status`` is kept, or why the file is skipped. The size rule (None: no
    limit, the default) is applied to the listing, so oversized files are never read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = relative_path(F.col("path"), root)
    fits = F.lit(True) if max_bytes is None else F.col("length") <= max_bytes
    listing = files.select(path.alias("file_path"), "length")
    small = files.filter(fits).select(path.alias("file_path"), "length", "content")
    suffix = rules.file_suffix(F.col("file_path"))
    readable = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    kept = small.withColumns({"suffix": suffix, "text": readable}).withColumn(
        "status", F.when(rules.skipped_path(F.col("file_path")), F.lit("skipped_path"))
        .when(~F.col("suffix").isin(*C.DOC_SUFFIXES, ".py"), F.lit("skipped_suffix"))
        .when(F.col("text").isNull(), F.lit("skipped_encoding"))
        .when(T.strip("text") == "", F.lit("skipped_blank")).otherwise(F.lit("kept")))
    large = listing.filter(~fits).select(
        "file_path", suffix.alias("suffix"), F.lit("skipped_size").alias("status"), F.lit(None).cast("string").alias("content"))
    return kept.select("file_path", "suffix", "status", F.when(F.col("status") == "kept", F.col("text")).alias("content")).unionByName(large)


def documentation_chunks(tree: DataFrame) -> DataFrame:
    """Section chunks of the kept documentation files of a source tree: (file_path, section_no, part, symbol, content, content_type)."""
    kept = tree.filter("status = 'kept'").filter(F.col("suffix").isin(*C.DOC_SUFFIXES))
    return section_chunks(kept.select("file_path", F.col("content").alias("text")), "text").select(
        "file_path", F.col("section_no").cast("long").alias("section_no"), F.col("part").cast("long").alias("part"),
        F.coalesce(T.coalesce_text(T.first_line_section("content")), F.lit("Document")).alias("symbol"), "content",
        F.lit("documentation").alias("content_type"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, text) of plain files; bytes that are not UTF-8 are dropped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    clean = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "�", "")
    return files.select(F.col("path").alias("file_path"), clean.alias("text"))


def replace_table(df: DataFrame, path: str) -> None:
    """Write the next version of a table beside its readers: always a new folder."""
    df.write.mode("errorifexists").parquet(path)


def overwrite_sources(chunks: DataFrame, path: str) -> None:
    """Replace exactly the source partitions ``chunks`` holds."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)


def write_snapshot(df: DataFrame, root: str, stamp: str) -> str:
    """Copy of a table under ``root``/``stamp`` (yyyyMMdd-HHmmss-SSSSSS)."""
    target = f"{root.rstrip('/')}/{stamp}"
    df.write.mode("errorifexists").parquet(target)
    return target


def prune_snapshots(spark: SparkSession, root: str, keep: int, pinned: tuple[str, ...] = ()) -> list[str]:
    """Remove all but the ``keep`` (at least one) newest complete snapshots below ``root``; stamps of those removed.

    Pinned stamps stay and are not counted. A snapshot that was not written to
    its end has no mark; it stays and is not counted, as its writer may be at work.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(root)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(folder):
        raise FileNotFoundError(root)
    names = sorted(s.getPath().getName() for s in store.listStatus(folder) if s.isDirectory())
    stamps = [n for n in names if re.fullmatch(r"\d{8}-\d{6}-\d{6}", n) and n not in pinned
              and store.exists(hadoop.Path(f"{root}/{n}/_SUCCESS"))]
    gone = stamps[:-max(keep, 1)]
    for name in gone:
        store.delete(hadoop.Path(f"{root}/{name}"), True)
    return gone
