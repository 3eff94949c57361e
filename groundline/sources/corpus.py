"""Corpus manifests and their content files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from groundline.functions import rules
from groundline.functions import text as T
from groundline.operators.chunking import section_chunks, windows

MANIFEST = (
    "source_id string, title string, source_type string, source_url string, retrieved_at date, original_format string, "
    "conversion_method string, verified boolean, repository_url string, branch string, commit string, tag string, raw_file string, "
    "processed_file string, normalized_file string, normalization_method string, normalized_from string, "
    "references_excluded_from_retrieval boolean, "
    "repository_files array<struct<file_path:string,raw_file:string,content_type:string,language:string,repository_url:string,commit:string,source_url:string>>"
)


def _require_none(bad: DataFrame, message: str) -> None:
    rows = bad.limit(5).collect()
    if rows:
        raise FileNotFoundError(f"{message}: {[r[0] for r in rows]}")


def manifests(spark: SparkSession, root: str, project_root: str) -> DataFrame:
    """Manifest rows with ``source`` and ``content_path``; missing content files are an error."""
    rows = spark.read.schema(MANIFEST).option("multiLine", "true").json(f"{root}/*/source.json").withColumn("_at", F.input_file_name())
    folder = F.regexp_replace(F.regexp_replace("_at", r"/source\.json$", ""), "^file:/+", "/")
    typed = rows.withColumns({
        "source": F.concat(F.lit("research:"), "source_id"),
        "content_path": F.when(F.coalesce("normalized_file", F.lit("")) != "", F.concat(F.lit(project_root + "/"), "normalized_file"))
        .otherwise(F.concat(folder, F.lit("/"), F.coalesce("processed_file", F.lit("content.md"))))}).drop("_at")
    bad = typed.filter(~rules.manifest_id_valid(F.col("source_id")) | F.col("title").isNull())
    if bad.limit(1).count():
        raise ValueError("manifest with an invalid source_id or title")
    present = _files(spark, project_root).select(F.col("path").alias("content_path"))
    _require_none(typed.select("content_path").join(present, "content_path", "left_anti"), "missing corpus files")
    return typed


def _files(spark: SparkSession, root: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return found.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))


def bootstrap(spark: SparkSession, root: str, project_root: str) -> DataFrame:
    """(source, file_path, section_no, part, symbol, content) of every manifest's documents.

    Normalized documents are cut by headings, others by windows; an empty content
    file is an error.
    """
    sources = manifests(spark, root, project_root)
    content = _files(spark, project_root).select(F.col("path").alias("content_path"), F.col("content").cast("string").alias("text"))
    docs = sources.select("source", "title", "source_type", "normalized_file", "content_path").join(content, "content_path")
    if docs.filter(T.strip("text") == "").limit(1).count():
        raise ValueError("empty processed corpus")
    name = F.when(F.col("source_type") == "repository", F.lit("README.md")).otherwise(F.col("normalized_file"))
    normal = docs.filter("normalized_file IS NOT NULL").withColumn("file_path", name).select("source", "title", "file_path", "text")
    by_heading = section_chunks(normal, "text").select(
        "source", "title", "file_path", F.col("section_no").cast("long").alias("section_no"), F.col("part").cast("long").alias("part"),
        T.first_line_section("content").alias("symbol"), "content")
    plain = docs.filter("normalized_file IS NULL").withColumn("text", T.collapse("text")).select(
        "source", "title", F.lit(None).cast("string").alias("file_path"), F.lit(0).cast("long").alias("section_no"),
        F.posexplode(windows(F.col("text"))).alias("part", "content"))
    return by_heading.unionByName(plain.select(
        "source", "title", "file_path", "section_no", F.col("part").cast("long").alias("part"), F.lit(None).cast("string").alias("symbol"), "content"))
