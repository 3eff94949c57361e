"""Server-sent event text, translation caches and checkpoints as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

TRANSLATION = (
    "logical_chunk_id string, source_id string, source_index long, section string, content_hash string, content_en string, content_zh string, "
    "canonical_language string, translation_status string, translation_method string, translation_provider string, "
    "translation_model string, translation_verified boolean, error string"
)


# ---- event text -----------------------------------------------------------------------------

def sse_events(texts: DataFrame, text: str = "value") -> DataFrame:
    """Blocks of event text: (…, block_no, event, id, data, error).

    Line ends are unified, comments skipped, several data lines joined; a block
    without data or with invalid JSON carries an ``error``.
    """
    keep = [c for c in texts.columns if c != text]
    unix = F.regexp_replace(F.col(text), r"\r\n?", "\n")
    blocks = texts.select(*keep, F.posexplode(F.split(unix, "\n\n")).alias("block_no", "_b"))
    blocks = blocks.filter(F.trim(F.regexp_replace("_b", r"\s+", "")) != "")
    fields = F.transform(
        F.filter(F.split("_b", "\n"), lambda x: (x != "") & ~F.startswith(x, F.lit(":"))),
        lambda x: F.struct(F.substring_index(x, ":", 1).alias("k"),
                           F.regexp_replace(F.when(F.contains(x, F.lit(":")), F.regexp_replace(x, r"^[^:]*:", "")).otherwise(F.lit("")), "^ ", "").alias("v")))

    def values(name: str) -> Column:
        return F.transform(F.filter("_f", lambda f: f["k"] == name), lambda f: f["v"])

    rows = blocks.withColumn("_f", fields).select(
        *keep, "block_no", F.coalesce(F.try_element_at(values("event"), F.lit(-1)), F.lit("message")).alias("event"),
        F.try_element_at(values("id"), F.lit(-1)).alias("id"), F.size(values("data")).alias("_n"), F.array_join(values("data"), "\n").alias("data"))
    return rows.withColumn("error", F.when(F.col("_n") == 0, F.lit("invalid_sse"))
                           .when(F.try_parse_json("data").isNull(), F.lit("invalid_sse_json"))).drop("_n")


def read_sse(spark: SparkSession, path: str) -> DataFrame:
    """Event blocks of whole log files."""
    return sse_events(spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name()))


def read_sse_log(spark: SparkSession, path: str) -> DataFrame:
    """Event blocks of large LF-only logs, split by the reader itself."""
    return sse_events(spark.read.option("lineSep", "\n\n").text(path))


def write_sse(feed: DataFrame, path: str) -> None:
    """Event text files, one folder per run; files in name order are in sequence order.

    Ranges of (run, sequence) split a long run over several files.
    """
    body = F.regexp_replace("sse", r"\n\z", "")
    feed.repartitionByRange("run_id", "sequence").sortWithinPartitions("run_id", "sequence").select("run_id", body.alias("value")).write.partitionBy("run_id").text(path)


# ---- caches and checkpoints --------------------------------------------------------------------

def read_translations(spark: SparkSession, path: str) -> DataFrame:
    """Entries of cache files {"schema_version": 1, "chunks": [...]}."""
    raw = spark.read.schema(f"schema_version int, chunks array<struct<{_fields(TRANSLATION)}>>").option("multiLine", "true").json(path)
    return raw.select(F.inline("chunks"))


def write_translations(entries: DataFrame, path: str) -> None:
    """One cache document per source partition folder."""
    packed = entries.groupBy("source_id", F.floor(F.col("source_index") / 1000).alias("range_no")).agg(
        F.array_sort(F.collect_list(F.struct("source_index", *[c for c in entries.columns if c not in ("source_index",)]))).alias("chunks"))
    packed.select(F.lit(1).alias("schema_version"), "chunks").write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def _fields(ddl: str) -> str:
    return ", ".join(f"{part.split()[0]}:{part.split()[1]}" for part in ddl.split(", "))


def read_checkpoint(spark: SparkSession, path: str, payload: str = "map<string,string>") -> DataFrame:
    """(case_id, pos, payload) rows of checkpoint files {"results": [...]}."""
    raw = spark.read.schema(f"schema_version int, updated_at string, results array<{payload}>").option("multiLine", "true").json(path)
    rows = raw.select(F.posexplode("results").alias("pos", "payload"))
    return rows.select(F.col("payload")["case_id"].alias("case_id"), F.col("pos").cast("long").alias("pos"), "payload")


# A checkpoint log is a folder of numbered segments. Appending writes the next one, compaction writes
# the last row of every case as the next one and then removes what came before. Rows of a later segment
# win, so a reader sees the same cases before, during and after a compaction that stops half-way.

LOG_ROW = "pos long, case_id string, payload map<string,string>"


def _segments(spark: SparkSession, path: str) -> list[tuple[int, bool]]:
    """(number, complete) of the segments of a log, ascending; a segment without Spark's mark is not complete."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return []
    names = [s.getPath().getName() for s in store.listStatus(folder)]
    numbers = sorted(int(n.removeprefix("segment-")) for n in names if n.startswith("segment-"))
    mark = lambda n: spark._jvm.org.apache.hadoop.fs.Path(f"{_segment(path, n)}/_SUCCESS")
    return [(n, bool(store.exists(mark(n)))) for n in numbers]


def _segment(path: str, number: int) -> str:
    return f"{path.rstrip('/')}/segment-{number:09d}"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(segment, pos, case_id, payload) of the last row per case; no rows for a log that was never written."""
    found = [n for n, complete in _segments(spark, path) if complete]
    if not found:
        return spark.createDataFrame([], f"segment long, {LOG_ROW}")
    rows = spark.read.schema(LOG_ROW).json([_segment(path, n) for n in found])
    number = F.regexp_extract(F.col("_metadata.file_path"), r"segment-(\d+)/[^/]*$", 1).cast("long")
    last = F.max_by(F.struct("segment", "pos", "payload"), F.struct("segment", "pos"))
    return rows.select(number.alias("segment"), *rows.columns).where("coalesce(case_id, '') <> ''").groupBy("case_id").agg(
        last.alias("last")).select("last.segment", "last.pos", "case_id", "last.payload")


def _write_segment(results: DataFrame, path: str, number: int) -> int:
    results.select("pos", "case_id", "payload").write.mode("errorifexists").json(_segment(path, number))
    return number


def append_log(results: DataFrame, path: str) -> int:
    """Write ``results`` (pos, case_id, payload) as the next segment; its number. A log has one writer at a time."""
    return _write_segment(results, path, max((n for n, _ in _segments(results.sparkSession, path)), default=0) + 1)


def compact_log(spark: SparkSession, path: str) -> int:
    """Put the last row of every case into one new segment and remove the older ones; its number.

    The number follows the segments seen at the start: if another one was
    appended since, the write fails and nothing is removed. Unfinished segments
    are removed, too.
    """
    older = [n for n, _ in _segments(spark, path)]
    number = _write_segment(read_log(spark, path), path, max(older, default=0) + 1)
    hadoop = spark._jvm.org.apache.hadoop.fs
    for n in older:
        target = hadoop.Path(_segment(path, n))
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return number
