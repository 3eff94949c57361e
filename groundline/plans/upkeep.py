"""Changes of the registry, chunk and vector tables that are published together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from groundline.operators import tables
from groundline.session import materialize
from groundline.sources.versions import VersionedTables


def delete_documents(store: VersionedTables, wanted: DataFrame) -> DataFrame:
    """Delete the documents ``wanted`` (document_id) from all three tables, or from none.

    (document_id, source, removed_chunks) of every document that was there. An
    error in any step leaves the version before, which is what readers see until
    the last step.
    """
    base = store.newest()
    now = store.read(base)
    following = tables.delete_documents(now["registry"], now["chunks"], now["vectors"], wanted)
    removed = materialize(following.pop("removed"), "removed")
    store.commit(following, base)
    return removed


def content_digest() -> F.Column:
    return F.sha2(F.coalesce("content", F.lit("")), 256)


def rebuild_index(store: VersionedTables, embed: Callable[[DataFrame], DataFrame], parts: int = 16) -> int:
    """Make ``vectors`` hold one vector for exactly the rows of ``chunks`` with a chunk_id; the number of vectors.

    Vectors whose chunk is there with the same content (content_sha) are kept,
    others dropped. ``embed`` gets the remaining chunks (chunk_id, source,
    source_index, content_sha, content), a part at a time, and returns their rows
    with ``embedding``. chunk_ids are unique; a null content counts as empty.

    The work list and finished parts are kept below ``progress/<version>``: after
    a failure the next call goes on with the first part that is not finished.
    An answer that lacks a vector or a row is an error and that part is not
    finished. If another version is published meanwhile, the commit fails and the
    next call compares with that one.

    Only ids and digests are compared and, when few chunks are left to do, their
    list is broadcast by its stored size; texts move only for those chunks.
    """
    spark, base = store.spark, store.newest()
    now, home = store.read(base), f"progress/{base:09d}"
    chunks = now["chunks"].where("chunk_id is not null").withColumn("content_sha", content_digest())
    key, carried = ["chunk_id", "content_sha"], ["chunk_id", "source", "source_index", "content_sha"]

    def written(rows: DataFrame, name: str, by: str | None = None) -> DataFrame:
        path = f"{store.root}/{home}/{name}"
        if not store.exists(f"{home}/{name}.done"):
            writer = rows.write.mode("overwrite")
            (writer.partitionBy(by) if by else writer).parquet(path)
            store.create(f"{home}/{name}.done")
        return spark.read.schema(rows.schema).parquet(path)

    part = F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int").alias("part")
    listed = written(chunks.select(*key).join(now["vectors"].select(*key), key, "left_anti").select("chunk_id", part), "todo")
    # a part's texts lie in one folder, written by as many tasks as there are for a part
    share = F.pmod(F.xxhash64(F.lit(1), "chunk_id"), F.lit(max(1, spark.sparkContext.defaultParallelism // parts)))
    todo = written(chunks.select(*carried, "content").join(listed, "chunk_id").repartition("part", share), "texts", "part")
    answers = []
    for number in range(parts):
        mine = todo.where(F.col("part") == number).drop("part")
        name = f"part-{number:05d}"
        if not store.exists(f"{home}/{name}.checked"):
            got = written(embed(mine).select(*carried, F.col("embedding").cast("array<float>").alias("embedding")), name)
            asked, (answered, ids) = mine.count(), got.agg(F.count_if(F.size("embedding") > 0), F.countDistinct("chunk_id")).first()
            if not asked == answered == ids:
                store.delete(f"{home}/{name}.done")
                raise ValueError(f"part {number}: {answered} vectors for {asked} chunks")
            store.create(f"{home}/{name}.checked")
        answers.append(f"{store.root}/{home}/{name}")
    kept = now["vectors"].join(chunks.select(*key), key, "left_semi").select(*carried, F.col("embedding").cast("array<float>").alias("embedding"))
    vectors = kept.unionByName(spark.read.schema(kept.schema).parquet(*answers))
    number = store.commit({"vectors": vectors}, base)
    store.delete(home)
    return store.read(number)["vectors"].count()
