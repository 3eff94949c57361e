"""Incremental ingestion of uploads with content de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from groundline.operators.tables import upload_batch

REGISTRY = "document_id string, sha string"


def ingest_stream(uploads: DataFrame, registry_path: str, outcome_path: str, checkpoint: str) -> StreamingQuery:
    """Register new uploads of a file stream; run with availableNow, so it ends when the input does.

    Each micro-batch writes its own folder (``batch=N``), overwritten when a batch
    is retried after a failure, so outcomes and registry entries stay exactly once.
    """
    spark = uploads.sparkSession

    def handle(batch: DataFrame, number: int) -> None:
        known = spark.createDataFrame([], REGISTRY)
        try:
            known = spark.read.schema(REGISTRY + ", batch long").parquet(registry_path).filter(f"batch < {number}").drop("batch")
        except Exception as missing:  # the first batch finds no registry yet
            if "PATH_NOT_FOUND" not in str(missing):
                raise
        done = upload_batch(batch, known).persist()
        done.write.mode("overwrite").parquet(f"{outcome_path}/batch={number}")
        done.filter("status IN ('completed', 'failed')").select("document_id", "sha").write.mode("overwrite").parquet(f"{registry_path}/batch={number}")
        done.unpersist()

    return uploads.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
