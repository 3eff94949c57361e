"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Largest side this library broadcasts, in bytes of its estimated rows.
BROADCAST_LIMIT = 64 * 1024 * 1024


def get_session(app: str = "groundline", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings the operators count on; a cluster's own settings win."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if master and master.startswith("local"):
        # small local files would otherwise share one task
        builder = (builder.config("spark.sql.files.openCostInBytes", "131072")
                   .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def is_local(spark: SparkSession) -> bool:
    return re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master) is not None


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a local master without that setting gets a folder of its own; on a
    cluster a machine-local folder would lose data with its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="groundline-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a table is read several times by one plan. The written files
    survive lost executors and later reads prune columns.
    """
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Broadcast hint only when ``rows * row_bytes`` is under the limit."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_LIMIT else df


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan dealt out to all cores of a local session, where a small file is a single row group.

    On a cluster the scan stays as it is.
    """
    spark = df.sparkSession
    return df.repartition(spark.sparkContext.defaultParallelism) if is_local(spark) else df


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        base = os.path.join(tempfile.mkdtemp(prefix="groundline-py-"), "groundline")
        spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", root, "groundline"))
        _SHIPPED.add(app)
