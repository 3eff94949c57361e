"""Streams driven to their end, compared with the batch operators."""

import datetime as dt
import time

from pyspark.sql import functions as F

from groundline.catalogue import events as EV
from groundline.catalogue import tables as TB
from groundline.operators import events as E
from groundline.streaming import feed as S
from groundline.streaming.ingest import ingest_stream


def stream(spark, rows, folder, files=3):
    """A file stream over ``rows`` in several files, one file per batch."""
    rows.repartition(1).write.parquet(f"{folder}/part0") if files == 1 else [
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in") for part in rows.randomSplit([1.0] * files, seed=1)]
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def finish(df, folder, name, mode):
    q = (df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{folder}/ck-{name}")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return df.sparkSession.table(name)


def sample(spark, data):
    return EV.run_events(spark, data).withColumn("ts", F.col("ts").cast("timestamp"))


def test_sequence_numbers(spark, data, tmp_path):
    public = E.public_events(sample(spark, data), EV.artifacts(spark, data))
    public.persist()
    got = finish(S.number_stream(stream(spark, public, str(tmp_path))), str(tmp_path), "numbers", "append")
    per = got.groupBy("run_id").agg(F.count("*").alias("n"), F.count_distinct("sequence").alias("d"), F.max("sequence").alias("m"))
    assert got.count() == public.count() and per.filter("n <> d OR n <> m").count() == 0
    # the numbered stream makes the same envelopes as a batch of it
    rows = E.envelope(got)
    assert rows.filter("event = 'retrieval.completed' AND get_json_object(envelope, '$.data.evidence_count') IS NULL").count() == 0
    told = E.envelope(public.join(got.select("run_id", "event_id", "sub", "sequence"), ["run_id", "event_id", "sub"]))
    both = [{tuple(r) for r in df.select("run_id", "sequence", "sse").collect()} for df in (rows, told)]
    assert both[0] == both[1]
    public.unpersist()


def test_trace_fold_equals_batch(spark, tmp_path):
    t0 = dt.datetime(2026, 1, 1)
    kinds = ["task.started", "artifact.created", "task.completed", "task.started", "run.failed", "artifact.created", "task.completed", "artifact.created"]
    rows = []
    for run in range(12):
        for i in range(25):
            kind = kinds[(run * 7 + i * i + i) % len(kinds)]
            task = None if kind == "run.failed" else f"t{(run + i * 3) % 4}"
            rows.append((run, i + 1, kind, task, f"agent{i % 3}", f"a{i}", "k", t0 + dt.timedelta(seconds=i)))
    df = spark.createDataFrame(rows, S.ENVELOPE)
    folder = str(tmp_path)
    for lo, hi in ((1, 8), (9, 17), (18, 25)):
        df.filter(F.col("sequence").between(lo, hi)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(1.1)  # file streams order by modification time
    live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    updates = finish(S.trace_stream(live), folder, "traces", "update")
    batch = E.task_traces(df).select("run_id", "task_id", "agent", "status", "started_at", "completed_at", "n_artifacts")
    # the state of a task is among its updates, and no later update contradicts it
    assert batch.join(updates, ["run_id", "task_id"], "left_anti").count() == 0
    assert batch.exceptAll(updates.distinct()).count() == 0
    most = updates.groupBy("run_id", "task_id").agg(F.max("n_artifacts").alias("m"))
    assert batch.join(most, ["run_id", "task_id"]).filter("m <> n_artifacts").count() == 0


def test_terminal_watch(spark, tmp_path):
    rows = [(1, 1, "task.started"), (1, 2, "run.completed"), (2, 1, "run.failed"), (2, 2, "run.completed"), (3, 1, "task.started")]
    df = spark.createDataFrame([(r, s, e, None, None, None, None, dt.datetime(2026, 1, 1)) for r, s, e in rows], S.ENVELOPE)
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = (S.terminal_stream(live, wait_ms=500).writeStream.outputMode("update").format("memory").queryName("ends")
         .option("checkpointLocation", f"{tmp_path}/ck").trigger(processingTime="500 milliseconds").start())
    try:
        end = time.time() + 60
        while time.time() < end and spark.table("ends").filter("run_id = 3").count() == 0:
            time.sleep(0.5)
    finally:
        q.stop()
    assert {(r["run_id"], r["verdict"]) for r in spark.table("ends").collect()} == {(1, "ok"), (2, "repeated"), (3, "missing")}


def test_ingest_stream(spark, data, tmp_path):
    rows = TB.uploads(spark, data).persist()
    live = stream(spark, rows, str(tmp_path))
    ingest_stream(live, f"{tmp_path}/registry", f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    registry = spark.read.parquet(f"{tmp_path}/registry")
    assert out.select("upload_id").distinct().count() == rows.count() == out.count()
    valid = out.filter("status <> 'rejected'")
    assert registry.count() == registry.select("sha").distinct().count() == valid.select("sha").distinct().count()
    assert out.filter("status IN ('completed', 'failed')").count() == registry.count()
    rows.unpersist()
