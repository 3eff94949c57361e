"""Token usage, latency and run diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from groundline.functions import text as T
from groundline.functions.rules import estimated_cost


def trace_rows(calls: DataFrame) -> DataFrame:
    """Model calls to trace rows: totals filled in, latency rounded, cost priced."""
    p, c = F.coalesce("prompt_tokens", F.lit(0)), F.coalesce("completion_tokens", F.lit(0))
    openai = F.lower("provider") == "openai"
    return calls.withColumns({
        "prompt_tokens": p, "completion_tokens": c,
        "total_tokens": F.coalesce(F.nullif("total_tokens", F.lit(0)), p + c), "latency_ms": F.round("latency_ms", 3),
        "model": F.when(openai, F.col("openai_model")).otherwise(F.col("ollama_model")),
        "estimated_cost": estimated_cost(p, c, F.col("prompt_price"), F.col("completion_price")),
    }).drop("openai_model", "ollama_model", "prompt_price", "completion_price")


def has_usage() -> Column:
    return F.greatest(*[F.coalesce(c, F.lit(0)) for c in ("prompt_tokens", "completion_tokens", "total_tokens")]) > 0


def public_traces(traces: DataFrame) -> DataFrame:
    """Traces whose token columns are NULL when the provider reported none."""
    used = has_usage()
    return traces.withColumns({c: F.when(used, F.col(c)) for c in ("prompt_tokens", "completion_tokens", "total_tokens")})


def usage_totals(traces: DataFrame) -> DataFrame:
    """Sums per run; the cost stays NULL when no call has one."""
    return traces.groupBy("run_id").agg(
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("total_tokens").alias("total_tokens"), F.round(F.sum("estimated_cost"), 8).alias("estimated_cost"))


def latency_by_stage(traces: DataFrame) -> DataFrame:
    return traces.groupBy("stage").agg(
        F.count("*").alias("n_calls"), F.round(F.avg("latency_ms"), 3).alias("avg_latency_ms"),
        F.round(F.sum("latency_ms"), 3).alias("total_latency_ms"))


def run_metrics(evidence: DataFrame, traces: DataFrame) -> DataFrame:
    """Rounds, items, sources, calls, tokens and latency per run."""
    e = evidence.groupBy("run_id").agg(
        F.max("retrieval_round").alias("retrieval_rounds"), F.count("*").alias("retrieved_items"),
        F.count_distinct("source_id").alias("unique_sources"), F.bool_or(F.col("retrieval_round") > 1).alias("retrieval_repair_triggered"))
    t = traces.groupBy("run_id").agg(
        F.count("*").alias("tool_calls"), F.bool_or(F.col("stage") == "verification").alias("verifier_triggered"),
        *[F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")], F.round(F.sum("latency_ms"), 3).alias("latency_ms"))
    return t.join(e, "run_id", "left").fillna(0, ["retrieval_rounds", "retrieved_items", "unique_sources"]).fillna(False, ["retrieval_repair_triggered"])


def run_diagnostics(events: DataFrame, traces: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row per run: outcome code, HTTP status, failing stage and token totals.

    ``outcomes``: run_id, has_result, result_status, provider_error (struct of
    stage and error_type, NULL without one), fallback and insufficiency flags. A
    run without result blames its latest revision request.
    """
    revision = events.filter("type = 'REVISION_REQUESTED'").groupBy("run_id").agg(
        F.max_by(F.struct("actor", "error_type"), F.struct("ts", "event_id")).alias("rev"))
    totals = traces.groupBy("run_id").agg(F.sum("total_tokens").alias("_total"), F.bool_or(has_usage()).alias("_used"))
    rows = outcomes.join(revision, "run_id", "left").join(totals, "run_id", "left")
    provider = F.col("provider_error").isNotNull()
    lost = ~provider & ~F.col("has_result")
    return rows.select(
        "run_id",
        F.when(provider, F.lit("provider_failure")).when(lost, F.lit("runtime_incomplete")).otherwise(F.col("result_status")).alias("result_status"),
        F.when(provider, F.lit(502)).when(lost, F.lit(500)).otherwise(F.lit(200)).cast("long").alias("http_status"),
        provider.alias("provider_failure"),
        F.when(provider, F.col("provider_error.stage")).when(lost, F.col("rev.actor")).alias("failure_stage"),
        F.when(provider, F.col("provider_error.error_type")).when(lost & F.col("rev").isNotNull(), F.col("rev.error_type"))
        .when(lost, F.lit("RuntimeIncomplete")).alias("error_type"),
        F.when(provider, F.lit(False)).otherwise(F.col("fallback_used")).alias("fallback_used"),
        F.when(F.col("_used"), F.col("_total")).alias("total_tokens"))
