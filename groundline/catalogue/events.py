"""Catalogue: run events, traces and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundline import config as C
from groundline.catalogue import base as B
from groundline.functions import rules
from groundline.functions import text as T
from groundline.operators import events as E
from groundline.operators import metrics as M

TYPES = {"signup": "TASK_CLAIMED", "view": "ARTIFACT_PUBLISHED", "purchase": "TASK_CLOSED", "error": "REVISION_REQUESTED", "click": "MESSAGE_SENT"}
ACTIONS = {"signup": "claim", "view": "artifact", "purchase": "close", "error": "reopen", "click": "message"}
KINDS = ["evidence_pool", "research_draft", "evidence_verification", "critique"]


# ---- input views ------------------------------------------------------------------------------

def _map(values: dict):
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def run_events(spark, d):
    """Every event is a step of run ``user_id`` on one of its six tasks."""
    k = F.get_json_object("props", "$.k").cast("long")
    n = (F.col("event_id") % 6 + 1).cast("int")
    return B.table(spark, d, "events").select(
        F.col("user_id").alias("run_id"), "ts", "event_id", F.element_at(_map(TYPES), F.col("event_type")).alias("type"),
        F.element_at(T.strings([t for t, _, _ in C.TASK_CHAIN]), n).alias("task_id"),
        F.element_at(T.strings([a for _, a, _ in C.TASK_CHAIN]), n).alias("actor"),
        F.concat(F.lit("a"), "event_id").alias("artifact_id"), F.element_at(T.strings(KINDS), (k % 4 + 1).cast("int")).alias("kind"),
        F.element_at(_map(ACTIONS), F.col("event_type")).alias("action"), "event_type", "value", k.alias("k"))


def artifacts(spark, d):
    """Artifacts of the publishing events; those of tiny value were never stored."""
    return run_events(spark, d).filter("type = 'ARTIFACT_PUBLISHED' AND value >= 1.0").select(
        "run_id", "artifact_id", "kind", "task_id", F.col("actor").alias("owner"), F.struct("ts", "event_id").alias("seq"),
        (F.col("k") % 9 > 0).alias("has_value"), (F.col("k") % 7).alias("evidence_count"),
        F.array(F.concat(F.lit("src-"), F.col("k") % 5), F.concat(F.lit("src-"), F.col("k") % 3)).alias("source_ids"),
        (F.col("k") % 4).alias("claim_count"), (F.col("k") % 2 == 0).alias("sufficient"),
        F.when(F.col("k") % 2 == 0, T.strings([])).otherwise(F.array(F.concat(F.lit("gap "), F.col("k")))).alias("missing_points"))


def feed(spark, d):
    ev = run_events(spark, d)
    public = E.with_terminal(E.public_events(ev, artifacts(spark, d)), E.run_outcomes(ev))
    return E.with_sequence(public)


def run_tasks(spark, d):
    """Six chained tasks per run; a task is closed when one of its closing events happened."""
    ev = run_events(spark, d)
    closed = ev.filter("type = 'TASK_CLOSED'").select("run_id", "task_id").distinct().withColumn("c", F.lit(True))
    ids = [t for t, _, _ in C.TASK_CHAIN]
    chain = F.array(*[F.struct(F.lit(t).alias("task_id"), T.strings(ids[i - 1:i] if i else []).alias("depends_on")) for i, t in enumerate(ids)])
    rows = ev.select("run_id").distinct().select("run_id", F.inline(chain))
    return rows.join(closed, ["run_id", "task_id"], "left").select(
        "run_id", "task_id", "depends_on", F.when(F.col("c"), F.lit("CLOSED")).when(F.size("depends_on") == 0, F.lit("OPEN")).otherwise(F.lit("BLOCKED")).alias("status"))


def calls(spark, d):
    e = run_events(spark, d)
    free = F.col("run_id") % 5 == 0
    return e.select(
        "run_id", F.col("event_type").alias("stage"), F.col("value").alias("latency_ms"), F.when(F.col("event_id") % 10 == 0, F.lit(0)).otherwise(F.col("k")).alias("prompt_tokens"),
        F.when(F.col("event_id") % 10 == 0, F.lit(None).cast("long")).otherwise(F.floor(F.col("k") / 2)).alias("completion_tokens"),
        F.when(F.col("event_id") % 4 == 0, F.col("k") * 2).otherwise(F.lit(0)).alias("total_tokens"), F.when(F.col("event_id") % 2 == 0, F.lit("OpenAI")).otherwise(F.lit("local")).alias("provider"),
        F.lit("m-remote").alias("openai_model"), F.lit("m-local").alias("ollama_model"), F.when(free, F.lit(0.0)).otherwise(F.lit(0.000002)).alias("prompt_price"),
        F.when(free, F.lit(0.0)).otherwise(F.lit(0.000006)).alias("completion_price"))


# ---- queries ------------------------------------------------------------------------------------

def event_mapping(spark, d):
    return E.public_events(run_events(spark, d), artifacts(spark, d)).select(
        "run_id", "event_id", F.col("sub").cast("long").alias("sub"), "event", "task_id", "agent", "status", "artifact_id", "artifact_kind",
        "evidence_count", F.array_join("source_ids", ",").alias("source_ids"), "claim_count", "sufficient", F.array_join("missing_points", ",").alias("missing_points"))


def event_sequence(spark, d):
    return E.envelope(feed(spark, d)).select("run_id", "event_id", "event", F.col("sequence").cast("long").alias("sequence"), T.sha("sse").alias("sha"))


def board_log(spark, d):
    actions = run_events(spark, d).select(
        "run_id", F.col("event_id").alias("seq"), "action", "actor", "task_id", "artifact_id", "kind", F.lit("*").alias("recipient"),
        F.col("event_type").alias("content"), F.round("value", 2).alias("confidence"))
    return E.board_events(actions).select("run_id", "seq", "type", "actor", "task_id", "artifact_id", "message")


def event_filters(spark, d):
    """Open tasks and messages to an agent or to all, counted per run."""
    tasks = E.open_tasks(run_tasks(spark, d)).groupBy("run_id").agg(F.count("*").alias("n")).withColumn("what", F.lit("open"))
    sent = run_events(spark, d).filter("type = 'MESSAGE_SENT'").select("run_id", F.when(F.col("k") % 3 == 0, F.lit("*")).otherwise(F.col("actor")).alias("recipient"))
    got = E.messages_for(sent, "MemoryAgent").groupBy("run_id").agg(F.count("*").alias("n")).withColumn("what", F.lit("messages"))
    kinds = artifacts(spark, d).filter("kind = 'research_draft'").groupBy("run_id").agg(F.count("*").alias("n")).withColumn("what", F.lit("drafts"))
    return tasks.unionByName(got).unionByName(kinds)


def envelope_check(spark, d):
    """Envelopes with planted faults: unknown names, missing run, text sequence."""
    e = feed(spark, d).withColumn("event", F.when(F.col("event_id") % 11 == 3, F.lit("task.paused")).otherwise(F.col("event")))
    raw = E.envelope(e).withColumn("raw", F.when(F.col("event_id") % 11 == 5, F.regexp_replace("envelope", '"run_id"', '"run"'))
        .when(F.col("event_id") % 11 == 7, F.regexp_replace("envelope", r'"sequence":(\d+)', '"sequence":"$1"')).otherwise(F.col("envelope")))
    return raw.select("run_id", "event_id", F.col("sub").cast("long").alias("sub"), F.coalesce(E.envelope_valid(F.col("raw")), F.lit(False)).alias("valid"))


def latest_artifact(spark, d):
    a = artifacts(spark, d)
    return E.latest_artifacts(a).select("run_id", "kind", F.lit("any").alias("owner"), "artifact_id").unionByName(
        E.latest_artifacts(a, "owner").select("run_id", "kind", "owner", "artifact_id"))


def task_trace(spark, d):
    t = E.task_traces(feed(spark, d))
    return t.select("run_id", "task_id", rules.task_label(F.col("task_id")).alias("label"), "agent", "status",
                    *[F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in ("started_at", "completed_at")], "n_artifacts")


def task_trace_failures(spark, d):
    """The fold with several failures per run: every revision request fails the run."""
    f = feed(spark, d)
    null = F.lit(None).cast("string")
    failed = run_events(spark, d).filter("type = 'REVISION_REQUESTED'").select(
        "run_id", "ts", "event_id", F.lit(5).alias("sub"), F.lit("run.failed").alias("event"), *[null.alias(c) for c in ("task_id", "agent", "status", "artifact_id", "artifact_kind")],
        *[F.lit(None).cast(t).alias(c) for c, t in E.PAYLOAD.items()])
    again = E.with_sequence(f.drop("sequence").unionByName(failed))
    return E.task_traces(again).select("run_id", "task_id", "agent", "status", F.date_format("completed_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("completed_at"))


def trace_artifacts(spark, d):
    return E.trace_artifacts(feed(spark, d)).select("run_id", "task_id", F.col("artifact_no").cast("long").alias("artifact_no"), "artifact_id", "artifact_kind")


def terminal_check(spark, d):
    """Closing events end a run, revision requests fail it: mostly more than one terminal."""
    e = run_events(spark, d).select("run_id", F.when(F.col("type") == "TASK_CLOSED", F.lit("run.completed")).when(F.col("type") == "REVISION_REQUESTED", F.lit("run.failed"))
                                    .otherwise(F.lit("task.started")).alias("event"))
    own = feed(spark, d).select("run_id", "event")
    return E.terminal_counts(e).withColumn("log", F.lit("raw")).unionByName(E.terminal_counts(own).withColumn("log", F.lit("feed")))


def dependency_release(spark, d):
    return E.release_tasks(run_tasks(spark, d)).select("run_id", "task_id", "status")


def run_history(spark, d):
    runs = run_events(spark, d).select("run_id", F.col("type").alias("status"), F.col("artifact_id").alias("answer_id"), F.struct("ts", "event_id").alias("seq"))
    return E.run_history(runs).select("run_id", "status", "answer_id")


def usage_totals(spark, d):
    return M.usage_totals(M.trace_rows(calls(spark, d)))


def trace_projection(spark, d):
    t = M.public_traces(M.trace_rows(calls(spark, d)))
    return t.groupBy("run_id", "stage", "model").agg(
        F.count("*").alias("n"), F.count("total_tokens").alias("with_usage"), F.sum("total_tokens").alias("total_tokens"), F.round(F.sum("latency_ms"), 3).alias("latency_ms"))


def latency_by_stage(spark, d):
    return M.latency_by_stage(M.trace_rows(calls(spark, d)))


def run_metrics(spark, d):
    ev = run_events(spark, d)
    evidence = ev.filter("type = 'ARTIFACT_PUBLISHED'").select("run_id", (F.col("k") % 2 + 1).alias("retrieval_round"), F.col("kind").alias("source_id"))
    traces = M.trace_rows(calls(spark, d)).withColumn("stage", F.when(F.col("stage") == "view", F.lit("verification")).otherwise(F.col("stage")))
    return M.run_metrics(evidence, traces)


def run_diagnostics(spark, d):
    ev = run_events(spark, d).withColumn("error_type", F.concat(F.lit("Error"), F.col("k") % 5))
    last = E.run_outcomes(ev)
    outcomes = last.select(
        "run_id", (~F.col("failed") & (F.col("event_id") % 3 > 0)).alias("has_result"), F.lit("success").alias("result_status"),
        F.when(F.col("event_id") % 7 == 0, F.struct(F.lit("draft").alias("stage"), F.lit("timeout").alias("error_type"))).alias("provider_error"), F.lit(True).alias("fallback_used"))
    return M.run_diagnostics(ev, M.trace_rows(calls(spark, d)), outcomes)


def error_classify(spark, d):
    """Error events as provider failures with a status taken from their properties."""
    e = run_events(spark, d)
    status = F.element_at(F.array(*[F.lit(s) for s in (401, 403, 404, 429, 500, 503)]), (F.col("k") % 6 + 1).cast("int"))
    kind = F.when(F.col("event_type") == "error", F.lit("http")).when(F.col("event_type") == "click", F.lit("timeout")).otherwise(F.lit("other"))
    p = rules.provider_error(kind, status)
    failure = rules.backend_failure(F.concat(F.lit("E"), "event_type"), F.when(F.col("event_type") == "error", status).cast("string"))
    return e.select("event_id", p["error_type"].alias("error_type"), p["retryable"].alias("retryable"), failure.alias("reason"))


QUERIES = {f.__name__: f for f in (
    event_mapping, event_sequence, board_log, event_filters, envelope_check, latest_artifact, task_trace, task_trace_failures, trace_artifacts,
    terminal_check, dependency_release, run_history, usage_totals, trace_projection, latency_by_stage, run_metrics, run_diagnostics, error_classify)}

# ---- the same in SQL ---------------------------------------------------------------------------

V, N = B.VIEWS, B.NEEDS


def _case(x: str, values: dict) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


_IDS, _AGENTS = B.d_list([t for t, _, _ in C.TASK_CHAIN]), B.d_list([a for _, a, _ in C.TASK_CHAIN])
_NO_PAYLOAD = "NULL::BIGINT AS evidence_count, NULL::VARCHAR[] AS source_ids, NULL::BIGINT AS claim_count, NULL::BOOLEAN AS sufficient, NULL::VARCHAR[] AS missing_points"
V |= {
    "rev": f"""SELECT user_id AS run_id, ts, event_id, {_case('event_type', TYPES)} AS type, {_IDS}[event_id % 6 + 1] AS task_id, {_AGENTS}[event_id % 6 + 1] AS actor,
        'a' || event_id AS artifact_id, {B.d_list(KINDS)}[k % 4 + 1] AS kind, event_type, value, k FROM (SELECT *, (props->>'$.k')::BIGINT AS k FROM events)""",
    "arts": "SELECT * FROM rev WHERE type = 'ARTIFACT_PUBLISHED' AND value >= 1.0",
    "pub": f"""SELECT run_id, ts, event_id, 1 AS sub, CASE WHEN type = 'TASK_CLAIMED' THEN 'task.started' ELSE 'task.completed' END AS event, task_id, actor AS agent,
        CASE WHEN type = 'TASK_CLAIMED' THEN 'started' ELSE 'completed' END AS status, NULL AS artifact_id, NULL AS artifact_kind, {_NO_PAYLOAD} FROM rev WHERE type IN ('TASK_CLAIMED', 'TASK_CLOSED')
      UNION ALL SELECT run_id, ts, event_id, 1, 'artifact.created', task_id, actor, NULL, artifact_id, kind, {_NO_PAYLOAD} FROM arts
      UNION ALL SELECT run_id, ts, event_id, 2, {_case('kind', C.COMPLETION_EVENTS)}, task_id, NULL, NULL, artifact_id, NULL, CASE kind WHEN 'evidence_pool' THEN k % 7 END, CASE kind WHEN 'evidence_pool' THEN ['src-' || k % 5, 'src-' || k % 3] END,
        CASE kind WHEN 'research_draft' THEN k % 4 END, CASE kind WHEN 'evidence_verification' THEN k % 2 = 0 END,
        CASE kind WHEN 'evidence_verification' THEN CASE WHEN k % 2 = 0 THEN []::VARCHAR[] ELSE ['gap ' || k] END END FROM arts WHERE kind <> 'critique' AND k % 9 > 0""",
    "lastev": "SELECT run_id, ts, event_id, type, type = 'REVISION_REQUESTED' AS failed FROM rev QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, event_id DESC) = 1",
    "pubt": f"""SELECT * FROM pub UNION ALL SELECT run_id, ts, event_id, 9, CASE WHEN failed THEN 'run.failed' ELSE 'run.completed' END, NULL, NULL, NULL, NULL, NULL, {_NO_PAYLOAD} FROM lastev""",
    "feed": "SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id, sub) AS sequence FROM pubt",
    "feedf": f"""SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id, sub) AS sequence FROM (SELECT * FROM pubt UNION ALL
        SELECT run_id, ts, event_id, 5, 'run.failed', NULL, NULL, NULL, NULL, NULL, {_NO_PAYLOAD} FROM rev WHERE type = 'REVISION_REQUESTED')""",
    "rtasks": f"""SELECT r.run_id, t.i, t.task_id, CASE WHEN c.run_id IS NOT NULL THEN 'CLOSED' WHEN t.i = 1 THEN 'OPEN' ELSE 'BLOCKED' END AS status
      FROM (SELECT DISTINCT run_id FROM rev) r, (SELECT unnest({_IDS}) AS task_id, unnest(range(1, 7)) AS i) t
      LEFT JOIN (SELECT DISTINCT run_id, task_id FROM rev WHERE type = 'TASK_CLOSED') c ON c.run_id = r.run_id AND c.task_id = t.task_id""",
    "tr": """SELECT run_id, event_type AS stage, round(value, 3) AS latency_ms, p AS prompt_tokens, c AS completion_tokens, coalesce(nullif(t, 0), p + c) AS total_tokens,
        CASE WHEN event_id % 2 = 0 THEN 'm-remote' ELSE 'm-local' END AS model, CASE WHEN run_id % 5 <> 0 THEN round(p * 0.000002e0 + c * 0.000006e0, 8) END AS cost
      FROM (SELECT *, CASE WHEN event_id % 10 = 0 THEN 0 ELSE k END AS p, CASE WHEN event_id % 10 = 0 THEN 0 ELSE k // 2 END AS c, CASE WHEN event_id % 4 = 0 THEN k * 2 ELSE 0 END AS t FROM rev)""",
}
N |= {"arts": ["rev"], "pub": ["rev", "arts"], "lastev": ["rev"], "pubt": ["pub", "lastev"], "feed": ["pubt"], "feedf": ["pubt", "rev"], "rtasks": ["rev"], "tr": ["rev"]}


def _fold(view: str) -> str:
    """State after the last start, by window functions over each task's events."""
    return f"""SELECT *, CASE WHEN done_seq > open_seq THEN 'completed' WHEN fail_seq IS NOT NULL THEN 'failed' ELSE 'running' END AS status,
        CASE WHEN done_seq > open_seq THEN done_ts WHEN fail_seq IS NOT NULL THEN fail_ts END AS completed_at FROM
      (SELECT *, (SELECT min(sequence) FROM {view} f WHERE f.run_id = s.run_id AND f.event = 'run.failed' AND f.sequence > open_seq) AS fail_seq,
        (SELECT arg_min(ts, sequence) FROM {view} f WHERE f.run_id = s.run_id AND f.event = 'run.failed' AND f.sequence > open_seq) AS fail_ts FROM
       (SELECT run_id, task_id, coalesce(arg_max(agent, sequence) FILTER (WHERE event = 'task.started'), arg_min(agent, sequence)) AS agent,
          coalesce(max(sequence) FILTER (WHERE event = 'task.started'), CASE WHEN arg_min(event, sequence) = 'artifact.created' THEN min(sequence) END, 0) AS open_seq,
          coalesce(arg_max(ts, sequence) FILTER (WHERE event = 'task.started'), CASE WHEN arg_min(event, sequence) = 'artifact.created' THEN arg_min(ts, sequence) END) AS started_at,
          coalesce(max(sequence) FILTER (WHERE event = 'task.completed'), -1) AS done_seq, arg_max(ts, sequence) FILTER (WHERE event = 'task.completed') AS done_ts,
          count(*) FILTER (WHERE event = 'artifact.created') AS n_artifacts
        FROM {view} WHERE event IN ('task.started', 'artifact.created', 'task.completed') GROUP BY run_id, task_id) s)"""


_TS = "strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"
_JSON = """'{"event":"' || event || '","run_id":"' || run_id || '","timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '","sequence":' || sequence || ',"data":{' || concat_ws(',', '"task_id":"' || task_id || '"',
      '"agent":"' || agent || '"', '"status":"' || status || '"', '"artifact_id":"' || artifact_id || '"', '"artifact_kind":"' || artifact_kind || '"',
      '"evidence_count":' || evidence_count, '"source_ids":' || to_json(source_ids), '"claim_count":' || claim_count, '"sufficient":' || sufficient, '"missing_points":' || to_json(missing_points)) || '}}'"""
ORACLE = {
    "event_mapping": B.oracle("""SELECT run_id, event_id, sub::BIGINT AS sub, event, task_id, agent, status, artifact_id, artifact_kind,
        evidence_count, array_to_string(source_ids, ',') AS source_ids, claim_count, sufficient, array_to_string(missing_points, ',') AS missing_points FROM pub""", "pub"),
    "event_sequence": B.oracle(f"SELECT run_id, event_id, event, sequence, sha256('event: ' || event || chr(10) || 'data: ' || {_JSON} || chr(10) || chr(10)) AS sha FROM feed", "feed"),
    "board_log": B.oracle("""SELECT run_id, event_id AS seq, CASE WHEN type = 'ARTIFACT_PUBLISHED' AND kind = 'critique' THEN 'CRITIQUE_PUBLISHED' ELSE type END AS type, actor, task_id,
        CASE WHEN event_type = 'view' THEN artifact_id ELSE '' END AS artifact_id, CASE WHEN event_type = 'view' THEN kind ELSE event_type END AS message FROM rev WHERE event_type <> 'error'""", "rev"),
    "event_filters": B.oracle("""SELECT run_id, count(*) AS n, 'open' AS what FROM rtasks WHERE status = 'OPEN' GROUP BY run_id UNION ALL
        SELECT run_id, count(*), 'messages' FROM rev WHERE type = 'MESSAGE_SENT' AND (k % 3 = 0 OR actor = 'MemoryAgent') GROUP BY run_id UNION ALL
        SELECT run_id, count(*), 'drafts' FROM arts WHERE kind = 'research_draft' GROUP BY run_id""", "rtasks", "rev", "arts"),
    "envelope_check": B.oracle("SELECT run_id, event_id, sub::BIGINT AS sub, event_id % 11 NOT IN (3, 5, 7) AS valid FROM feed", "feed"),
    "latest_artifact": B.oracle("""SELECT run_id, kind, 'any' AS owner, artifact_id FROM arts QUALIFY row_number() OVER (PARTITION BY run_id, kind ORDER BY ts DESC, event_id DESC) = 1 UNION ALL
        SELECT run_id, kind, actor, artifact_id FROM arts QUALIFY row_number() OVER (PARTITION BY run_id, kind, actor ORDER BY ts DESC, event_id DESC) = 1""", "arts"),
    "task_trace": B.oracle(f"""SELECT run_id, task_id, {_case("split_part(task_id, ':', 3)", C.TASK_LABELS)} AS label, agent, status, {_TS.format(c='started_at')} AS started_at,
        {_TS.format(c='completed_at')} AS completed_at, n_artifacts FROM ({_fold('feed')})""", "feed"),
    "task_trace_failures": B.oracle(f"SELECT run_id, task_id, agent, status, {_TS.format(c='completed_at')} AS completed_at FROM ({_fold('feedf')})", "feedf"),
    "trace_artifacts": B.oracle("SELECT run_id, task_id, row_number() OVER (PARTITION BY run_id, task_id ORDER BY sequence) AS artifact_no, artifact_id, artifact_kind FROM feed WHERE event = 'artifact.created'", "feed"),
    "terminal_check": B.oracle("""SELECT *, CASE n_terminal WHEN 1 THEN 'ok' WHEN 0 THEN 'missing' ELSE 'repeated' END AS verdict FROM (
        SELECT run_id, count(*) FILTER (WHERE type IN ('TASK_CLOSED', 'REVISION_REQUESTED')) AS n_terminal, 'raw' AS log FROM rev GROUP BY run_id UNION ALL
        SELECT run_id, count(*) FILTER (WHERE event IN ('run.completed', 'run.failed')), 'feed' FROM feed GROUP BY run_id)""", "rev", "feed"),
    "dependency_release": B.oracle("""SELECT t.run_id, t.task_id, CASE WHEN t.status = 'BLOCKED' AND p.status = 'CLOSED' THEN 'OPEN' ELSE t.status END AS status
        FROM rtasks t LEFT JOIN rtasks p ON p.run_id = t.run_id AND p.i = t.i - 1""", "rtasks"),
    "run_history": B.oracle("SELECT run_id, type AS status, 'a' || event_id AS answer_id FROM lastev", "lastev"),
    "usage_totals": B.oracle("""SELECT run_id, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, sum(total_tokens)::BIGINT AS total_tokens,
        round(sum(cost), 8) AS estimated_cost FROM tr GROUP BY run_id""", "tr"),
    "trace_projection": B.oracle("""SELECT run_id, stage, model, count(*) AS n, count(*) FILTER (WHERE total_tokens > 0) AS with_usage, (sum(total_tokens) FILTER (WHERE total_tokens > 0))::BIGINT AS total_tokens,
        round(sum(latency_ms), 3) AS latency_ms FROM tr GROUP BY ALL""", "tr"),
    "latency_by_stage": B.oracle("SELECT stage, count(*) AS n_calls, round(avg(latency_ms), 3) AS avg_latency_ms, round(sum(latency_ms), 3) AS total_latency_ms FROM tr GROUP BY stage", "tr"),
    "run_metrics": B.oracle("""SELECT * FROM (SELECT run_id, count(*) AS tool_calls, bool_or(stage = 'view') AS verifier_triggered, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens,
          sum(total_tokens)::BIGINT AS total_tokens, round(sum(latency_ms), 3) AS latency_ms FROM tr GROUP BY run_id)
        JOIN (SELECT run_id, coalesce(max(k % 2 + 1) FILTER (WHERE type = 'ARTIFACT_PUBLISHED'), 0) AS retrieval_rounds, count(*) FILTER (WHERE type = 'ARTIFACT_PUBLISHED') AS retrieved_items,
          count(DISTINCT kind) FILTER (WHERE type = 'ARTIFACT_PUBLISHED') AS unique_sources, coalesce(bool_or(k % 2 = 1) FILTER (WHERE type = 'ARTIFACT_PUBLISHED'), false) AS retrieval_repair_triggered FROM rev GROUP BY run_id) USING (run_id)""", "tr", "rev"),
    "run_diagnostics": B.oracle("""SELECT run_id, CASE WHEN prov THEN 'provider_failure' WHEN lost THEN 'runtime_incomplete' ELSE 'success' END AS result_status, CASE WHEN prov THEN 502 WHEN lost THEN 500 ELSE 200 END::BIGINT AS http_status,
        prov AS provider_failure, CASE WHEN prov THEN 'draft' WHEN lost THEN r_actor END AS failure_stage, CASE WHEN prov THEN 'timeout' WHEN lost THEN coalesce(r_err, 'RuntimeIncomplete') END AS error_type, NOT prov AS fallback_used,
        CASE WHEN tot > 0 THEN tot END AS total_tokens
      FROM (SELECT *, event_id % 7 = 0 AS prov, event_id % 7 <> 0 AND (failed OR event_id % 3 = 0) AS lost FROM lastev)
      LEFT JOIN (SELECT run_id, arg_max(actor, (ts, event_id)) AS r_actor, 'Error' || arg_max(k % 5, (ts, event_id)) AS r_err FROM rev WHERE type = 'REVISION_REQUESTED' GROUP BY run_id) USING (run_id)
      LEFT JOIN (SELECT run_id, sum(total_tokens)::BIGINT AS tot FROM tr GROUP BY run_id) USING (run_id)""", "lastev", "rev", "tr"),
    "error_classify": B.oracle("""SELECT event_id, CASE event_type WHEN 'error' THEN CASE WHEN s IN (401, 403) THEN 'auth_quota' WHEN s = 429 THEN 'rate_limit' WHEN s >= 500 THEN 'server_error' ELSE 'http_error' END
        WHEN 'click' THEN 'timeout' ELSE 'provider_error' END AS error_type, CASE event_type WHEN 'error' THEN s = 429 OR s >= 500 WHEN 'click' THEN true ELSE false END AS retryable,
        'E' || event_type || CASE WHEN event_type = 'error' THEN ': HTTP ' || s ELSE '' END AS reason FROM (SELECT *, [401, 403, 404, 429, 500, 503][k % 6 + 1] AS s FROM rev)""", "rev"),
}
