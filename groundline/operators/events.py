"""Run events: public feed, sequence numbers, task traces, releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from groundline import config as C
from groundline.functions import text as T
from groundline.operators.ordering import position

TERMINAL = ["run.completed", "run.failed"]


#: What completed steps report; artifact tables carry these columns where known.
PAYLOAD = {"evidence_count": "bigint", "source_ids": "array<string>", "claim_count": "bigint", "sufficient": "boolean",
           "missing_points": "array<string>"}
STEP_FIELDS = {"evidence_pool": ("evidence_count", "source_ids"), "research_draft": ("claim_count",),
               "evidence_verification": ("sufficient", "missing_points")}

#: Rows of the feed searched together for the next failure.
FAILURE_SPAN = 4096


def clock_minute(ts: Column) -> Column:
    """Minutes since 1970 of a timestamp without zone: the bucket runs are numbered in."""
    return F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 1440 + F.hour(ts) * 60 + F.minute(ts)


# ---- event log --------------------------------------------------------------------------------

def board_events(actions: DataFrame) -> DataFrame:
    """Action rows (run_id, seq, action, actor, task_id, artifact_id, kind, recipient, content, confidence) to event rows.

    message -> MESSAGE_SENT, artifact -> ARTIFACT_PUBLISHED or CRITIQUE_PUBLISHED,
    claim, create, release, close -> the task event; a reopened task logs nothing.
    """
    action = F.col("action")
    kind = (
        F.when(action == "message", F.lit("MESSAGE_SENT"))
        .when((action == "artifact") & (F.col("kind") == "critique"), F.lit("CRITIQUE_PUBLISHED"))
        .when(action == "artifact", F.lit("ARTIFACT_PUBLISHED"))
        .when(action == "claim", F.lit("TASK_CLAIMED")).when(action == "create", F.lit("TASK_CREATED"))
        .when(action == "release", F.lit("TASK_RELEASED")).when(action == "close", F.lit("TASK_CLOSED"))
        .when(action == "revise", F.lit("REVISION_REQUESTED")).when(action == "accept", F.lit("FINAL_ACCEPTED")))
    return actions.withColumn("type", kind).filter("type IS NOT NULL").select(
        "run_id", "seq", "type", "actor", "task_id", F.when(action == "artifact", F.col("artifact_id")).otherwise(F.lit("")).alias("artifact_id"),
        F.when(action == "artifact", F.col("kind")).otherwise(F.col("content")).alias("message"),
        F.when(action == "message", F.to_json(F.struct("recipient", "kind"))).when(action == "artifact", F.to_json(F.struct("confidence")))
        .otherwise(F.lit("{}")).alias("metadata"))


def public_events(events: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Internal events to (run_id, ts, event_id, sub, event, task_id, agent, status, artifact_id, artifact_kind, payload columns).

    A published artifact is announced, and again as a completed step with its
    payload when its kind is one and it has a value (``has_value`` false: none);
    publications of unknown artifacts are dropped. Claims and closings are single
    events. Map-side, but for the join on the artifact id.
    """
    known = {c: F.col(c) if c in artifacts.columns else F.lit(None) for c in PAYLOAD}
    valued = F.coalesce("has_value", F.lit(False)) if "has_value" in artifacts.columns else F.lit(True)
    def row(sub, event, task, agent, status, artifact=None, kind=None, payload=False):
        null = F.lit(None).cast("string")
        told = [(F.when(F.col("kind").isin([k for k, names in STEP_FIELDS.items() if c in names]), F.col(c)) if payload
                 else F.lit(None)).cast(t).alias(c) for c, t in PAYLOAD.items()]
        return F.struct(F.lit(sub).alias("sub"), event.alias("event"), task.alias("task_id"), agent.alias("agent"), status.alias("status"),
                        (null if artifact is None else artifact).alias("artifact_id"), (null if kind is None else kind).alias("artifact_kind"), *told)

    task, actor, null = F.col("task_id"), F.col("actor"), F.lit(None).cast("string")
    keep = ["run_id", "ts", "event_id"]
    simple = events.filter(F.col("type").isin("TASK_CLAIMED", "TASK_CLOSED")).select(
        *keep, F.when(F.col("type") == "TASK_CLAIMED", row(1, F.lit("task.started"), task, actor, F.lit("started")))
        .otherwise(row(1, F.lit("task.completed"), task, actor, F.lit("completed"))).alias("r"))
    steps = F.create_map(*[F.lit(x) for kv in C.COMPLETION_EVENTS.items() for x in kv])
    published = events.filter("type = 'ARTIFACT_PUBLISHED'").select(*keep, "artifact_id").join(
        artifacts.select("artifact_id", "kind", F.col("task_id").alias("a_task"), "owner", valued.alias("valued"),
                         *[c.cast(PAYLOAD[n]).alias(n) for n, c in known.items()]), "artifact_id")
    step = F.try_element_at(steps, F.col("kind"))
    made = published.select(*keep, F.explode(F.array_compact(F.array(
        row(1, F.lit("artifact.created"), F.col("a_task"), F.col("owner"), null, F.col("artifact_id"), F.col("kind")),
        F.when(step.isNotNull() & F.col("valued"), row(2, step, F.col("a_task"), null, null, F.col("artifact_id"), payload=True)),
    ))).alias("r"))
    return simple.unionByName(made).select(*keep, "r.*")


def with_terminal(public: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Append one terminal event per run; ``outcomes`` is (run_id, ts, event_id, failed)."""
    null = F.lit(None).cast("string")
    last = outcomes.select(
        "run_id", "ts", "event_id", F.lit(9).alias("sub"),
        F.when(F.col("failed"), F.lit("run.failed")).otherwise(F.lit("run.completed")).alias("event"),
        *[null.alias(c) for c in ("task_id", "agent", "status", "artifact_id", "artifact_kind")],
        *[F.lit(None).cast(t).alias(c) for c, t in PAYLOAD.items()])
    return public.unionByName(last)


def run_outcomes(events: DataFrame) -> DataFrame:
    """(run_id, ts, event_id, failed): the last event of each run and whether it asks for a revision."""
    last = F.max(F.struct("ts", "event_id", "type")).alias("l")
    return events.groupBy("run_id").agg(last).select("run_id", "l.ts", "l.event_id", (F.col("l.type") == "REVISION_REQUESTED").alias("failed"))


def with_sequence(public: DataFrame) -> DataFrame:
    """Gap-free numbers 1.. per run, counted minute by minute so a busy run spreads over tasks."""
    return position(public, ["run_id"], clock_minute(F.col("ts")), ["ts", "event_id", "sub"], "sequence", 1)


def envelope(e: DataFrame) -> DataFrame:
    """Add the JSON envelope of the feed and its text form."""
    data = F.struct("task_id", "agent", "status", "artifact_id", "artifact_kind", *PAYLOAD)
    body = F.to_json(F.struct("event", F.col("run_id").cast("string").alias("run_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
                              "sequence", data.alias("data")))
    return e.withColumn("envelope", body).withColumn(
        "sse", F.concat(F.lit("event: "), "event", F.lit("\ndata: "), "envelope", F.lit("\n\n")))


def envelope_valid(raw: Column) -> Column:
    """All five envelope fields present with their types, and a known event name."""
    e = F.from_json(raw, "event string, run_id string, timestamp string, sequence double, data map<string,string>")
    typed = F.get_json_object(raw, "$.sequence")
    return (e["event"].isin(C.PUBLIC_EVENTS) & e["run_id"].isNotNull() & e["timestamp"].isNotNull() & e["sequence"].isNotNull()
            & e["data"].isNotNull() & F.regexp_like(typed, F.lit(r"^-?\d")))


# ---- folds over the feed ------------------------------------------------------------------------

def task_traces(feed: DataFrame) -> DataFrame:
    """State of each task after its run's events: (run_id, task_id, agent, status, started_at, completed_at, n_artifacts).

    The fold over a task's events depends only on its last start, its last
    completion and the first run failure after that start, so it is three
    aggregations that combine before the shuffle; no run is gathered or sorted.
    """
    own = feed.filter(F.col("task_id").isNotNull() & F.col("event").isin("task.started", "artifact.created", "task.completed"))
    start, made, done = (F.col("event") == e for e in ("task.started", "artifact.created", "task.completed"))
    row = F.struct("sequence", "ts", F.coalesce("agent", F.lit("Unknown agent")).alias("agent"), "event")
    per = own.groupBy("run_id", "task_id").agg(
        F.min(row).alias("first"), F.max(F.when(start, row)).alias("start"), F.max(F.when(done, row)).alias("done"),
        F.count_if(made).alias("n_artifacts"))
    created = F.col("first.event") == "artifact.created"
    opened = per.withColumn("open_seq", F.coalesce("start.sequence", F.when(created, F.col("first.sequence")), F.lit(0)))
    finished = F.coalesce(F.col("done.sequence") > F.col("open_seq"), F.lit(False))
    rows = opened.join(next_failures(opened.filter(~finished), feed), ["run_id", "task_id"], "left")
    broken = ~finished & F.col("fail").isNotNull()
    return rows.select(
        "run_id", "task_id", F.coalesce("start.agent", "first.agent").alias("agent"),
        F.when(finished, F.lit("completed")).when(broken, F.lit("failed")).otherwise(F.lit("running")).alias("status"),
        F.coalesce("start.ts", F.when(created, F.col("first.ts"))).alias("started_at"),
        F.when(finished, F.col("done.ts")).when(broken, F.col("fail.f_ts")).alias("completed_at"), "n_artifacts")


def next_failures(opened: DataFrame, feed: DataFrame) -> DataFrame:
    """(run_id, task_id, fail): the first failure of the run after each task's ``open_seq``, where there is one.

    Looked up within spans of the feed, then in the first later span that holds
    one, so no failure meets every task and a busy run spreads over its spans.
    """
    span = lambda c: F.floor(F.col(c) / FAILURE_SPAN).alias("_span")
    failure = F.struct(F.col("sequence").alias("f_seq"), F.col("ts").alias("f_ts"))
    failed = feed.filter("event = 'run.failed'").select(
        "run_id", span("sequence"), F.col("sequence").alias("_seq"), F.lit(None).cast("string").alias("task_id"), failure.alias("_f"))
    marks = opened.select("run_id", span("open_seq"), F.col("open_seq").alias("_seq"), "task_id",
                          F.lit(None).cast(failed.schema["_f"].dataType).alias("_f")).unionByName(failed)

    def later(*keys: str, order: str):
        return Window.partitionBy(*keys).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)

    spans = marks.groupBy("run_id", "_span").agg(F.min("_f").alias("_f")).withColumn(
        "_next", F.last("_f", ignorenulls=True).over(later("run_id", order="_span"))).drop("_f")
    near = marks.withColumn("_near", F.last("_f", ignorenulls=True).over(later("run_id", "_span", order="_seq")))
    return near.filter("task_id IS NOT NULL").join(spans, ["run_id", "_span"]).select(
        "run_id", "task_id", F.coalesce("_near", "_next").alias("fail")).filter("fail IS NOT NULL")


def trace_artifacts(feed: DataFrame) -> DataFrame:
    """Artifacts of each task in feed order, one row each."""
    made = feed.filter("event = 'artifact.created' AND task_id IS NOT NULL")
    return position(made, ["run_id", "task_id"], clock_minute(F.col("ts")), ["sequence"], "artifact_no", 1).select(
        "run_id", "task_id", "artifact_no", "artifact_id", "artifact_kind")


def terminal_counts(feed: DataFrame) -> DataFrame:
    """Terminal events per run and the verdict: ok, missing or repeated."""
    n = F.count_if(F.col("event").isin(TERMINAL))
    return feed.groupBy("run_id").agg(n.alias("n_terminal")).withColumn(
        "verdict", F.when(F.col("n_terminal") == 1, F.lit("ok")).when(F.col("n_terminal") == 0, F.lit("missing")).otherwise(F.lit("repeated")))


def latest_artifacts(artifacts: DataFrame, *keys: str) -> DataFrame:
    """Newest artifact per run, kind and optional further keys such as the owner."""
    return artifacts.groupBy("run_id", "kind", *keys).agg(F.max_by("artifact_id", "seq").alias("artifact_id"), F.max("seq").alias("seq"))


def open_tasks(tasks: DataFrame) -> DataFrame:
    return tasks.filter("status = 'OPEN'")


def messages_for(messages: DataFrame, recipient: str) -> DataFrame:
    return messages.filter(F.col("recipient").isin(recipient, "*"))


def release_tasks(tasks: DataFrame) -> DataFrame:
    """Blocked tasks open when every dependency exists and is closed.

    ``tasks``: run_id, task_id, status, depends_on.
    """
    needs = tasks.filter("status = 'BLOCKED'").select("run_id", "task_id", F.explode_outer("depends_on").alias("dep"))
    state = tasks.select("run_id", F.col("task_id").alias("dep"), F.col("status").alias("dep_status"))
    ready = needs.join(state, ["run_id", "dep"], "left").groupBy("run_id", "task_id").agg(
        F.bool_and(F.col("dep").isNull() | (F.coalesce("dep_status", F.lit("")) == "CLOSED")).alias("_ready"))
    return tasks.join(ready, ["run_id", "task_id"], "left").withColumn(
        "status", F.when(F.coalesce("_ready", F.lit(False)), F.lit("OPEN")).otherwise(F.col("status"))).drop("_ready")


def run_history(runs: DataFrame) -> DataFrame:
    """Latest record per run, newest first."""
    return runs.groupBy("run_id").agg(F.max_by(F.struct("status", "answer_id"), "seq").alias("r"), F.max("seq").alias("seq")).select(
        "run_id", "r.status", "r.answer_id", "seq").orderBy(F.col("seq").desc())
