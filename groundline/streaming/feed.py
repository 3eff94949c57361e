"""The run feed as Structured Streaming: sequence numbers, task traces, missing ends."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from groundline.operators.events import PAYLOAD, TERMINAL, public_events

ENVELOPE = "run_id long, sequence long, event string, task_id string, agent string, artifact_id string, artifact_kind string, ts timestamp"
#: Numbered rows: all the batch envelope needs.
NUMBERED = ENVELOPE + ", status string, event_id long, sub int, " + ", ".join(f"{c} {t}" for c, t in PAYLOAD.items())
STEPS = ["task.started", "artifact.created", "task.completed"]
TRACE = "run_id long, task_id string, agent string, status string, started_at timestamp, completed_at timestamp, n_artifacts long"
ALERT = "run_id long, verdict string"


def public_stream(events: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Internal event stream joined to the artifact table; keeps no state."""
    return public_events(events, artifacts)


class Sequencer(StatefulProcessor):
    """Gap-free numbers per run over all batches; rows of one batch go by time."""

    def __init__(self, ttl_ms: int | None, columns: list[str]):
        self.ttl_ms, self.columns = ttl_ms, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0] if self.count.exists() else 0
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id", "sub"])
        batch["sequence"] = range(n + 1, n + len(batch) + 1)
        self.count.update((n + len(batch),))
        yield batch[self.columns]

    def close(self) -> None:
        pass


class TraceFold(StatefulProcessor):
    """Latest state of every task of a run; emits the tasks a batch touched.

    Kept per task is what the batch reduction needs: first event, last start, last
    completion, first failure after it was opened, number of artifacts.
    """

    FIELDS = ("agent string, opened long, started timestamp, done long, completed timestamp, "
              "failed timestamp, artifacts long")

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tasks = handle.getMapState("tasks", "task_id string", self.FIELDS, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("sequence")
        failures = batch.loc[batch["event"] == "run.failed", ["sequence", "ts"]]
        known = {task: state for (task,), state in self.tasks.iterator()}
        steps = batch[batch["task_id"].notna() & batch["event"].isin(STEPS)].assign(agent=lambda b: b["agent"].fillna("Unknown agent"))
        changed = {task: self._merge(known.get(task), own) for task, own in steps.groupby("task_id")}
        for task, state in {**known, **changed}.items():
            agent, opened, started, done, completed, failed, n = state
            later = failures[failures["sequence"] > opened]
            if failed is None and done <= opened and len(later):
                changed[task] = (agent, opened, started, done, completed, later["ts"].iloc[0].to_pydatetime(), n)
        for task, state in changed.items():
            self.tasks.updateValue((task,), state)
        if changed:
            yield pd.DataFrame([(key[0], task, *self._shown(s)) for task, s in sorted(changed.items())],
                               columns=["run_id", "task_id", "agent", "status", "started_at", "completed_at", "n_artifacts"])

    @staticmethod
    def _merge(known, own: pd.DataFrame):
        """State after a task's new events; a start opens it again."""
        first = own.iloc[0]
        made = first["event"] == "artifact.created"
        if known is None:
            known = (first["agent"], int(first["sequence"]) if made else 0, first["ts"].to_pydatetime() if made else None, -1, None, None, 0)
        agent, opened, started, done, completed, failed, n = known
        starts, ends = (own[own["event"] == e] for e in ("task.started", "task.completed"))
        if len(starts):
            last = starts.iloc[-1]
            agent, opened, started, failed = last["agent"], int(last["sequence"]), last["ts"].to_pydatetime(), None
        if len(ends):
            done, completed = int(ends["sequence"].iloc[-1]), ends["ts"].iloc[-1].to_pydatetime()
        return agent, opened, started, done, completed, failed, int(n + (own["event"] == "artifact.created").sum())

    @staticmethod
    def _shown(state):
        agent, opened, started, done, completed, failed, n = state
        if done > opened:
            return agent, "completed", started, completed, n
        return agent, "running" if failed is None else "failed", started, failed, n

    def close(self) -> None:
        pass


class TerminalWatch(StatefulProcessor):
    """Reports runs with a repeated end, and runs silent for ``wait_ms`` without one."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ends = handle.getValueState("ends", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.ends.get()[0] if self.ends.exists() else 0
        n = before + sum(int(p["event"].isin(TERMINAL).sum()) for p in rows)
        self.ends.update((n,))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if n == 0:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
        verdict = ["ok"] if before == 0 and n == 1 else ["repeated"] if n > 1 and n > before else []
        if verdict:
            yield pd.DataFrame({"run_id": [key[0]], "verdict": verdict})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"run_id": [key[0]], "verdict": ["missing"]})

    def close(self) -> None:
        pass


def _time_mode(ttl_ms: int | None) -> str:
    """With ``ttl_ms`` the state of a run silent for so long is dropped; such a query needs a processing-time trigger."""
    return "none" if ttl_ms is None else "processingTime"


def number_stream(public: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Feed rows with ``sequence``; ``operators.events.envelope`` applies to them as it does to the batch feed."""
    columns = [part.split()[0] for part in NUMBERED.split(", ")]
    return public.groupBy("run_id").transformWithStateInPandas(Sequencer(ttl_ms, columns), NUMBERED, "append", _time_mode(ttl_ms))


def trace_stream(feed: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Task states as they change; the last row per task is its state."""
    return feed.groupBy("run_id").transformWithStateInPandas(TraceFold(ttl_ms), TRACE, "update", _time_mode(ttl_ms))


def terminal_stream(feed: DataFrame, wait_ms: int = 60_000) -> DataFrame:
    return feed.select("run_id", "event").groupBy("run_id").transformWithStateInPandas(
        TerminalWatch(wait_ms), ALERT, "update", "processingTime")


