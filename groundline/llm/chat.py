"""Chat formatting with minimum-cost role repair.

Legal conversations follow an automaton: an optional system message, then user
and assistant messages in turn, the assistant last. A turn may be kept, merged
into the message before it, or relabelled, and empty messages may be inserted;
dynamic programming finds the cheapest way. A stretch of turns acts on the
automaton's states as a (min, +) matrix, so a long conversation is cut into
segments whose matrices are multiplied, and no task needs all of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from groundline.llm.base import Scratch

ROLES = ("system", "user", "assistant")
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant (the only state to end in).
NEXT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}
STATES = 4
MERGE, INSERT, RELABEL = 1, 2, 3
FAR = 1 << 40
#: Turns of one conversation that a task handles together.
SEGMENT = 4096
NO_ID = -(1 << 63)

MESSAGES = "conv_id long, segment long, piece int, turn long, action string, old_role string, role string, cost int, rendered string"


def role_number(role: str | None) -> int:
    """0 to 2 for the known roles (in any case, outer spaces allowed), else -1."""
    role = (role or "").strip().lower()
    return ROLES.index(role) if role in ROLES else -1


def insertions() -> list[list[tuple[int, list[int]]]]:
    """Cheapest (cost, inserted roles) from state to state; FAR where there is no way."""
    ways = [[(0, []) if a == b else (FAR, []) for b in range(STATES)] for a in range(STATES)]
    for _ in range(STATES):
        for a in range(STATES):
            for b in range(STATES):
                for (at, role), to in NEXT.items():
                    cost, roles = ways[a][at]
                    if to == b and cost + INSERT < ways[a][b][0]:
                        ways[a][b] = (cost + INSERT, [*roles, role])
    return ways


WAYS = insertions()


def actions(role: int) -> list[tuple[int, int, int, str, int]]:
    """(state before, state after, cost, action, new role) for a turn, without insertions."""
    out = []
    for state in range(STATES):
        for new in range(len(ROLES)):
            changed = 0 if new == role else RELABEL
            if (state, new) in NEXT:
                out.append((state, NEXT[state, new], changed, "relabel" if changed else "keep", new))
            if state == new + 1:  # the message before has this role
                out.append((state, state, MERGE + changed, "merge", new))
    return out


def steps(role: int) -> list[list[tuple[int, str, int, list[int]]]]:
    """Cheapest (cost, action, new role, inserted roles) for a turn from state to state; the first of equals."""
    best = [[(FAR, "", -1, []) for _ in range(STATES)] for _ in range(STATES)]
    for before in range(STATES):
        for state, after, cost, action, new in actions(role):
            way, roles = WAYS[before][state]
            if way + cost < best[before][after][0]:
                best[before][after] = (way + cost, action, new, roles)
    return best


STEPS = {role: steps(role) for role in (-1, 0, 1, 2)}
COSTS = {role: np.array([[c[0] for c in row] for row in table]) for role, table in STEPS.items()}
ENDING = np.array([WAYS[s][3][0] for s in range(STATES)])
BEGIN = np.array([0, FAR, FAR, FAR])


def forward(roles: list[int], prefix: np.ndarray) -> list[np.ndarray]:
    """Least costs of each state before every turn and after the last."""
    out = [prefix]
    for role in roles:
        out.append(np.minimum((out[-1][:, None] + COSTS[role]).min(0), FAR))
    return out


def matrix(roles: list[int]) -> np.ndarray:
    out = np.where(np.eye(STATES, dtype=bool), 0, FAR)
    for role in roles:
        out = np.minimum((out[:, :, None] + COSTS[role][None]).min(1), FAR)
    return out


def backward(roles: list[int], costs: list[np.ndarray], end: int) -> list[int]:
    """States before every turn and after the last on a cheapest way to ``end``; of equal ways the smaller states from the end."""
    states = [end]
    for role, before in zip(reversed(roles), reversed(costs[:-1]), strict=True):
        states.append(int(np.argmin(before + COSTS[role][:, states[-1]])))
    return states[::-1]


def _plain(text: str | None) -> str:
    """Message text whose own marks are no longer marks."""
    return (text or "").replace("<|", "< |")


def render(roles: list[int], texts: list[str | None], states: list[int], last: bool):
    """(turn number or None, action, role, cost, rendered piece); the pieces joined are the formatted conversation."""
    out = []

    def start(state: int, role: int, text: str) -> str:
        return ("<|end|>\n" if state else "") + f"<|{ROLES[role]}|>\n{text}\n"

    def insert(state: int, new: list[int]) -> int:
        for role in new:
            out.append((None, "insert", role, INSERT, start(state, role, "")))
            state = NEXT[state, role]
        return state

    for i, role in enumerate(roles):
        cost, action, new, inserted = STEPS[role][states[i]][states[i + 1]]
        state = insert(states[i], inserted)
        text = _plain(texts[i])
        out.append((i, action, new, cost - INSERT * len(inserted), text + "\n" if action == "merge" else start(state, new, text)))
    if last:
        insert(states[-1], WAYS[states[-1]][3][1])
        number, action, role, cost, piece = out[-1]
        out[-1] = (number, action, role, cost, piece + "<|end|>\n")
    return out


def _numbers(table: pa.Table) -> list[int]:
    return [role_number(r) for r in table.column("role").to_pylist()]


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by("place")


def _matrices(table: pa.Table) -> pa.Table:
    table = _sorted(table)
    return pa.table({"conv": table.column("conv")[:1], "segment": table.column("segment")[:1],
                     "values": pa.array([matrix(_numbers(table)).ravel().tolist()], pa.list_(pa.int64()))})


def _prefixes(table: pa.Table) -> pa.Table:
    """Least costs before each segment of a conversation, and after it."""
    table = table.sort_by("segment")
    costs, before, after = BEGIN, [], []
    for values in table.column("values").to_pylist():
        before.append(costs.tolist())
        costs = np.minimum((costs[:, None] + np.array(values).reshape(STATES, STATES)).min(0), FAR)
        after.append(costs.tolist())
    kind = pa.list_(pa.int64())
    return pa.table({"conv": table.column("conv"), "segment": table.column("segment"), "before": pa.array(before, kind), "after": pa.array(after, kind)})


def _entries(table: pa.Table) -> pa.Table:
    """State before a segment for each state after it."""
    table = _sorted(table)
    roles = _numbers(table)
    costs = forward(roles, np.array(table.column("before")[0].as_py()))
    entry = [backward(roles, costs, end)[0] for end in range(STATES)]
    return pa.table({"conv": table.column("conv")[:1], "segment": table.column("segment")[:1], "before": table.column("before")[:1],
                     "after": table.column("after")[:1], "entry": pa.array([entry], pa.list_(pa.int64()))})


def _exits(table: pa.Table) -> pa.Table:
    """The state after each segment, from the last to the first."""
    table = table.sort_by("segment")
    state = int(np.argmin(np.array(table.column("after")[-1].as_py()) + ENDING))
    out = []
    for entry in reversed(table.column("entry").to_pylist()):
        out.append(state)
        state = entry[state]
    n = table.num_rows
    return pa.table({"conv": table.column("conv"), "segment": table.column("segment"), "before": table.column("before"),
                     "exit": pa.array(out[::-1], pa.int32()), "last": pa.array([i == n - 1 for i in range(n)])})


def _rendered(table: pa.Table) -> pa.Table:
    table = _sorted(table)
    roles, prefix = _numbers(table), table.column("before")[0].as_py()
    costs = forward(roles, BEGIN if prefix is None else np.array(prefix))
    end, last = table.column("exit")[0].as_py(), table.column("last")[0].as_py()
    if prefix is None:  # the whole conversation
        end, last = int(np.argmin(costs[-1] + ENDING)), True
    rows = render(roles, table.column("text").to_pylist(), backward(roles, costs, end), last)
    turns, old = table.column("turn").to_pylist(), table.column("role").to_pylist()
    conv = table.column("conv")[0].as_py()
    n = len(rows)
    return pa.table({
        "conv_id": pa.array([None if conv == NO_ID else conv] * n, pa.int64()), "segment": pa.array([table.column("segment")[0].as_py()] * n, pa.int64()),
        "piece": pa.array(range(n), pa.int32()), "turn": pa.array([None if r[0] is None else turns[r[0]] for r in rows], pa.int64()),
        "action": pa.array([r[1] for r in rows], pa.string()), "old_role": pa.array([None if r[0] is None else old[r[0]] for r in rows], pa.string()),
        "role": pa.array([ROLES[r[2]] for r in rows], pa.string()), "cost": pa.array([r[3] for r in rows], pa.int32()),
        "rendered": pa.array([r[4] for r in rows], pa.string())})


def _segments(length: int):
    """Numbers the rows of a sorted partition: a segment is up to ``length`` turns of one conversation."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, n = None, 0
        for batch in batches:
            base = batch.column("part")[0].as_py() << 32 if batch.num_rows else 0
            segment, place = [], []
            for c in batch.column("conv").to_pylist():
                n = n + 1 if c == conv else 0
                conv = c
                segment.append(base + n // length)
                place.append(n)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv", "turn", "role", "text")), pa.array(segment, pa.int64()), pa.array(place, pa.int64())],
                                             names=["conv", "turn", "role", "text", "segment", "place"])
    return run


def repair(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Formatted conversations, one row per turn or inserted message, in order of (segment, piece) within a conv_id.

    ``turns`` has conv_id, turn, role and text. Turns are ordered by turn (null
    first), role and text, so repeated rows and ties have a fixed order. Each
    row has its action (keep, merge, relabel, insert), cost and rendered piece;
    the pieces in order are the conversation, the total cost is least. Unknown
    and null roles are relabelled, null texts are empty, marks inside texts are
    broken up; rows without conv_id form a conversation of their own. An empty
    table gives no rows; other columns are ignored.

    Turns are range-sorted by (conv_id, turn), so a conversation with a third
    of all rows spreads over partitions and is handled in segments. Only
    conversations with several segments take the four extra small rounds.
    """
    scratch = Scratch(turns.sparkSession, "chat")
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv", "turn", "role", "text"]
    cut = scratch.write(
        turns.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv"), F.col("turn").cast("long").alias("turn"),
                     F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
        .repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("long"))
        .mapInArrow(_segments(segment), "conv long, turn long, role string, text string, segment long, place long"), "segments")
    several = cut.groupBy("conv").agg(F.min("segment").alias("low"), F.max("segment").alias("high")).where("low < high").select("conv")
    narrow = cut.select("conv", "segment", "place", "role").join(several, "conv", "left_semi")
    pieces = "conv long, segment long, "
    products = narrow.groupBy("conv", "segment").applyInArrow(_matrices, pieces + "values array<long>")
    prefixes = scratch.write(products.groupBy("conv").applyInArrow(_prefixes, pieces + "before array<long>, after array<long>"), "prefixes")
    entries = narrow.join(prefixes, ["conv", "segment"]).groupBy("conv", "segment").applyInArrow(
        _entries, pieces + "before array<long>, after array<long>, entry array<long>")
    exits = scratch.write(entries.groupBy("conv").applyInArrow(_exits, pieces + "before array<long>, exit int, last boolean"), "exits")
    return cut.join(exits, ["conv", "segment"], "left").groupBy("conv", "segment").applyInArrow(_rendered, MESSAGES)
