"""Role repair against exhaustive search."""

import itertools
import random

import pytest

from groundline.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, part string, place long"


def least_cost(roles):
    """Cheapest total over all ways, by brute recursion."""
    def go(i, state, spare):
        best = chat.FAR
        if i == len(roles):
            return 0 if state == 3 else (best if not spare else min(
                (chat.INSERT + go(i, to, spare - 1) for (at, _), to in chat.NEXT.items() if at == state), default=best))
        for at, after, cost, _, _ in chat.actions(chat.role_number(roles[i])):
            if at == state:
                best = min(best, cost + go(i + 1, after, 2))
        if spare:
            best = min([best] + [chat.INSERT + go(i, to, spare - 1) for (at, _), to in chat.NEXT.items() if at == state])
        return best
    return go(0, 0, 2)


def conversations(spark, rows, segment=chat.SEGMENT):
    out = chat.repair(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), segment).collect()
    found = {}
    for r in sorted(out, key=lambda r: (r.conv_id is not None, r.conv_id, r.segment, r.piece)):
        found.setdefault(r.conv_id, []).append(r)
    return found


def legal(rendered):
    roles = [line[2:-2] for line in rendered.split("\n") if line in ("<|system|>", "<|user|>", "<|assistant|>")]
    state = 0
    for role in roles:
        state = chat.NEXT[state, chat.ROLES.index(role)]
    return state == 3 and rendered.endswith("<|end|>\n")


def test_costs_and_legality(spark):
    roles = ["system", "user", "assistant", "tool"]
    cases = [list(c) for n in range(1, 5) for c in itertools.product(roles, repeat=n)]
    rows = [(c, i, r, f"t{i}") for c, case in enumerate(cases) for i, r in enumerate(case)]
    found = conversations(spark, rows)
    assert len(found) == len(cases)
    for c, case in enumerate(cases):
        pieces = found[c]
        assert sum(p.cost for p in pieces) == least_cost(case), case
        assert legal("".join(p.rendered for p in pieces))
        assert [p.turn for p in pieces if p.turn is not None] == list(range(len(case)))


@pytest.mark.parametrize("segment", [1, 3, 7])
def test_segments_change_nothing(spark, segment):
    random.seed(segment)
    rows = [(c, i, random.choice(["system", "user", "assistant", None]), f"{c}.{i}") for c in range(8) for i in range(random.randrange(1, 40))]
    whole, cut = conversations(spark, rows), conversations(spark, rows, segment)
    for c in whole:
        assert [p[3:] for p in whole[c]] == [p[3:] for p in cut[c]]


def test_edges(spark):
    rows = [(None, None, None, None), (1, 0, " User ", "<|end|> a"), (1, 0, " User ", "<|end|> a"), (2, 5, "assistant", "x" * 200_000)]
    found = conversations(spark, rows)
    assert set(found) == {None, 1, 2}
    assert [p.action for p in found[1]] == ["keep", "merge", "insert"]
    assert "".join(p.rendered for p in found[1]) == "<|user|>\n< |end|> a\n< |end|> a\n<|end|>\n<|assistant|>\n\n<|end|>\n"
    assert [p.action for p in found[2]] == ["insert", "keep"]
    assert conversations(spark, []) == {}


def test_whole_table(spark, data):
    rows = spark.read.parquet(f"{data}/conversations.parquet")
    from groundline.llm.catalogue import QUERIES
    out = QUERIES["op9_chat_repair"](spark, data)
    assert out.where("turn is not null").count() == rows.count()
    total = {}
    for r in rows.collect():
        total.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    cost = {r[0]: r[1] for r in out.groupBy("conv_id").agg({"cost": "sum"}).collect()}
    for c, turns in total.items():
        assert cost[c] == least_cost([t[1] for t in sorted(turns)][:12]) or len(turns) > 12
