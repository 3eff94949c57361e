"""Tasks to gated answers in one plan; model outputs come in as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from groundline import config as C
from groundline.operators import grounding as G
from groundline.operators.results import assemble
from groundline.plans.research import Embedder, research
from groundline.plans.retrieval import SearchTables
from groundline.session import materialize


def answer_runs(tables: SearchTables, tasks: DataFrame, drafts: Callable[[DataFrame], DataFrame],
                verdicts: Callable[[DataFrame], DataFrame], *, max_items: int = C.MAX_EVIDENCE,
                embed: Embedder | None = None) -> DataFrame:
    """Retrieve, draft, check, verify and gate for a table of tasks.

    ``drafts(pool)`` supplies (task_id, attempt, raw) rows with the model's text, or
    (task_id, attempt, answer, claims); ``verdicts(cases)`` adds raw_verdict, or
    the verification columns. Both stand for offline inference over the pool. ``embed`` gives the queries their vectors.
    """
    pool = materialize(research(tables, tasks, max_items=max_items, embed=embed), "pool")
    outcomes = G.draft_outcomes(G.cases(tasks, pool, G.with_draft(drafts(pool)), how="left"))
    checked = G.with_verdict(verdicts(G.cases(tasks, pool, outcomes.select("task_id", "answer", "claims", "outcome"))))
    final = assemble(checked.drop("sufficient"), G.verify(checked))
    extra = checked.select("task_id", "outcome", F.array_distinct(F.transform("pool", lambda p: p["source_id"])).alias("pool_sources"))
    return final.join(extra, "task_id")
