"""Tasks to evidence pools, including the second retrieval round."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from groundline import config as C
from groundline.operators import evidence as E
from groundline.operators.tasks import task_queries
from groundline.plans.retrieval import SearchTables, retrieve
from groundline.session import materialize


#: Adds ``embedding`` to query rows: a join with stored vectors, or ``functions.models.embed`` on the query.
Embedder = Callable[[DataFrame], DataFrame]


def retrieve_for_tasks(tables: SearchTables, asked: DataFrame, top_k: int = C.RESEARCH_TOP_K, embed: Embedder | None = None) -> DataFrame:
    """Hits for (task_id, query_no, query[, embedding]) rows; a query without a vector is answered by BM25 alone."""
    keyed = (asked if embed is None else embed(asked)).withColumn("query_id", F.concat_ws("#", "task_id", F.col("query_no").cast("string")))
    if "embedding" not in keyed.columns:
        keyed = keyed.withColumn("embedding", F.lit(None).cast("array<float>"))
    keyed = materialize(keyed, "task-queries")
    hits = retrieve(tables, keyed, top_k)
    return hits.join(keyed.select("query_id", "task_id", "query_no", "query"), "query_id").drop("query_id")


def narrow(pool: DataFrame, tasks: DataFrame, max_items: int) -> DataFrame:
    return E.prefer_entity_sources(E.prefer_expected_sources(pool, tasks, max_items), tasks)


def research(tables: SearchTables, tasks: DataFrame, asked: DataFrame | None = None, *, retrieval_round: int = 1,
             top_k: int = C.RESEARCH_TOP_K, max_items: int = C.MAX_EVIDENCE, merge_limit: int | None = None,
             embed: Embedder | None = None) -> DataFrame:
    """Evidence pool per task: retrieve, merge, prefer, select; only the selection cuts, unless ``merge_limit`` is given."""
    hits = retrieve_for_tasks(tables, task_queries(tasks) if asked is None else asked, top_k, embed)
    merged = E.round_robin(E.to_evidence(hits, retrieval_round), merge_limit)
    return E.select_evidence(narrow(merged, tasks, max_items), tasks, max_items)


def repair(tables: SearchTables, tasks: DataFrame, pool: DataFrame, verifications: DataFrame, *,
           top_k: int = C.RESEARCH_TOP_K, max_items: int = C.MAX_EVIDENCE, embed: Embedder | None = None) -> DataFrame:
    """Pools after a second round on the suggested queries; tasks without any keep theirs."""
    asked = task_queries(verifications, F.col("suggested_queries"))
    second = materialize(research(tables, tasks, asked, retrieval_round=2, top_k=top_k, max_items=max_items, embed=embed), "second-pool")
    return merge_repair(pool, second, asked, tasks, max_items)


def merge_repair(pool: DataFrame, second: DataFrame, asked: DataFrame, tasks: DataFrame,
                 max_items: int = C.MAX_EVIDENCE) -> DataFrame:
    """Extend, prefer again, interleave; tasks that asked nothing pass through."""
    keep = [c for c in pool.columns if c in second.columns]
    todo = asked.select("task_id").distinct()
    mine = pool.select(*keep).join(todo, "task_id", "left_semi")
    merged = E.extend_pool(mine, second.select(*keep).join(todo, "task_id", "left_semi"))
    done = E.interleave_repair(narrow(merged, tasks, max_items), max_items)
    return done.unionByName(pool.select(*keep).join(todo, "task_id", "left_anti"))
