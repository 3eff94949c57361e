"""Questions to research tasks and retrieval queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from groundline import config as C
from groundline.functions import text as T

# Fixed value: references that need the conversation before them.
ANAPHORA = (
    r"(?i)(?<![\p{L}\p{N}_])(it|this|that|they|them|these|those|the above|previous|former|latter)(?![\p{L}\p{N}_])"
    r"|^(它|这个|那个|这样|那样|为什么[？?]?|那)"
)


def unwrap_question(query: Column) -> Column:
    """Text after the first question marker when there is any, else the query itself."""
    at = F.instr(query, C.QUESTION_MARKER)
    rest = T.strip(F.substring(query, at + len(C.QUESTION_MARKER), F.length(query)))
    return F.when((at > 0) & (rest != ""), rest).otherwise(query)


def needs_context(query: Column) -> Column:
    flat = T.collapse(F.coalesce(query, F.lit("")))
    return (F.length(flat) < 24) | F.regexp_like(flat, F.lit(ANAPHORA))


def query_for_analysis(original: Column, wrapped: Column) -> Column:
    first = T.strip(F.coalesce(original, F.lit("")))
    full = T.strip(T.coalesce_text(wrapped, first))
    at = F.instr(full, C.QUESTION_MARKER)
    inner = T.strip(F.substring(full, at + len(C.QUESTION_MARKER), F.length(full)))
    current = F.when((at > 0) & (inner != ""), inner).otherwise(first)
    return F.when((full != current) & needs_context(current), full).otherwise(T.coalesce_text(current, full))


def fallback_task(query: Column) -> Column:
    """struct(task_type, expected_source_types, requires_comparison, requires_multiple_sources) by keywords."""
    low = F.lower(query)
    paper, repo = T.contains_any(low, C.PAPER_TERMS), T.contains_any(low, C.REPOSITORY_TERMS)
    compare, multi = T.contains_any(low, C.COMPARISON_TERMS), T.contains_any(low, C.MULTI_HOP_TERMS)
    both = paper & repo
    kind = (F.when(both, F.lit("PAPER_REPO_ANALYSIS")).when(compare, F.lit("COMPARISON"))
            .when(multi, F.lit("MULTI_HOP_RESEARCH")).otherwise(F.lit("FACT_LOOKUP")))
    expected = F.array_compact(F.array(
        F.when(paper, F.lit("paper")), F.when(repo, F.lit("repository")),
        F.when(T.contains_any(low, C.DOCUMENTATION_TERMS), F.lit("documentation"))))
    several = F.when(both, T.contains_any(low, C.MULTI_SOURCE_TERMS)).otherwise(compare | multi)
    return F.struct(kind.alias("task_type"), expected.alias("expected_source_types"),
                    (~both & compare).alias("requires_comparison"), several.alias("requires_multiple_sources"))


def normalize_task(tasks: DataFrame) -> DataFrame:
    """Defaults every parsed task gets: questions, comparison flag, forced source types."""
    forced = F.col("task_type") == "PAPER_REPO_ANALYSIS"
    return tasks.withColumns({
        "research_questions": F.when(F.size("research_questions") > 0, F.col("research_questions")).otherwise(F.array("query")),
        "requires_comparison": F.col("requires_comparison") | (F.col("task_type") == "COMPARISON"),
        "expected_source_types": F.when(forced, F.concat(
            "expected_source_types", F.array_except(T.strings(["paper", "repository"]), "expected_source_types")))
        .otherwise(F.col("expected_source_types")),
        "requires_multiple_sources": F.col("requires_multiple_sources") | forced,
    })


def is_comparison() -> Column:
    return F.col("requires_comparison") | (F.col("task_type") == "COMPARISON")


def _clean(queries: Column, max_queries: int | None) -> Column:
    stripped = F.transform(queries, lambda q: unwrap_question(T.strip(F.coalesce(q, F.lit("")))))
    found = F.array_distinct(F.filter(stripped, lambda q: q != ""))
    return found if max_queries is None else F.slice(found, 1, max_queries)


def normalize_queries(queries: Column, max_queries: int | None = None) -> Column:
    """Distinct non-blank queries in order, with a limit at most that many."""
    return _clean(queries, max_queries)


def retrieval_queries(max_queries: int | None = None) -> Column:
    """Queries of a task row: its questions, else its query.

    With a limit (``C.MAX_QUERIES_PER_TASK`` for a live system) at most that many, and of a fact lookup only the first.
    """
    asked = F.when(F.size("research_questions") > 0, F.col("research_questions")).otherwise(F.array("query"))
    few = asked if max_queries is None else F.when(F.col("task_type") == "FACT_LOOKUP", F.slice(asked, 1, 1)).otherwise(asked)
    found = _clean(few, max_queries)
    own = unwrap_question(T.strip("query"))
    return F.when(F.size(found) > 0, found).when(own != "", F.array(own)).otherwise(T.strings([]))


def task_queries(tasks: DataFrame, queries: Column | None = None, max_queries: int | None = None) -> DataFrame:
    """(task_id, query_no, query), one row per retrieval query."""
    listed = retrieval_queries(max_queries) if queries is None else normalize_queries(queries, max_queries)
    return tasks.select("task_id", F.posexplode(listed).alias("query_no", "query")).withColumn(
        "query_no", F.col("query_no").cast("long"))
