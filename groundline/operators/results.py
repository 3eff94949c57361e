"""Final answers, source lists, labels and prompt rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from groundline import config as C
from groundline.functions import text as T
from groundline.functions.rules import source_label
from groundline.operators.grounding import matching_ids


def gated_answer(answer: Column, sufficient: Column) -> Column:
    """The drafted answer only when its evidence was found sufficient."""
    return F.when(sufficient, answer).otherwise(F.lit(C.INSUFFICIENT_ANSWER))


def source_labels() -> Column:
    """Distinct labels of a case row: cited items first, then the pool."""
    cited = F.flatten(F.transform("claims", lambda c: c["evidence_ids"]))
    named = F.flatten(F.transform(cited, lambda e: F.filter("pool", lambda p: p["evidence_id"] == e)))
    labels = F.transform(F.concat(named, F.col("pool")), lambda p: source_label(p["meta_title"], p["source_title"], p["source_id"]))
    return F.array_distinct(F.array_compact(labels))


def sources_grouped(pool: DataFrame) -> DataFrame:
    """Per task and source in first-seen order: ordered distinct evidence ids and sections."""
    def listed(c: str) -> Column:
        kept = F.collect_list(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct("pos", F.col(c).alias("v"))))
        return F.array_distinct(F.transform(F.array_sort(kept), lambda x: x["v"]))

    return pool.groupBy("task_id", "source_id").agg(
        F.min("pos").alias("first_pos"), F.min_by("source_title", "pos").alias("source_title"),
        F.min_by("source_type", "pos").alias("source_type"),
        listed("evidence_id").alias("evidence_ids"), listed("section").alias("sections"))


def ids_by_source() -> Column:
    """map source_id -> evidence ids in pool order."""
    sources = F.array_distinct(F.transform("pool", lambda p: p["source_id"]))
    return F.map_from_entries(F.transform(sources, lambda s: F.struct(
        s, F.transform(F.filter("pool", lambda p: p["source_id"] == s), lambda p: p["evidence_id"]))))


def ids_by_entity() -> Column:
    """map entity -> matching evidence ids; entities without any are left out."""
    pairs = F.transform(F.array_distinct("entities"), lambda e: F.struct(e.alias("e"), matching_ids(e).alias("ids")))
    return F.map_from_entries(F.filter(pairs, lambda p: F.size(p["ids"]) > 0))


def prompt_payload() -> Column:
    """User message of the drafting prompt as JSON, NULL fields kept."""
    asked = F.when(F.size("research_questions") > 0, F.col("research_questions")).otherwise(F.array("query"))
    evidence = F.transform("pool", lambda p: F.struct(
        *[p[f].alias(f) for f in ("evidence_id", "source_id", "source_title", "section", "file_path", "symbol")],
        p["canonical_content"].alias("content")))
    payload = F.struct(
        F.struct("query", "task_type", "entities", asked.alias("research_questions"), "requires_comparison",
                 "requires_multiple_sources").alias("task"),
        evidence.alias("evidence"), ids_by_entity().alias("evidence_ids_by_entity"), ids_by_source().alias("evidence_ids_by_source"))
    return F.to_json(payload, {"ignoreNullFields": "false"})


def grounding_retry_prompt(message: Column) -> Column:
    """User message that asks for a corrected draft after a grounding failure."""
    return F.concat(
        F.lit("The draft broke a citation rule: "), message,
        F.lit("\nAnswer again with one JSON object and cite only ids from these lists.\nevidence_ids_by_entity="),
        F.to_json(ids_by_entity()), F.lit("\nevidence_ids_by_source="), F.to_json(ids_by_source()))


def assemble(case_rows: DataFrame, verifications: DataFrame) -> DataFrame:
    """(task_id, query, answer, status, sources) of finished runs."""
    return case_rows.join(verifications.select("task_id", "sufficient"), "task_id").select(
        "task_id", "query", gated_answer(F.col("answer"), F.col("sufficient")).alias("answer"), "sufficient",
        F.when(F.col("sufficient"), F.lit("success")).otherwise(F.lit("evidence_insufficient")).alias("status"),
        source_labels().alias("sources"))
