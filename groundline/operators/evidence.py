"""Hits to balanced evidence pools.

A pool is at most (queries × top_k) rows of one task, 20 by default, so windows
over task_id gather small groups only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from groundline import config as C
from groundline.functions import text as T
from groundline.functions.rules import source_type

def per_task():
    return Window.partitionBy("task_id")


def evidence_id(source: Column, chunk_id: Column, content: Column) -> Column:
    own = F.when(chunk_id.isNotNull(), chunk_id.cast("string")).otherwise(T.digest([source, content], 20))
    return F.concat(source, F.lit(":"), own)


def to_evidence(hits: DataFrame, retrieval_round: int = 1) -> DataFrame:
    """Search results (task_id, query_no, query, rank, …) as evidence rows.

    Missing provenance columns are filled with NULL; the title of an item is its
    source id, the document's own title stays in ``meta_title``.
    """
    def opt(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in hits.columns else F.lit(None).cast(kind)

    source = T.coalesce_text("source", F.lit("unknown-source"))
    return hits.select(
        "task_id", "query_no", "rank",
        evidence_id(source, F.col("chunk_id"), F.col("content")).alias("evidence_id"),
        source.alias("source_id"), source.alias("source_title"),
        source_type(source, opt("source_type"), opt("repository_url"), opt("commit"), opt("content_type")).alias("source_type"),
        opt("section").alias("section"), "content",
        T.coalesce_text(opt("content_en"), "content").alias("canonical_content"),
        T.coalesce_text(opt("content_zh"), "content").alias("display_content"),
        opt("content_zh").alias("translated_content"),
        F.col("score").cast("double").alias("score"), F.col("query").alias("query_used"),
        F.lit(retrieval_round).cast("long").alias("retrieval_round"), F.col("chunk_id").cast("string").alias("chunk_id"),
        opt("title").alias("meta_title"), opt("file_path").alias("file_path"),
        opt("repository_url").alias("repository_url"), opt("symbol").alias("symbol"),
        opt("retrieved_by", "array<string>").alias("retrieved_by"),
    )


def renumber(pool: DataFrame, *order) -> DataFrame:
    """Positions 1.. per task in the given order."""
    return pool.withColumn("pos", F.row_number().over(per_task().orderBy(*order)).cast("long"))


def unique_items(pool: DataFrame, *order) -> DataFrame:
    """First row per (task, evidence id) in the given order."""
    w = Window.partitionBy("task_id", "evidence_id").orderBy(*order)
    return pool.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def round_robin(evidence: DataFrame, limit: int | None = None) -> DataFrame:
    """Merge the queries of a task rank by rank, first occurrence of an item wins; with a limit cut there."""
    merged = renumber(unique_items(evidence, "rank", "query_no"), "rank", "query_no")
    return merged if limit is None else merged.filter(F.col("pos") <= limit)


def extend_pool(pool: DataFrame, more: DataFrame) -> DataFrame:
    """Append items whose id is new; existing items keep their place."""
    both = pool.withColumn("_side", F.lit(0)).unionByName(more.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    return renumber(unique_items(both, "_side", "pos"), "_side", "pos").drop("_side")


def prefer_expected_sources(pool: DataFrame, tasks: DataFrame, max_items: int = C.MAX_EVIDENCE) -> DataFrame:
    """Expected source types alone when there are enough of them, else in front."""
    named = pool.join(tasks.select("task_id", F.col("expected_source_types").alias("_exp")), "task_id")
    wanted = F.array_contains("_exp", F.col("source_type"))
    n = F.count_if(F.col("_pref")).over(per_task())
    flagged = named.withColumn("_pref", wanted).withColumn("_n", n)
    kept = flagged.filter((F.col("_n") < min(4, max_items)) | F.col("_pref"))
    front = F.when(F.col("_n") == 0, F.lit(0)).when(F.col("_pref"), F.lit(0)).otherwise(F.lit(1))
    return renumber(kept.withColumn("_front", front), "_front", "pos").drop("_exp", "_pref", "_n", "_front")


def provenance() -> Column:
    """Names an item can be recognized by, letters and digits only."""
    fields = ("source_id", "source_title", "meta_title", "repository_url", "file_path")
    return T.alnum(F.concat_ws(" ", *[F.coalesce(F.col(f), F.lit("")) for f in fields]))


def selector_provenance() -> Column:
    """The same names in the order the selector joins them."""
    fields = ("source_id", "source_title", "meta_title", "file_path", "repository_url")
    return T.alnum(F.concat_ws(" ", *[F.coalesce(F.col(f), F.lit("")) for f in fields]))


def prefer_entity_sources(pool: DataFrame, tasks: DataFrame) -> DataFrame:
    """Only items naming an entity, unless none does or a comparison would lose an entity."""
    wanted = F.transform(F.filter("entities", lambda e: T.strip(e) != ""), T.alnum)
    named = pool.join(tasks.select("task_id", wanted.alias("_ents"), F.col("requires_comparison").alias("_cmp")), "task_id")
    hits = F.filter("_ents", lambda e: (e != "") & F.contains(F.col("_prov"), e))
    matched = named.withColumn("_prov", provenance()).withColumn("_hits", hits)
    covered = F.size(F.array_except("_ents", F.flatten(F.collect_set("_hits").over(per_task())))) == 0
    some = F.count_if(F.size("_hits") > 0).over(per_task()) > 0
    narrow = some & (~F.col("_cmp") | covered)
    kept = matched.withColumn("_narrow", narrow).filter(~F.col("_narrow") | (F.size("_hits") > 0))
    return renumber(kept, "pos").drop("_ents", "_cmp", "_prov", "_hits", "_narrow")


# ---- selection ---------------------------------------------------------------------------

def text_quality(content: Column) -> dict[str, Column]:
    """Length, line ratios and author markers of an item's text."""
    text = T.strip(content)
    rows = T.lines(text)
    n = F.size(rows)
    short = F.size(F.filter(rows, lambda r: F.length(r) <= 30))
    numeric = F.size(F.filter(rows, lambda r: F.regexp_like(r, F.lit(r"^[\p{Nd}.%+\-()]+$"))))
    low = F.lower(text)
    markers = T.reduce(lambda a, b: a + b, [F.contains(low, F.lit(m)).cast("int") for m in C.AUTHOR_MARKERS])
    return {
        "n_chars": F.length(text).cast("long"),
        "short_ratio": F.when(n > 0, short / n).otherwise(F.lit(0.0)),
        "numeric_ratio": F.when(n > 0, numeric / n).otherwise(F.lit(0.0)),
        "markers": markers.cast("long"),
    }


def with_scores(pool: DataFrame, tasks: DataFrame) -> DataFrame:
    """Add overlap, entity_match, penalty and select_score to pool rows."""
    asked = tasks.select(
        "task_id",
        T.selector_tokens(F.concat_ws(" ", "query", F.array_join("research_questions", " "))).alias("_qt"),
        T.contains_any(F.lower("query"), C.RESULT_TERMS).alias("_results"),
        F.transform("entities", T.alnum).alias("_ents"), F.col("requires_multiple_sources").alias("_multi"),
    )
    tokens = F.array_distinct(T.selector_tokens("content"))
    rows = pool.join(asked, "task_id").withColumns({"_ct": tokens, "_prov": selector_provenance()} | {
        f"_{k}": v for k, v in text_quality(F.col("content")).items()})
    qt = F.size(F.array_distinct("_qt"))
    overlap = F.when((qt == 0) | (F.size("_ct") == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect("_qt", "_ct")) / qt)
    entity = F.exists("_ents", lambda e: (e != "") & F.contains(F.col("_prov"), e)).cast("double")
    penalty = F.when(F.col("_n_chars") == 0, F.lit(0.5)).otherwise(F.least(
        F.lit(0.5),
        F.when(F.col("_n_chars") < 300, F.lit(0.10)).otherwise(F.lit(0.0))
        + F.when(~F.col("_results") & (F.col("_short_ratio") >= 0.5), F.lit(0.30)).otherwise(F.lit(0.0))
        + F.when(~F.col("_results") & (F.col("_numeric_ratio") >= 0.15), F.lit(0.20)).otherwise(F.lit(0.0))
        + F.when(F.col("_markers") >= 3, F.lit(0.15)).otherwise(F.lit(0.0))))
    scored = rows.withColumns({"overlap": overlap, "entity_match": entity, "penalty": penalty})
    total = (C.SELECT_SCORE * F.coalesce("score", F.lit(0.0)) + C.SELECT_OVERLAP * F.col("overlap")
             + C.SELECT_ENTITY * F.col("entity_match") - F.col("penalty"))
    return scored.withColumn("select_score", total)


def target_sources(ranked: Column, entities: Column) -> Column:
    """Sources to reserve evidence for, in order.

    ``ranked`` is the array of struct(source_id, prov) in score order. Entity by
    entity the first matching item of a source not yet taken adds that source;
    with fewer than two, all other sources follow in rank order.
    """
    def take(taken, entity):
        open_items = F.filter(ranked, lambda r: (entity != "") & F.contains(r["prov"], entity)
                              & ~F.array_contains(taken, r["source_id"]))
        return F.concat(taken, F.slice(F.transform(open_items, lambda r: r["source_id"]), 1, 1))

    matched = F.aggregate(entities, T.strings([]), take)
    every = F.transform(ranked, lambda r: r["source_id"])
    return F.when(F.size(matched) >= 2, matched).otherwise(F.array_distinct(F.concat(matched, every)))


def select_evidence(pool: DataFrame, tasks: DataFrame, max_items: int = C.MAX_EVIDENCE) -> DataFrame:
    """Final pool: reserved items of the target sources first, then the best others."""
    ranked = renumber(with_scores(pool, tasks), F.round("select_score", 9).desc(), "pos")
    whole = per_task().orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    listed = ranked.withColumn("_r", F.collect_list(F.struct("source_id", F.col("_prov").alias("prov"))).over(whole))
    rows = listed.withColumn("_targets", F.when(F.col("_multi"), target_sources(F.col("_r"), F.col("_ents"))).otherwise(T.strings([])))
    n = F.size("_targets")
    per_source = F.greatest(F.lit(1), F.least(F.lit(2), F.floor(F.lit(max_items) / F.greatest(n, F.lit(1)))))
    within = F.row_number().over(Window.partitionBy("task_id", "source_id").orderBy("pos"))
    place = F.array_position("_targets", F.col("source_id"))
    rows = rows.withColumn("_within", within).withColumn(
        "_reserved", F.coalesce((n >= 2) & (place > 0) & (F.col("_within") <= per_source), F.lit(False)))
    order = [(~F.col("_reserved")).cast("int"), F.when(F.col("_reserved"), place).otherwise(F.lit(0)), F.col("pos")]
    done = renumber(rows, *order).filter(F.col("pos") <= max_items)
    return done.select(*[c for c in done.columns if not c.startswith("_")])


def interleave_repair(pool: DataFrame, max_items: int = C.MAX_EVIDENCE) -> DataFrame:
    """A pool above ``max_items`` alternates second-round and earlier items, second round first."""
    second = F.col("retrieval_round") == 2
    rows = pool.withColumns({"_n": F.count("*").over(per_task()), "_old": (~second).cast("int")})
    turn = F.row_number().over(Window.partitionBy("task_id", "_old").orderBy("pos"))
    rows = rows.withColumn("_turn", turn)
    order = [F.when(F.col("_n") > max_items, F.col("_turn")).otherwise(F.col("pos")),
             F.when(F.col("_n") > max_items, F.col("_old")).otherwise(F.lit(0))]
    return renumber(rows, *order).filter(F.col("pos") <= max_items).drop("_n", "_old", "_turn")
