"""Catalogue: drafts, grounding checks, verification and results."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundline import config as C
from groundline.catalogue import base as B
from groundline.catalogue import evidence as EV
from groundline.functions import rules
from groundline.functions import text as T
from groundline.operators import evidence as E
from groundline.operators import grounding as G
from groundline.operators import results as O
from groundline.plans import research as R
from groundline.plans.answers import answer_runs


# ---- input views ----------------------------------------------------------------------------

def pool(spark, d):
    return E.round_robin(EV.evidence(spark, d), C.MAX_EVIDENCE)


def drafts_for(tasks, pool_df):
    """Two draft attempts per task with one planted defect per item number."""
    ids = pool_df.groupBy("task_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "evidence_id"))), lambda x: x["evidence_id"]).alias("ids"))
    base = tasks.select("task_id", "item_id", "query", "entities", "research_questions").join(ids, "task_id").selectExpr(
        "task_id", "item_id", "query", "ids",
        """transform(research_questions, (s, j) -> named_struct('claim_id', concat('c', j + 1),
             'text', concat(s, coalesce(concat(' (', get(entities, j), ')'), '')), 'evidence_ids', array(get(ids, j % size(ids))))) AS good""")
    attempts = base.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt")).withColumn(
        "defect", F.expr("CASE WHEN attempt = 2 AND item_id % 3 = 0 THEN 0 ELSE item_id % 10 END"))
    return attempts.selectExpr(
        "task_id", "item_id", "attempt",
        """CASE defect WHEN 2 THEN '  ' WHEN 3 THEN '...' WHEN 4 THEN 'TBD pending work' WHEN 5 THEN 'Too short'
             WHEN 7 THEN 'There is insufficient evidence to answer.' WHEN 9 THEN array_join(transform(good, c -> c.text), ' ')
             ELSE concat(query, ' In summary.') END AS answer""",
        """CASE defect WHEN 1 THEN transform(good, (c, j) -> named_struct('claim_id', c.claim_id, 'text', c.text,
               'evidence_ids', CASE WHEN j = 0 THEN array_append(c.evidence_ids, 'missing-1') ELSE c.evidence_ids END))
             WHEN 8 THEN transform(good, c -> named_struct('claim_id', c.claim_id, 'text', c.text, 'evidence_ids', concat(c.evidence_ids, c.evidence_ids)))
             WHEN 6 THEN slice(good, 1, 0) WHEN 7 THEN slice(good, 1, 0) ELSE good END AS claims""")


def attempts(spark, d):
    return drafts_for(EV.tasks(spark, d), pool(spark, d))


def first_drafts(spark, d):
    return attempts(spark, d).filter("attempt = 1").drop("item_id", "attempt")


def case_rows(spark, d, *extra):
    return G.cases(EV.tasks(spark, d), pool(spark, d), first_drafts(spark, d), *extra)


def verdicts(cases):
    """A model verdict per case; some contradict themselves."""
    first = F.expr("get(claims, 0)")
    return cases.withColumns({
        "sufficient": F.expr("item_id % 2 = 1"),
        "supported_points": F.when(F.expr("item_id % 2 = 1 AND item_id % 7 <> 0"), F.array(F.lit("point"))).otherwise(T.strings([])),
        "missing_points": F.when(F.expr("item_id % 2 = 0"), F.array(F.lit("gap"), F.lit("gap"))).otherwise(T.strings([])),
        "weak_evidence_ids": F.when(F.expr("item_id % 14 = 0"), F.array(F.lit("bogus")))
        .when(F.expr("item_id % 2 = 0"), F.coalesce(first["evidence_ids"], T.strings([]))).otherwise(T.strings([])),
        "suggested_queries": F.when(F.expr("item_id % 4 = 0"), F.array(F.col("answer"), F.lit(" more on it "), F.lit("more on it"), F.lit("")))
        .otherwise(F.array(F.col("answer"))),
        "reason": F.lit("checked"),
    })


# ---- queries ----------------------------------------------------------------------------------

def claim_explode(spark, d):
    rows = G.explode_claims(first_drafts(spark, d))
    flags = first_drafts(spark, d).select(
        "task_id", F.expr("size(array_distinct(claims.claim_id)) = size(claims)").alias("ids_unique"),
        F.exists("claims", lambda c: F.size(c["evidence_ids"]) != F.size(F.array_distinct(c["evidence_ids"]))).alias("cites_twice"))
    return rows.join(flags, "task_id")


def unknown_citations(spark, d):
    return G.unknown_citations(first_drafts(spark, d), pool(spark, d)).select("task_id", "claim_pos", "cite_pos", "evidence_id")


def cited_sources(spark, d):
    hit = G.cited_evidence(first_drafts(spark, d), pool(spark, d))
    return hit.groupBy("task_id").agg(
        F.count("*").alias("n_citations"), F.count_distinct("source_id").alias("n_sources"),
        (F.count_distinct("source_id") >= 2).alias("multiple"))


def entity_coverage(spark, d):
    rows = case_rows(spark, d).select("task_id", F.posexplode(G.entity_coverage()).alias("entity_pos", "e"),)
    return rows.select("task_id", F.col("entity_pos").cast("long").alias("entity_pos"), "e.entity",
                       F.col("e.matching").cast("long").alias("matching"), F.col("e.named").cast("long").alias("named"), "e.cited")


def claim_entity_check(spark, d):
    return case_rows(spark, d).select("task_id", F.array_join(G.claim_entity_violations(), "; ").alias("violations"))


def draft_reason(spark, d):
    v = G.validation()
    return attempts_cases(spark, d).select(
        "task_id", "attempt", v["reason"].alias("reason"), v["message"].alias("message"), G.is_refusal().alias("refusal"),
        G.is_claim_concatenation().alias("concatenated"), T.has_chinese("answer").alias("chinese"),
        G.normalized_reason(F.lit("ValueError"), v["message"]).alias("normalized"))


def attempts_cases(spark, d):
    return G.cases(EV.tasks(spark, d), pool(spark, d), attempts(spark, d).drop("item_id"))


def grounding_violations(spark, d):
    return attempts_cases(spark, d).select("task_id", "attempt", G.grounding_message().alias("message"))


def draft_outcome(spark, d):
    return G.draft_outcomes(attempts_cases(spark, d)).select(
        "task_id", T.sha("answer").alias("sha"), F.size("claims").cast("long").alias("n_claims"), "outcome", "draft_validation_failure",
        "original_validation_reason", "repair_validation_reason", "draft_repair_attempts", "draft_repair_success",
        "fallback_used", "evidence_insufficient", "failure_stage", "error_type", "result_status")


def retry_kinds(spark, d):
    rows = G.with_attempt_result(attempts_cases(spark, d)).withColumn("m", F.col("r.message"))
    raw = F.concat(F.lit("{"), F.col("answer"))
    return rows.select("task_id", "attempt", G.retry_kind(raw, F.coalesce("m", F.lit(""))).alias("retry"))


def _verification(df):
    return df.select("task_id", "sufficient", *[F.array_join(c, "|").alias(c) for c in (
        "supported_points", "missing_points", "weak_evidence_ids", "suggested_queries")], "reason")


def verify_preflight(spark, d):
    rows = case_rows(spark, d).select("task_id", G.preflight().alias("v")).filter("v IS NOT NULL")
    return _verification(rows.select("task_id", "v.*"))


def verify_cleanup(spark, d):
    return _verification(verdicts(case_rows(spark, d)).select("task_id", G.verified().alias("v")).select("task_id", "v.*"))


def answer_gate(spark, d):
    rows = verdicts(case_rows(spark, d))
    v = G.verify(rows)
    return O.assemble(rows.drop("sufficient"), v).select("task_id", T.sha("answer").alias("sha"), "status", F.array_join("sources", "|").alias("sources"))


def model_json(spark, d):
    """Every document as the answer of a draft in model text: fenced, after a broken brace, cut off, without a brace, of the wrong type, or followed by prose."""
    k = F.col("doc_id") % 6
    text = F.concat(F.lit("t"), F.coalesce("text", F.lit("")))
    whole = F.to_json(F.struct(text.alias("answer"), F.array(F.struct(F.lit("c1").alias("claim_id"), F.col("source").alias("text"), F.array(F.lit("e1"), F.lit("e2")).alias("evidence_ids"))).alias("claims")))
    raw = (F.when(k == 0, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).when(k == 1, F.concat(F.lit('so {"a": {x} and '), whole)).when(k == 2, F.expr("'{' || repeat('{\"a\":', 500)"))
           .when(k == 3, F.translate("text", "{", "(")).when(k == 4, F.to_json(F.struct(F.lit(4).alias("answer"), text.alias("note")))).otherwise(F.concat(F.lit("Here: "), whole, F.lit(' {"answer": "no"} }'))))
    rows = B.table(spark, d, "documents").select("doc_id", raw.alias("raw"))
    return G.with_draft(rows).select("doc_id", T.sha("answer").alias("sha"), F.get(F.col("claims.text"), 0).alias("claim"),
                                     F.size(F.flatten("claims.evidence_ids")).cast("long").alias("n_citations"), "parse_error")


def source_labels(spark, d):
    return case_rows(spark, d).select("task_id", F.posexplode(O.source_labels()).alias("label_pos", "label")).withColumn(
        "label_pos", F.col("label_pos").cast("long"))


def sources_grouped(spark, d):
    return O.sources_grouped(EV.merged(spark, d)).select(
        "task_id", "source_id", "first_pos", "source_title", "source_type",
        F.array_join("evidence_ids", ",").alias("evidence_ids"), F.array_join("sections", ",").alias("sections"))


def evidence_id_maps(spark, d):
    rows = case_rows(spark, d)
    by = rows.select("task_id", F.lit("source").alias("kind"), F.explode(O.ids_by_source()).alias("name", "ids")).unionByName(
        rows.select("task_id", F.lit("entity").alias("kind"), F.explode(O.ids_by_entity()).alias("name", "ids")))
    return by.select("kind", "task_id", "name", F.array_join("ids", ",").alias("ids"))


def prompt_payload(spark, d):
    rows = case_rows(spark, d, "section", "file_path", "symbol", "canonical_content").withColumn("p", O.prompt_payload())
    return rows.select(
        "task_id", F.get_json_object("p", "$.task.query").alias("query"), F.get_json_object("p", "$.task.task_type").alias("task_type"),
        F.json_array_length(F.get_json_object("p", "$.evidence")).cast("long").alias("n_evidence"),
        F.get_json_object("p", "$.evidence[0].evidence_id").alias("first_id"),
        T.sha(F.get_json_object("p", "$.evidence[0].content")).alias("first_sha"),
        F.json_array_length(F.get_json_object("p", "$.task.research_questions")).cast("long").alias("n_questions"))


def answer_run(spark, d):
    """Question to gated answer: retrieval, pool, draft attempts, verification, result."""
    tasks = EV.tasks(spark, d)
    done = answer_runs(B.search_tables(spark, d), tasks, lambda p: drafts_for(tasks, p).drop("item_id"), verdicts, embed=EV.query_vectors(spark, d))
    return done.select("task_id", T.sha("answer").alias("sha"), "status", "outcome", F.array_join("sources", "|").alias("sources"),
                       F.size("pool_sources").cast("long").alias("n_pool_sources"))


QUERIES = {f.__name__: f for f in (
    claim_explode, unknown_citations, cited_sources, entity_coverage, claim_entity_check, draft_reason, grounding_violations,
    draft_outcome, retry_kinds, verify_preflight, verify_cleanup, answer_gate, model_json, source_labels, sources_grouped, evidence_id_maps,
    prompt_payload, answer_run)}

# ---- the same in SQL ------------------------------------------------------------------------------

V, N = B.VIEWS, B.NEEDS
_q = "chr(39)"
_squeeze = lambda x: f"trim(regexp_replace({x}, '{T.WS}+', '', 'g'), '{T.EDGE_MARKS}')"


def case_views(p: str, pool_view: str) -> None:
    """Drafts and case rows over a pool view (task_id, pos, evidence_id, source, title, prov)."""
    V[f"{p}ids"] = f"""SELECT task_id, list(evidence_id ORDER BY pos) AS ids, list({{'id': evidence_id, 'source': source, 'title': title, 'prov': prov}} ORDER BY pos) AS pool
      FROM {pool_view} GROUP BY task_id"""
    V[f"{p}good"] = f"""SELECT t.*, ids, pool, list_transform(rq, lambda s, j: {{'claim_id': 'c' || j,
        'text': s || CASE WHEN j <= len(entities) THEN ' (' || entities[j] || ')' ELSE '' END, 'ev': [ids[(j - 1) % len(ids) + 1]]}}) AS good
      FROM tasks t JOIN {p}ids USING (task_id)"""
    V[f"{p}att"] = f"""SELECT * EXCLUDE (good), CASE defect WHEN 2 THEN '  ' WHEN 3 THEN '...' WHEN 4 THEN 'TBD pending work' WHEN 5 THEN 'Too short'
        WHEN 7 THEN 'There is insufficient evidence to answer.' WHEN 9 THEN array_to_string(list_transform(good, lambda c: c.text), ' ')
        ELSE query || ' In summary.' END AS answer,
        CASE defect WHEN 1 THEN list_transform(good, lambda c, j: {{'claim_id': c.claim_id, 'text': c.text, 'ev': CASE WHEN j = 1 THEN list_append(c.ev, 'missing-1') ELSE c.ev END}})
          WHEN 8 THEN list_transform(good, lambda c: {{'claim_id': c.claim_id, 'text': c.text, 'ev': list_concat(c.ev, c.ev)}})
          WHEN 6 THEN good[1:0] WHEN 7 THEN good[1:0] ELSE good END AS claims
      FROM (SELECT *, CASE WHEN attempt = 2 AND item_id % 3 = 0 THEN 0 ELSE item_id % 10 END AS defect
        FROM (SELECT *, unnest([1, 2]) AS attempt FROM {p}good))"""
    V[f"{p}first"] = f"SELECT * FROM {p}att WHERE attempt = 1"
    # claims in long form
    V[f"{p}cl"] = f"""SELECT task_id, attempt, item_id, ids, pool, entities, j - 1 AS claim_pos, claims[j].claim_id AS claim_id, claims[j].text AS text, claims[j].ev AS ev
      FROM (SELECT *, unnest(range(1, len(claims) + 1)) AS j FROM {p}att)"""
    # per claim problem
    unk = "list_filter(ev, lambda e: NOT list_contains(ids, e))"
    pyl = "'[' || array_to_string(list_transform({x}, lambda u: chr(39) || u || chr(39)), ', ') || ']'"
    V[f"{p}clp"] = f"""SELECT *, CASE WHEN len(ev) <> len(list_distinct(ev)) THEN 'duplicate evidence_id in claim'
          WHEN len({unk}) > 0 THEN 'unknown evidence ids: ' || {pyl.format(x=f'list_sort(list_distinct({unk}))')} END AS problem,
        CASE WHEN len({unk}) > 0 THEN 'unknown evidence ids: ' || {pyl.format(x=f'list_sort({unk})')} END AS vproblem FROM {p}cl"""
    V[f"{p}ent"] = f"""SELECT task_id, attempt, i - 1 AS entity_pos, entities[i] AS entity, mids, len(mids) AS matching, about,
        len(list_filter(about, lambda c: len(list_intersect(c.ev, mids)) > 0)) > 0 AS cited
      FROM (SELECT *, list_transform(list_filter(pool, lambda p: name <> '' AND contains(p.prov, name)), lambda p: p.id) AS mids,
          list_filter(claims, lambda c: contains({B.d_alnum('c.text')}, name)) AS about
        FROM (SELECT *, {B.d_alnum('entities[i]')} AS name FROM (SELECT *, unnest(range(1, len(entities) + 1)) AS i FROM {p}att)))"""
    V[f"{p}msg"] = f"""SELECT a.*, CASE
          WHEN len(claims) = 0 AND NOT {B.d_any('lower(answer)', C.INSUFFICIENCY_DRAFT)} THEN 'uncited answer without an insufficiency statement'
          WHEN len(claims) > 0 AND {_squeeze('answer')} <> '' AND {_squeeze('answer')} = array_to_string(list_transform(claims, lambda c: {_squeeze('c.text')}), '') THEN 'answer must synthesize rather than concatenate claim text'
          WHEN cp IS NOT NULL THEN cp
          WHEN is_cmp AND nsrc < 2 THEN 'comparison draft must cite multiple sources'
          WHEN is_cmp THEN ep END AS message
      FROM (SELECT *, cmp OR task_type = 'COMPARISON' AS is_cmp, len(list_distinct(list_transform(list_filter(pool, lambda p: list_contains(flatten(list_transform(claims, lambda c: c.ev)), p.id)), lambda p: p.source))) AS nsrc FROM {p}att) a
      LEFT JOIN (SELECT task_id, attempt, arg_min(problem, claim_pos) AS cp FROM {p}clp WHERE problem IS NOT NULL GROUP BY ALL) USING (task_id, attempt)
      LEFT JOIN (SELECT task_id, attempt, arg_min(problem, entity_pos) AS ep FROM (SELECT *, CASE WHEN matching > 0 AND len(about) = 0 THEN 'comparison draft does not separately cover entity ' || {_q} || entity || {_q}
            WHEN matching > 0 AND NOT cited THEN 'comparison entity ' || {_q} || entity || {_q} || ' lacks matching cited evidence' END AS problem FROM {p}ent)
          WHERE problem IS NOT NULL GROUP BY ALL) USING (task_id, attempt)"""
    refusal = f"trim(answer) <> '' AND len(claims) = 0 AND {B.d_any('lower(answer)', C.INSUFFICIENCY_VALIDATOR)}"
    V[f"{p}val"] = f"""SELECT *, split_part(rm, '#', 1) AS vreason, substring(rm, strpos(rm, '#') + 1) AS vmessage FROM (SELECT a.*, {refusal} AS refusal, CASE
          WHEN trim(answer) = '' THEN 'empty_output#draft answer is empty'
          WHEN trim(answer) IN ('...', '…', '⋯') THEN 'placeholder_output#draft answer is ellipsis'
          WHEN regexp_matches(answer, '(?i)(^|[^\\p{{L}}\\p{{N}}_])(tbd|xxx)([^\\p{{L}}\\p{{N}}_]|$)') THEN 'placeholder_output#draft contains TBD/xxx placeholder'
          WHEN {refusal} THEN NULL
          WHEN length(trim(answer)) < 12 THEN 'too_short#draft answer shorter than 12 characters'
          WHEN vp IS NOT NULL THEN 'invalid_evidence_reference#' || vp END AS rm
      FROM {p}msg a LEFT JOIN (SELECT task_id, attempt, arg_min(vproblem, claim_pos) AS vp FROM {p}clp WHERE vproblem IS NOT NULL GROUP BY ALL) USING (task_id, attempt))"""
    bad = B.d_any("lower(message)", C.REASON_TERMS["invalid_evidence_reference"])
    sch = B.d_any("lower(message)", C.VALUE_ERROR_SCHEMA_TERMS)
    V[f"{p}chk"] = f"""SELECT *, CASE WHEN message IS NULL THEN vreason WHEN {bad} THEN 'invalid_evidence_reference' WHEN {sch} THEN 'schema_error' ELSE 'invalid_evidence_reference' END AS reason FROM {p}val"""
    V[f"{p}out"] = f"""SELECT *, ar IS NULL AS ok1, ar IS NOT NULL AND br IS NULL AS ok2, ar IS NOT NULL AND br IS NOT NULL AS fb,
        CASE WHEN ar IS NULL THEN a_answer WHEN br IS NULL THEN b_answer ELSE '{C.FALLBACK_ANSWER}' END AS answer,
        CASE WHEN ar IS NULL THEN a_claims WHEN br IS NULL THEN b_claims ELSE a_claims[1:0] END AS claims,
        CASE WHEN ar IS NULL THEN a_ref WHEN br IS NULL THEN b_ref ELSE false END AS refused
      FROM (SELECT task_id, reason AS ar, answer AS a_answer, claims AS a_claims, refusal AS a_ref, item_id, query, rq, entities, ids, pool FROM {p}chk WHERE attempt = 1)
      JOIN (SELECT task_id, reason AS br, answer AS b_answer, claims AS b_claims, refusal AS b_ref FROM {p}chk WHERE attempt = 2) USING (task_id)"""
    N.update({f"{p}ids": [pool_view], f"{p}good": ["tasks", f"{p}ids"], f"{p}att": [f"{p}good"], f"{p}first": [f"{p}att"], f"{p}cl": [f"{p}att"],
              f"{p}clp": [f"{p}cl"], f"{p}ent": [f"{p}att"], f"{p}msg": [f"{p}att", f"{p}clp", f"{p}ent"], f"{p}val": [f"{p}msg", f"{p}clp"],
              f"{p}chk": [f"{p}val"], f"{p}out": [f"{p}chk"]})


def _first_four(items: str) -> str:
    """First occurrences in order, at most four."""
    return (f"list_transform(list_sort(list_transform(list_distinct({items}), lambda x: [lpad(list_position({items}, x)::VARCHAR, 6, '0'), x])), lambda z: z[2])[1:4]")


def _distinct(items: str) -> str:
    return _first_four(items).removesuffix("[1:4]")


def verify_views(p: str, rows: str) -> None:
    """Verdicts, preflight and cleanup over rows (task_id, item_id, query, rq, ids, pool, answer, claims)."""
    V[f"{p}vd"] = f"""SELECT *, item_id % 2 = 1 AS suff, CASE WHEN item_id % 2 = 1 AND item_id % 7 <> 0 THEN ['point'] ELSE []::VARCHAR[] END AS sp,
        CASE WHEN item_id % 2 = 0 THEN ['gap', 'gap'] ELSE []::VARCHAR[] END AS mp,
        CASE WHEN item_id % 14 = 0 THEN ['bogus'] WHEN item_id % 2 = 0 THEN coalesce(claims[1].ev, []::VARCHAR[]) ELSE []::VARCHAR[] END AS weak,
        CASE WHEN item_id % 4 = 0 THEN [answer, ' more on it ', 'more on it', ''] ELSE [answer] END AS sq,
        flatten(list_transform(claims, lambda c: list_transform(list_filter(c.ev, lambda e: NOT list_contains(ids, e)), lambda e: {{'c': c.claim_id, 'e': e}}))) AS miss,
        list_transform(claims, lambda c: c.text) AS texts FROM {rows}"""
    V[f"{p}vq"] = f"""SELECT *, {_first_four("list_filter(list_transform(list_concat(rq, list_transform(list_filter(texts, lambda t: trim(t) <> ''), lambda t: 'evidence supporting claim: ' || trim(t))), lambda q: trim(q)), lambda q: q <> '')")} AS focus_all,
        {_first_four("list_concat(rq, list_transform(list_filter(claims, lambda c: list_contains(list_transform(miss, lambda m: m.c), c.claim_id)), lambda c: 'evidence supporting claim: ' || trim(c.text)))")} AS focus_miss,
        {_first_four("list_filter(list_transform(sq, lambda q: trim(q)), lambda q: q <> '' AND q <> trim(answer) AND NOT list_contains(texts, q))")} AS fresh,
        len(list_filter(weak, lambda w: NOT (list_contains(ids, w) AND list_contains(flatten(list_transform(claims, lambda c: c.ev)), w)))) > 0
          OR (suff AND (len(mp) > 0 OR len(weak) > 0 OR len(sp) = 0)) OR (NOT suff AND len(mp) = 0) AS broken FROM {p}vd"""
    V[f"{p}pre"] = f"""SELECT task_id, false AS sufficient, '' AS supported_points,
        CASE WHEN len(miss) > 0 THEN array_to_string({_distinct("list_transform(miss, lambda m: 'Claim ' || m.c || ' cites unavailable evidence_id ' || m.e || '.')")}, '|') ELSE 'The draft contains no verifiable claims.' END AS missing_points,
        CASE WHEN len(miss) > 0 THEN array_to_string({_distinct("list_transform(miss, lambda m: m.e)")}, '|') ELSE '' END AS weak_evidence_ids,
        array_to_string(CASE WHEN len(miss) > 0 THEN focus_miss ELSE {_first_four('rq')} END, '|') AS suggested_queries,
        CASE WHEN len(miss) > 0 THEN 'The draft contains evidence references that are absent from the supplied EvidencePool.' ELSE 'No claim-to-evidence support can be verified.' END AS reason
      FROM {p}vq WHERE len(miss) > 0 OR len(claims) = 0"""
    V[f"{p}clean"] = f"""SELECT task_id, suff AND NOT broken AS sufficient, CASE WHEN broken THEN '' ELSE array_to_string({_distinct('sp')}, '|') END AS supported_points,
        CASE WHEN broken THEN 'Claim support and research-question coverage could not be verified.' ELSE array_to_string({_distinct('mp')}, '|') END AS missing_points,
        CASE WHEN broken THEN '' ELSE array_to_string({_distinct('weak')}, '|') END AS weak_evidence_ids,
        CASE WHEN broken THEN array_to_string(focus_all, '|') WHEN suff THEN '' WHEN len(fresh) > 0 THEN array_to_string(fresh, '|') ELSE array_to_string(focus_all, '|') END AS suggested_queries,
        CASE WHEN broken THEN 'Evidence verifier provider or response validation failed.' ELSE 'checked' END AS reason FROM {p}vq"""
    V[f"{p}ver"] = f"SELECT * FROM {p}pre UNION ALL SELECT * FROM {p}clean WHERE task_id NOT IN (SELECT task_id FROM {p}pre)"
    # cited titles first, then the pool; labels are the titles (no colon, none generic)
    V[f"{p}lab"] = f"""SELECT task_id, {_distinct("list_transform(list_concat(flatten(list_transform(flatten(list_transform(claims, lambda c: c.ev)), lambda e: list_filter(pool, lambda x: x.id = e))), pool), lambda x: x.title)")} AS labels FROM {rows}"""
    N.update({f"{p}vd": [rows], f"{p}vq": [f"{p}vd"], f"{p}pre": [f"{p}vq"], f"{p}clean": [f"{p}vq"], f"{p}ver": [f"{p}pre", f"{p}clean"], f"{p}lab": [rows]})


V["pool6"] = "SELECT * FROM merged WHERE pos <= 6"
N["pool6"] = ["merged"]
case_views("g", "pool6")
verify_views("g", "gfirst")
case_views("e", "fsel")
verify_views("e", "eout")

ORACLE = {
    "claim_explode": B.oracle("""SELECT task_id, claim_pos, claim_id, text, k - 1 AS cite_pos, ev[k] AS evidence_id, ids_unique, cites_twice FROM
        (SELECT *, unnest(range(1, len(ev) + 1)) AS k FROM gcl WHERE attempt = 1) JOIN
        (SELECT task_id, len(list_distinct(list_transform(claims, lambda c: c.claim_id))) = len(claims) AS ids_unique,
          len(list_filter(claims, lambda c: len(c.ev) <> len(list_distinct(c.ev)))) > 0 AS cites_twice FROM gfirst) USING (task_id)""", "gcl", "gfirst"),
    "unknown_citations": B.oracle("""SELECT task_id, claim_pos, k - 1 AS cite_pos, ev[k] AS evidence_id FROM
        (SELECT *, unnest(range(1, len(ev) + 1)) AS k FROM gcl WHERE attempt = 1) WHERE NOT list_contains(ids, ev[k])""", "gcl"),
    "cited_sources": B.oracle("""SELECT task_id, count(*) AS n_citations, count(DISTINCT source) AS n_sources, count(DISTINCT source) >= 2 AS multiple FROM
        (SELECT task_id, unnest(ev) AS evidence_id FROM gcl WHERE attempt = 1) JOIN pool6 USING (task_id, evidence_id) GROUP BY task_id""", "gcl", "pool6"),
    "entity_coverage": B.oracle("SELECT task_id, entity_pos, entity, matching, len(about) AS named, cited FROM gent WHERE attempt = 1", "gent"),
    "claim_entity_check": B.oracle(f"""SELECT task_id, coalesce(v, '') AS violations FROM gfirst LEFT JOIN (
        SELECT task_id, string_agg('claim about entity ' || {_q} || entity || {_q} || ' lacks matching evidence', '; ' ORDER BY claim_pos, entity_pos) AS v
        FROM gent JOIN gcl USING (task_id, attempt) WHERE attempt = 1 AND matching > 0 AND contains({B.d_alnum('text')}, {B.d_alnum('entity')}) AND len(list_intersect(ev, mids)) = 0
        GROUP BY task_id) USING (task_id)""", "gfirst", "gent", "gcl"),
    "draft_reason": B.oracle(f"""SELECT task_id, attempt, vreason AS reason, vmessage AS message, refusal,
        {_squeeze('answer')} <> '' AND {_squeeze('answer')} = array_to_string(list_transform(claims, lambda c: {_squeeze('c.text')}), '') AS concatenated,
        false AS chinese, CASE WHEN vmessage LIKE '%unknown evidence%' THEN 'invalid_evidence_reference' WHEN vmessage LIKE '%TBD%' OR vmessage LIKE '%ellipsis%' THEN 'placeholder_output'
          WHEN vmessage LIKE '%shorter than%' THEN 'too_short' WHEN vmessage LIKE '%empty%' THEN 'empty_output' ELSE 'invalid_evidence_reference' END AS normalized FROM gval""", "gval"),
    "grounding_violations": B.oracle("SELECT task_id, attempt, message FROM gmsg", "gmsg"),
    "draft_outcome": B.oracle("""SELECT task_id, sha256(answer) AS sha, len(claims) AS n_claims, CASE WHEN ok1 THEN 'valid' WHEN ok2 THEN 'repaired' ELSE 'fallback' END AS outcome,
        NOT ok1 AS draft_validation_failure, ar AS original_validation_reason, CASE WHEN fb THEN br END AS repair_validation_reason,
        CASE WHEN ok1 THEN 0 ELSE 1 END::BIGINT AS draft_repair_attempts, ok2 AS draft_repair_success, fb AS fallback_used, refused AS evidence_insufficient,
        CASE WHEN fb THEN 'draft_validation' END AS failure_stage, CASE WHEN fb THEN br WHEN ok2 THEN ar END AS error_type,
        CASE WHEN refused THEN 'evidence_insufficient' WHEN fb THEN 'draft_fallback' WHEN ok2 THEN 'success' ELSE 'pending' END AS result_status FROM gout""", "gout"),
    "retry_kinds": B.oracle(f"""SELECT task_id, attempt, CASE WHEN {B.d_any("lower(coalesce(message, vmessage, ''))", C.GROUNDING_RETRY_TERMS)} THEN 'grounding' ELSE 'none' END AS retry FROM gval""", "gval"),
    "verify_preflight": B.oracle("SELECT * FROM gpre", "gpre"),
    "verify_cleanup": B.oracle("SELECT * FROM gclean", "gclean"),
    "model_json": """SELECT doc_id, CASE WHEN doc_id % 6 IN (0, 1, 5) THEN sha256('t' || coalesce(text, '')) END AS sha, CASE WHEN doc_id % 6 IN (0, 1, 5) THEN source END AS claim,
        CASE WHEN doc_id % 6 IN (0, 1, 5) THEN 2 ELSE 0 END AS n_citations, CASE doc_id % 6 WHEN 2 THEN 'truncated' WHEN 3 THEN 'no_object' WHEN 4 THEN 'wrong_type' END AS parse_error FROM documents""",
    "answer_gate": B.oracle(f"""SELECT task_id, sha256(CASE WHEN sufficient THEN answer ELSE '{C.INSUFFICIENT_ANSWER}' END) AS sha,
        CASE WHEN sufficient THEN 'success' ELSE 'evidence_insufficient' END AS status, array_to_string(labels, '|') AS sources
        FROM gfirst JOIN gver USING (task_id) JOIN glab USING (task_id)""", "gfirst", "gver", "glab"),
    "source_labels": B.oracle("SELECT task_id, i - 1 AS label_pos, labels[i] AS label FROM (SELECT *, unnest(range(1, len(labels) + 1)) AS i FROM glab)", "glab"),
    "sources_grouped": B.oracle(f"""SELECT task_id, source AS source_id, min(pos) AS first_pos, source AS source_title, arg_min(source_type, pos) AS source_type,
        string_agg(evidence_id, ',' ORDER BY pos) AS evidence_ids, array_to_string({_distinct('list(symbol ORDER BY pos)')}, ',') AS sections FROM merged GROUP BY task_id, source""", "merged"),
    "evidence_id_maps": B.oracle("""SELECT 'source' AS kind, task_id, source AS name, string_agg(evidence_id, ',' ORDER BY pos) AS ids FROM pool6 GROUP BY task_id, source
        UNION ALL SELECT 'entity', task_id, entity, array_to_string(mids, ',') FROM gent WHERE attempt = 1 AND matching > 0""", "pool6", "gent"),
    "prompt_payload": B.oracle("""SELECT task_id, query, task_type, len(ids) AS n_evidence, ids[1] AS first_id, sha256(content) AS first_sha, len(rq) AS n_questions
        FROM gfirst JOIN (SELECT task_id, content FROM pool6 WHERE pos = 1) USING (task_id)""", "gfirst", "pool6"),
    "answer_run": B.oracle(f"""SELECT task_id, sha256(CASE WHEN sufficient THEN answer ELSE '{C.INSUFFICIENT_ANSWER}' END) AS sha,
        CASE WHEN sufficient THEN 'success' ELSE 'evidence_insufficient' END AS status, CASE WHEN ok1 THEN 'valid' WHEN ok2 THEN 'repaired' ELSE 'fallback' END AS outcome,
        array_to_string(labels, '|') AS sources, len(list_distinct(list_transform(pool, lambda x: x.source))) AS n_pool_sources
        FROM eout JOIN ever USING (task_id) JOIN elab USING (task_id)""", "eout", "ever", "elab"),
}
