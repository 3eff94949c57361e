"""Golden drafts for the rules the tables do not show."""

import json
import random

import pytest
from pyspark.sql import functions as F

from groundline.functions import json_scan
from groundline.functions.json_text import first_object
from groundline.operators import grounding as G

TASK = "task_id string, query string, task_type string, entities array<string>, research_questions array<string>, requires_comparison boolean, answer string, claims " + G.CLAIMS
POOL = "pool array<struct<evidence_id:string,source_id:string,prov:string>>"
EV = [("e1", "s-react", "sreactreact"), ("e2", "s-reflexion", "sreflexionreflexion")]


def case(spark, answer, claims, query="compare both", entities=("ReAct", "Reflexion"), comparison=True, pool=EV):
    row = ("t", query, "COMPARISON" if comparison else "FACT_LOOKUP", list(entities), ["q"], comparison, answer, claims, list(pool))
    return spark.createDataFrame([row], f"{TASK}, {POOL}")


def claim(i, text, *ids):
    return (f"c{i}", text, list(ids))


GOOD = [claim(1, "ReAct acts", "e1"), claim(2, "Reflexion reflects", "e2")]


@pytest.mark.parametrize("answer,claims,kw,message", [
    ("A full synthesis of both.", GOOD, {}, None),
    ("A full synthesis.", [], {}, "uncited answer without an insufficiency statement"),
    ("Evidence is insufficient", [], {"comparison": False}, None),
    ("English only", GOOD, {"query": "比较两者"}, "Chinese query requires a Chinese answer"),
    ("中文回答", GOOD, {"query": "比较两者"}, "Chinese query requires Chinese claim text"),
    ("ReAct acts. Reflexion reflects", GOOD, {}, None),
    ("ReActacts Reflexion reflects!", GOOD, {}, "answer must synthesize rather than concatenate claim text"),
    ("Synthesis text", [claim(1, "ReAct acts", "e1", "e1")], {}, "duplicate evidence_id in claim"),
    ("Synthesis text", [claim(1, "ReAct acts", "x2", "e1", "x1")], {}, "unknown evidence ids: ['x1', 'x2']"),
    ("Synthesis text", [claim(1, "ReAct acts", "e1")], {}, "comparison draft must cite multiple sources"),
    ("Synthesis text", [claim(1, "ReAct acts", "e1"), claim(2, "Other", "e2")], {}, "comparison draft does not separately cover entity 'Reflexion'"),
    ("Synthesis text", [claim(1, "ReAct acts", "e2"), claim(2, "Reflexion", "e1")], {}, "comparison entity 'ReAct' lacks matching cited evidence"),
    ("Synthesis text", GOOD, {"entities": ("!!",)}, None),
])
def test_grounding(spark, answer, claims, kw, message):
    assert case(spark, answer, claims, **kw).select(G.grounding_message()).first()[0] == message


@pytest.mark.parametrize("answer,claims,reason", [
    ("", GOOD, "empty_output"), (" … ", GOOD, "placeholder_output"), ("see TBD now", GOOD, "placeholder_output"), ("中tbd文 long enough answer", GOOD, None),
    ("方法的... 。 另一方法的…。 比较", GOOD, "placeholder_output"), ("无法回答", [], None), ("无法基于当前证据可靠生成回答", GOOD, "generic_fallback"),
    ("short", GOOD, "too_short"), ("long enough answer", [claim(1, " ", "e1")], "missing_required_field"),
    ("long enough answer", [claim(1, "x")], "missing_required_field"), ("long enough answer", [claim(1, "x", "zz")], "invalid_evidence_reference"),
    ("long enough answer", GOOD, None)])
def test_validation(spark, answer, claims, reason):
    assert case(spark, answer, claims).select(G.validation()["reason"]).first()[0] == reason


@pytest.mark.parametrize("kind,message,code", [
    ("ValueError", "unknown evidence ids: ['a']", "invalid_evidence_reference"), ("ValueError", "Chinese query requires a Chinese answer", "schema_error"),
    ("ValueError", "something else", "invalid_evidence_reference"), ("ValidationError", "1 validation error", "schema_error"),
    ("x", "field required", "missing_required_field"), ("x", "answer is empty", "empty_output"), ("too_short", "", "schema_error"), ("generic_fallback", "", "generic_fallback"),
    ("KeyError", "nothing known", "schema_error")])
def test_reasons(spark, kind, message, code):
    if kind == "too_short":
        code = "too_short"
    assert spark.range(1).select(G.normalized_reason(F.lit(kind), F.lit(message))).first()[0] == code


def test_empty_entity_matches_everything(spark):
    row = case(spark, "x", GOOD).select(G.matching_ids(F.lit("??")), G.matching_ids(F.lit("Re-Act"))).first()
    assert row[0] == ["e1", "e2"] and row[1] == ["e1"]


def test_first_object(spark):
    texts = ['{"a": 1}', '```json\n{"a": 2}\n```', 'say {bad} then {"a": 3} and {"a": 4}', "no json", "{broken", None, 'x [1] {"a": {"b": 5}} tail', '{"a": 6', '```\n{"a": 7}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, raw string")
    got = [r[0] for r in df.select("i", first_object(F.col("raw")).alias("o")).orderBy("i").select(F.get_json_object("o", "$.a")).collect()]
    assert got == ["1", "2", "3", None, None, None, '{"b":5}', None, "7"]


def test_object_scan_equals_trying_every_brace():
    def tried(text):
        for i in (i for i, c in enumerate(text) if c == "{"):
            try:
                return text[i:i + json.JSONDecoder().raw_decode(text[i:])[1]]
            except json.JSONDecodeError:
                continue

    rng = random.Random(5)
    pieces = ["{", "}", '{"a":', '"', "1", ",", "[", "]", ":", "x", " ", "\\", "{}", '"b":', '{"a":1}', "null", "-0.5e3", "01"]
    for _ in range(20_000):
        text = "".join(rng.choices(pieces, k=rng.randrange(15)))
        assert json_scan.first_object(text) == tried(text), text


@pytest.mark.parametrize("unit", ["{", '{"a":', '{"a":[', '{"{":"{",', '{"a{":{'])
def test_object_scan_reads_on_in_linear_time(unit, monkeypatch):
    read, pattern = [0], json_scan._TOKEN

    class Counted:
        def match(self, text, at):
            read[0] += 1
            return pattern.match(text, at)

    monkeypatch.setattr(json_scan, "_TOKEN", Counted())
    text = unit * (200_000 // len(unit))
    assert json_scan.first_object(text) is None and read[0] <= 3 * len(text)


def test_raw_drafts_and_verdicts(spark):
    drafts = ['{"answer": "x", "claims": [{"claim_id": "c", "text": "t", "evidence_ids": ["e"]}]}', '{"answer": "x"}', '{"answer": 5}', '{"answer": "x", "claims": null}',
              '{"answer": "x", "claims": "c"}', '{"answer": "x', "none", "", None, '{"claims": []}']
    rows = G.with_draft(spark.createDataFrame(list(enumerate(drafts)), "i int, raw string")).orderBy("i").collect()
    assert [(r["answer"], len(r["claims"]), r["parse_error"]) for r in rows] == [
        ("x", 1, None), ("x", 0, None), *[(None, 0, "wrong_type")] * 3, (None, 0, "truncated"), *[(None, 0, "no_object")] * 3, (None, 0, "wrong_type")]
    verdicts = ['ok: {"sufficient": true, "supported_points": ["p"], "reason": "r"}', '{"sufficient": "maybe"}', '{"sufficient": false, "missing_points": 3}', "x", None]
    rows = G.with_verdict(spark.createDataFrame(list(enumerate(verdicts)), "i int, raw_verdict string")).orderBy("i").collect()
    assert [(r["sufficient"], r["supported_points"], r["missing_points"], r["reason"]) for r in rows] == [(True, ["p"], [], "r"), *[(None,) * 4] * 4]


def test_raw_attempts_to_outcomes(spark):
    """A cut draft is repaired; an unreadable verdict is the fallback, a readable one counts."""
    good = json.dumps({"answer": "A good long synthesis.", "claims": [c if isinstance(c, dict) else c.asDict() for c in case(spark, "x", GOOD).first()["claims"]]}, default=lambda r: r.asDict())
    base = case(spark, "x", GOOD).drop("answer", "claims")
    attempts = base.withColumn("raw", F.lit(good[:40])).withColumn("attempt", F.lit(1)).unionByName(base.withColumn("raw", F.lit(good)).withColumn("attempt", F.lit(2)))
    row = G.draft_outcomes(G.with_draft(attempts)).first()
    assert (row["outcome"], row["original_validation_reason"]) == ("repaired", "schema_error") and "JSON object" in row["original_validation_message"]
    seen = {raw: G.verify(G.with_verdict(case(spark, "A good long synthesis.", GOOD).withColumn("raw_verdict", F.lit(raw)))).first()
            for raw in ('{"sufficient": true, "supported_points": ["p"], "reason": "fine"}', "I think so")}
    assert [v["sufficient"] for v in seen.values()] == [True, False]


def test_outcomes(spark):
    one = case(spark, "short", GOOD).withColumn("attempt", F.lit(1))
    two = case(spark, "A good long synthesis.", GOOD).withColumn("attempt", F.lit(2))
    done = G.draft_outcomes(one.unionByName(two)).first()
    assert (done["outcome"], done["result_status"], done["original_validation_reason"]) == ("repaired", "success", "too_short")
    only = G.draft_outcomes(one).first()
    assert (only["outcome"], only["result_status"], only["repair_validation_reason"]) == ("fallback", "draft_fallback", "too_short")
    empty = G.draft_outcomes(case(spark, "any", GOOD, pool=[]).withColumn("attempt", F.lit(1))).first()
    assert (empty["outcome"], empty["evidence_insufficient"]) == ("insufficient", True)


def test_tasks_without_draft_or_evidence_stay(spark):
    tasks = spark.createDataFrame([("a", "q"), ("b", "q"), ("c", "q")], "task_id string, query string").withColumns(
        {"task_type": F.lit("FACT_LOOKUP"), "entities": F.array().cast("array<string>"), "research_questions": F.array(F.lit("q")), "requires_comparison": F.lit(False)})
    pool = spark.createDataFrame([("a", 1, "e1", "s", "t", "m"), ("b", 1, "e1", "s", "t", "m")],
                                 "task_id string, pos long, evidence_id string, source_id string, source_title string, meta_title string").withColumns(
        {c: F.lit("x") for c in ("section", "content", "canonical_content", "file_path", "repository_url", "symbol", "title", "source_type")})
    drafts = spark.createDataFrame([("a", 1, "A long enough answer.", [("c1", "claim", ["e1"])])], "task_id string, attempt int, answer string, claims " + G.CLAIMS)
    out = {r["task_id"]: (r["outcome"], r["evidence_insufficient"]) for r in G.draft_outcomes(G.cases(tasks, pool, drafts, how="left")).collect()}
    assert out == {"a": ("valid", False), "b": ("fallback", False), "c": ("insufficient", True)}
