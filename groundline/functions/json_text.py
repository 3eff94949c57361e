"""JSON objects inside model text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F

from groundline.functions import json_scan, text as T
from groundline.session import ship_package

CLAIMS = "array<struct<claim_id:string,text:string,evidence_ids:array<string>>>"


def _body(raw: Column) -> Column:
    """Text without its code fence."""
    t = T.strip(F.coalesce(raw, F.lit("")))
    inner = F.regexp_replace(F.regexp_replace(t, rf"^```(?i:json)?{T.WS}*", ""), rf"{T.WS}*```$", "")
    return F.when(F.startswith(t, F.lit("```")), inner).otherwise(t)


def first_object(raw: Column) -> Column:
    """JSON text of the first object in ``raw``, NULL when there is none.

    Every brace may begin it; what follows a complete object does not matter.
    """
    ship_package(SparkSession.active())

    @F.pandas_udf("string")
    def scan(texts: pd.Series) -> pd.Series:
        return texts.map(json_scan.first_object)

    return scan(_body(raw))


def parsed_draft(raw: Column) -> Column:
    """struct(answer, claims, parse_error) of a draft as a model wrote it.

    parse_error is ``no_object`` (nothing begins one), ``truncated`` (a brace, but no
    whole object) or ``wrong_type`` (answer is no text, or claims are no list of
    claims; missing claims are an empty list), else NULL. Repeated keys within an object are ``wrong_type``.
    """
    found = first_object(raw)
    value = F.try_parse_json(found)
    said, listed = (F.try_variant_get(value, f"$.{k}", "variant") for k in ("answer", "claims"))
    claims = F.when(listed.isNull(), F.array().cast(CLAIMS)).otherwise(F.try_variant_get(value, "$.claims", CLAIMS))
    bad = F.coalesce(F.schema_of_variant(said), F.lit("")) != "STRING"
    error = (F.when(found.isNotNull() & (bad | claims.isNull()), F.lit("wrong_type"))
             .when(found.isNull(), F.when(F.contains(F.coalesce(raw, F.lit("")), F.lit("{")), F.lit("truncated")).otherwise(F.lit("no_object"))))
    good = error.isNull()
    return F.struct(F.when(good, F.try_variant_get(value, "$.answer", "string")).alias("answer"), F.when(good, claims).otherwise(F.array().cast(CLAIMS)).alias("claims"), error.alias("parse_error"))


def parsed_verdict(raw: Column) -> Column:
    """struct of the verification columns of a verdict as a model wrote it; all NULL when it cannot be read.

    ``sufficient`` must be true or false; missing lists are empty and a missing reason is an empty text.
    """
    value = F.try_parse_json(first_object(raw))
    kind = F.schema_of_variant(F.try_variant_get(value, "$.sufficient", "variant"))

    def member(name: str, to: str, default: Column) -> Column:
        return F.when(F.try_variant_get(value, f"$.{name}", "variant").isNull(), default).otherwise(F.try_variant_get(value, f"$.{name}", to))

    lists = {n: member(n, "array<string>", T.strings([])) for n in ("supported_points", "missing_points", "weak_evidence_ids", "suggested_queries")}
    rest = lists | {"reason": member("reason", "string", F.lit(""))}
    good = F.coalesce(kind == "BOOLEAN", F.lit(False))
    for column in rest.values():
        good = good & column.isNotNull()
    sufficient = F.try_variant_get(value, "$.sufficient", "boolean")
    return F.struct(*(F.when(good, c).alias(n) for n, c in ({"sufficient": sufficient} | rest).items()))
