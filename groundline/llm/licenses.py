"""Licence scan with DataFrame functions only: Dice coefficient of word bigrams.

Lines, paragraphs and whole texts are compared with licence templates. Bigrams
count as often as they occur, so the number of words alone bounds the
coefficient: 2 * min(a, b) / (a + b). Units outside every template's bound are
dropped before any bigram is made. Full texts, standard headers and notices
amid other words are found in windows of template length over the joined lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from groundline.llm.base import Scratch
from groundline.llm.license_texts import FULL_TEXTS, SPDX

#: Common licence notices.
TEMPLATES = [
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Redistribution and use are permitted under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Redistribution and use are permitted under the BSD 3-Clause License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Least Dice coefficient of a match.
THRESHOLD = 0.8
#: Templates are broadcast up to this many bigrams.
BROADCAST_BIGRAMS = 200_000


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "license_id string, text string")


def window_templates(spark: SparkSession) -> DataFrame:
    """The notices, full texts, standard headers and SPDX lines."""
    lines = [(i, f"SPDX-License-Identifier: {i}") for i in SPDX]
    return spark.createDataFrame([*TEMPLATES, *FULL_TEXTS, *lines], "license_id string, text string")


def normalised(text: Column) -> Column:
    """Lower case; everything but letters, digits and line breaks is one space."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " ")


def one_line(text: Column) -> Column:
    """Lines of a normalised text joined; only runs of blanks are rewritten, not every single one."""
    return F.regexp_replace(F.trim(F.replace(text, F.lit("\n"), F.lit(" "))), "  +", " ")


def word_count(unit: Column) -> Column:
    return F.when(unit == "", 0).otherwise(F.length(unit) - F.length(F.replace(unit, F.lit(" "), F.lit(""))) + 1)


def bigrams(unit: Column) -> Column:
    words = F.split(unit, " ")
    return F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i)))


def template_bigrams(source: DataFrame) -> DataFrame:
    """(license_id, template, b, bigram, in_template) of templates with at least two words."""
    known = source.select("license_id", F.trim(F.replace(normalised(F.col("text")), F.lit("\n"), F.lit(" "))).alias("t")).select(
        "license_id", F.regexp_replace("t", " +", " ").alias("t")).where(word_count(F.col("t")) > 1)
    return known.select("license_id", F.xxhash64("t").alias("template"), (word_count(F.col("t")) - 1).alias("b"), F.explode(bigrams(F.col("t"))).alias("bigram")).groupBy(
        "license_id", "template", "b", "bigram").agg(F.count("*").alias("in_template"))


def windows(rows: DataFrame, source: DataFrame, threshold: float) -> DataFrame:
    """(row, doc_id, content, number, license_id, dice): windows of the joined lines as long as a template.

    ``number`` is the first word. Of the windows of one template with starts at
    most half its length apart the best in each length counts, and of templates of different
    licences that meet in a window's middle the one with the greater dice.

    Shared bigrams are placed in order; a start is tried only if enough of them
    follow within the window, so nothing else of the text is looked at.
    """
    pairs = template_bigrams(source)
    n = pairs.count()
    if n and n <= BROADCAST_BIGRAMS:
        pairs = F.broadcast(pairs)
    joined = one_line(F.col("t"))
    key = ["row", "doc_id", "content", "license_id", "template", "b"]
    hits = rows.select("row", "doc_id", F.xxhash64("t").alias("content"), F.posexplode(all_bigrams(joined)).alias("at", "bigram")).join(pairs, "bigram")
    need = F.ceil(threshold * F.col("b") - 1e-9).cast("int")
    placed = hits.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("at", "bigram", "in_template"))).alias("hits")).where(F.size("hits") >= need)
    starts = placed.select(*key, "hits", F.explode(F.filter(F.sequence(F.lit(0), F.size("hits") - need), lambda i: (
        F.get("hits", i + need - 1)["at"] - F.get("hits", i)["at"] < F.col("b")))).alias("i"))
    inside = starts.select(*key, F.get("hits", F.col("i"))["at"].alias("start"), F.slice("hits", F.col("i") + 1, F.col("b")).alias("hits")).select(
        *key, "start", F.explode("hits").alias("h")).where(F.col("h.at") < F.col("start") + F.col("b"))
    common = inside.groupBy(*key, "start", "h.bigram", "h.in_template").agg(F.count("*").alias("n")).groupBy(*key, "start").agg(
        F.sum(F.least("n", "in_template")).alias("common")).where(F.col("common") >= need)
    order = Window.partitionBy(*key).orderBy("start")
    apart = F.coalesce(F.col("start") - F.lag("start").over(order) > F.col("b") / 2, F.lit(True))
    best = Scratch(rows.sparkSession, "licenses").write(common.withColumn("apart", apart.cast("int")).withColumn("chain", F.sum("apart").over(order)).withColumn(
        "first", F.min("start").over(Window.partitionBy(*key, "chain"))).groupBy(*key, "chain", F.expr("(start - first) div b").alias("place")).agg(
        F.max(F.struct("common", (-F.col("start")).alias("before"))).alias("best")).select(
        *key, (-F.col("best.before")).alias("number"), (F.col("best.common") / F.col("b")).alias("dice")), "windows")
    middle = F.expr("number + b div 2")
    spread = best.select(F.col("row").alias("row"), F.explode(F.expr("sequence(number div 64, (number + b - 1) div 64)")).alias("grid"),
                         F.col("number").alias("from_word"), (F.col("number") + F.col("b")).alias("to_word"), F.col("dice").alias("other_dice"),
                         F.col("license_id").alias("other"), F.col("b").alias("other_b"))
    beaten = best.withColumn("grid", F.expr("(number + b div 2) div 64")).join(spread.hint("merge"), ["row", "grid"]).where(
        (F.col("license_id") != F.col("other")) & (middle >= F.col("from_word")) & (middle < F.col("to_word"))
        & (F.struct("other_dice", "other_b") > F.struct("dice", "b"))).select(*key[:1], "template", "license_id", "number").distinct()
    left = best.join(beaten.hint("merge"), ["row", "template", "license_id", "number"], "left_anti")
    return left.groupBy("row", "doc_id", "content", "number", "license_id").agg(F.max("dice").alias("dice"))


def all_bigrams(unit: Column) -> Column:
    """Bigrams of texts of any length, split once; the last entry is a single word and equals no bigram."""
    words = F.split(unit, " ")
    return F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda x, y: F.concat_ws(" ", x, y))


def scan(docs: DataFrame, licenses: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, unit, number, license_id, dice): the best licence of every matching unit.

    Units are lines, paragraphs (between blank lines, if there are several) and
    whole texts of several lines, numbered from 0 within their kind. Ties go to
    the smaller license_id. Null and empty texts, and templates of under two
    words, match nothing. Repeated rows match by themselves; a null doc_id stays
    null; other columns are ignored; an empty table gives no rows. Licences:
    (license_id, text), one of each id (the least text counts).

    Licences that no such unit of a document names are also looked for in its
    windows (unit ``window``, numbered by their first word); without ``licenses``
    these have full texts, standard headers and SPDX lines as templates too.

    Only shared bigrams leave the scan: the templates' bigrams are broadcast when
    they are few (counted first), and else joined by a shuffle.
    """
    spark = docs.sparkSession
    source = (licenses if licenses is not None else templates(spark)).groupBy("license_id").agg(F.min("text").alias("text"))
    known = source.select("license_id", F.trim(F.replace(normalised(F.col("text")), F.lit("\n"), F.lit(" "))).alias("t")).select(
        "license_id", F.regexp_replace("t", " +", " ").alias("t"), ).where(word_count(F.col("t")) > 1)
    pairs = known.select("license_id", (word_count(F.col("t")) - 1).alias("b"), F.explode(bigrams(F.col("t"))).alias("bigram")).groupBy(
        "license_id", "b", "bigram").agg(F.count("*").alias("in_template"))
    low, high, n = pairs.agg(F.min("b"), F.max("b"), F.count("*")).first()
    bound = threshold / (2 - threshold)
    if n and n <= BROADCAST_BIGRAMS:
        pairs = F.broadcast(pairs)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                       normalised(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("t"))

    def units(kind: str, array: Column, at_least: int) -> Column:
        parts = F.transform(array, lambda x, i: F.struct(
            F.lit(kind).alias("unit"), i.alias("number"), one_line(x).alias("t")))
        a = lambda u: word_count(u["t"]) - 1
        fit = F.filter(parts, lambda u: (a(u) >= bound * (low or 0)) & (a(u) <= (high or 0) / bound) & (a(u) > 0))
        return F.when(F.size(array) >= at_least, fit).otherwise(F.slice(fit, 1, 0))

    breaks = F.instr("t", "\n") > 0
    whole = F.when(breaks, F.array("t")).otherwise(F.slice(F.array("t"), 1, 0))
    found = rows.select("row", "doc_id", F.xxhash64("t").alias("content"), F.explode(F.concat(
        units("line", F.split("t", "\n"), 1), units("paragraph", F.split("t", "\n ?\n"), 2), units("text", whole, 1))).alias("u"))
    words = found.select("row", "doc_id", "content", "u.unit", "u.number", (word_count(F.col("u.t")) - 1).alias("a"), F.explode(bigrams(F.col("u.t"))).alias("bigram"))
    shared = words.join(pairs, "bigram").where((F.col("a") >= bound * F.col("b")) & (F.col("a") <= F.col("b") / bound))
    each = shared.groupBy("row", "doc_id", "content", "unit", "number", "license_id", "a", "b", "bigram", "in_template").agg(F.count("*").alias("n"))
    scores = each.groupBy("row", "doc_id", "content", "unit", "number", "license_id", "a", "b").agg(
        F.sum(F.least("n", "in_template")).alias("common")).withColumn("dice", 2.0 * F.col("common") / (F.col("a") + F.col("b")))
    best = scores.where(F.col("dice") >= threshold).groupBy("row", "doc_id", "content", "unit", "number").agg(
        F.min(F.struct((-F.col("dice")).alias("order"), "license_id")).alias("best"))
    # read twice below: the scan of all texts runs once
    named = Scratch(spark, "licenses").write(
        best.select("row", "doc_id", "content", "unit", "number", "best.license_id", (-F.col("best.order")).alias("dice")), "named")
    amid = windows(rows, source if licenses is not None else window_templates(spark), threshold).join(
        named.select("content", "license_id").distinct().hint("merge"), ["content", "license_id"], "left_anti")
    return named.unionByName(amid.withColumn("unit", F.lit("window"))).select("doc_id", "unit", "number", "license_id", F.round("dice", 9).alias("dice"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle() -> str:
    """The same scan of ``documents`` with the fixed templates and threshold in SQL."""
    values = ", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in TEMPLATES)
    norm = lambda x: f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
    one_line = lambda x: f"regexp_replace(trim(replace({x}, chr(10), ' ')), ' +', ' ', 'g')"
    return f"""
WITH known AS (SELECT license_id, string_split({one_line(norm('text'))}, ' ') AS w FROM (VALUES {values}) v(license_id, text)),
tb AS (SELECT license_id, b, bigram, count(*) AS n FROM (
  SELECT license_id, len(w) - 1 AS b, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram FROM known WHERE len(w) > 1) GROUP BY ALL),
norm AS (SELECT doc_id, {norm("coalesce(text, '')")} AS t FROM documents),
parts AS (
  SELECT doc_id, 'line' AS unit, unnest(string_split(t, chr(10))) AS t, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS number FROM norm
  UNION ALL SELECT doc_id, 'paragraph', unnest(regexp_split_to_array(t, '\\n ?\\n')), generate_subscripts(regexp_split_to_array(t, '\\n ?\\n'), 1) - 1
  FROM norm WHERE len(regexp_split_to_array(t, '\\n ?\\n')) > 1
  UNION ALL SELECT doc_id, 'text', t, 0 FROM norm WHERE contains(t, chr(10))),
units AS (SELECT doc_id, unit, number, string_split(u, ' ') AS w FROM (SELECT *, {one_line('t')} AS u FROM parts) WHERE u <> ''),
db AS (SELECT doc_id, unit, number, a, bigram, count(*) AS n FROM (
  SELECT doc_id, unit, number, len(w) - 1 AS a, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram
  FROM units WHERE len(w) BETWEEN 2 AND 100) GROUP BY ALL),
scores AS (SELECT doc_id, unit, number, license_id, 2.0 * sum(least(db.n, tb.n)) / (a + b) AS dice
  FROM db JOIN tb USING (bigram) GROUP BY doc_id, unit, number, license_id, a, b)
SELECT doc_id, unit, number::INT AS number, license_id, round(dice::DOUBLE, 9) AS dice FROM scores WHERE dice >= {THRESHOLD}
QUALIFY row_number() OVER (PARTITION BY doc_id, unit, number ORDER BY dice DESC, license_id) = 1"""
