"""Merkle manifest of a table of documents: nested-struct rollup over rank digits.

Nodes are ranked within their tree; the digits of a rank to base 3 name its
place at every level. Within a block of ``3 ** LEVELS`` ranks the digits are
grouped away one after the other, each step nesting the child structs in their
parent, without further shuffles. Block tops are the nodes of the next round.
Transforms then walk the nested structs down again and an explode gives every
leaf its siblings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from groundline.llm.base import Scratch
from groundline.llm.ranks import ranked

ARITY, LEVELS = 3, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    """SHA-256 over the tagged fields of a document, with ``text`` in place of its text."""
    return F.sha2(F.concat(*(_field(text if c == "text" else F.col(c)) for c in FIELDS)), 256)


def _hashed(level: int) -> Column:
    """Whether a tree of ``total`` nodes has this level (from 1); else its only node passes through."""
    return F.col("total") > ARITY ** (level - 1)


def _blocks(nodes: DataFrame) -> DataFrame:
    """(g, b, total, node): the nested top of every block of nodes (g, rank, total, h, ...)."""
    size = ARITY ** LEVELS
    digits = [F.expr(f"rank div {ARITY ** i} % {ARITY}").alias(f"d{i}") for i in range(LEVELS)]
    own = [c for c in nodes.columns if c not in ("g", "total")]
    rows = nodes.select("g", "total", F.expr(f"rank div {size}").alias("b"), *digits, F.struct(*own).alias("node")).repartition("g", "b")
    for level in range(1, LEVELS + 1):
        # the rows of a block are in one task already: no exchange
        keys = ["g", "b", "total", *(f"d{i}" for i in range(level, LEVELS))]
        rows = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(f"d{level - 1}", "node"))).alias("kids"))
        joined = F.concat_ws("", F.transform("kids", lambda k: k["node"]["h"]))
        top = F.when(_hashed(level), F.sha2(joined, 256)).otherwise(F.col("kids")[0]["node"]["h"])
        rows = rows.select(*keys, F.struct(top.alias("h"), F.col("kids").alias("kids")).alias("node"))
    return rows


def _rollup(nodes: DataFrame, scratch: Scratch, label: str) -> tuple[list[DataFrame], DataFrame]:
    """The block tables of all rounds, and (g, h) with the top of every tree."""
    rounds, size = [], ARITY ** LEVELS
    while True:
        blocks = scratch.write(_blocks(nodes), f"{label}-{len(rounds)}")
        rounds.append(blocks)
        nodes = blocks.select("g", F.col("b").alias("rank"), F.expr(f"(total + {size - 1}) div {size}").alias("total"), F.col("node.h").alias("h"))
        if (blocks.agg(F.max("total")).first()[0] or 0) <= size:
            return rounds, nodes.select("g", "h")


def _siblings(kids: Column, start: Column | int, length: Column | int) -> Column:
    return F.concat_ws("", F.transform(F.slice(kids, start, length), lambda k: k["node"]["h"]))


def _down(level: int):
    """From the nodes of a level, with their paths, to their children."""
    def parent(item: Column) -> Column:
        kids = item["node"]["kids"]

        def kid(k: Column, i: Column) -> Column:
            sides = {"left": _siblings(kids, F.lit(1), i), "right": _siblings(kids, i + 2, F.lit(ARITY))}
            return F.struct(k["node"].alias("node"), *(
                F.when(_hashed(level), F.concat(F.array(s), item[c])).otherwise(item[c]).alias(c) for c, s in sides.items()))
        return F.transform(kids, kid)
    return parent


def _paths(rounds: list[DataFrame], tops: DataFrame, carried: list[str]) -> DataFrame:
    """Every first-round node with left and right: the joined siblings on both sides, level by level upwards.

    ``tops`` are (g, left, right, carried columns). A round's blocks meet the
    paths of their tops, one row each; all levels below are transforms.
    """
    up = tops.withColumn("b", F.lit(0).cast("long"))
    for blocks in reversed(rounds):
        none = F.array().cast("array<string>")
        items = F.array(F.struct(F.col("node").alias("node"), none.alias("left"), none.alias("right")))
        for level in range(LEVELS, 0, -1):
            items = F.flatten(F.transform(items, _down(level)))
        above = up.withColumnsRenamed({"left": "up_left", "right": "up_right"})
        found = blocks.join(above, ["g", "b"]).select("g", "up_left", "up_right", *carried, F.explode(items).alias("item"))
        up = found.select("g", "item.node.*", F.concat("item.left", "up_left").alias("left"),
                          F.concat("item.right", "up_right").alias("right"), *carried).withColumnRenamed("rank", "b")
    return up


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of ``docs``.

    Leaves of a source ascend by doc_id (null first, repeated ids by digest); a
    null source is a source of its own, before all others. Every three
    neighbours become the digest of their joined digests until one is left; the
    sources' tops likewise give the root. ``tampered`` is the text that arrives
    at the verifier (default: where 2 divides the CRC-32 of the decimal doc_id,
    the text without line feeds; a null doc_id is never tampered with).
    Null fields are ``-``; other columns are ignored; texts are hashed whole, in
    one read; an empty table gives no rows.

    Blocks hold at most 729 leaves, whatever the size of a source. Only block
    tops, one row each, meet the paths above them.
    """
    scratch = Scratch(docs.sparkSession, "manifest")
    source = docs.selectExpr("cast(doc_id as long) doc_id", "cast(source as string) source", "cast(lang as string) lang",
                             "cast(n_chars as long) n_chars", "cast(text as string) text")
    if tampered is None:
        cut = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
        tampered = F.when(cut, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    # null first, then bytewise: "-" sorts before ":"
    group = F.coalesce(F.concat(F.lit(":"), F.col("source")), F.lit("-"))
    leaves = scratch.write(source.select(
        group.alias("g"), "doc_id", leaf_digest(F.col("text")).alias("h"), leaf_digest(tampered).alias("arrived"),
        F.monotonically_increasing_id().alias("row")), "leaves")
    rounds, tops = _rollup(ranked(leaves, scratch, "ranked", "g", ["doc_id", "h", "row"]).drop("row"), scratch, "docs")

    named = scratch.write(tops.select(F.lit("").alias("g"), F.col("g").alias("source"), "h"), "sources")
    above, root = _rollup(ranked(named, scratch, "ranked-sources", "g", ["source"]), scratch, "roots")
    none = F.array().cast("array<string>")
    root = root.select("g", none.alias("left"), none.alias("right"), F.col("h").alias("root"))
    sources = scratch.write(_paths(above, root, ["root"]).select(
        F.col("source").alias("g"), F.col("h").alias("subroot"), "left", "right", "root"), "paths")
    found = _paths(rounds, sources, ["subroot", "root"])
    steps = F.arrays_zip("left", "right")
    folded = F.aggregate(steps, F.col("arrived"), lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))
    proof = F.sha2(F.concat_ws("", F.transform(steps, lambda s: F.concat(s["left"], s["right"]))), 256)
    return found.select("doc_id", F.col("h").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))
