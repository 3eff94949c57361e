"""Prefix trie of conversations, with subtree totals by parallel tree contraction.

A node is a distinct sequence of first turns; it is told apart by its depth and
128 bits of hashes over (position, role, text). Rounds of joins rake all leaves
into their parents and compress unary chains, in which every second node goes;
compressed nodes get their totals when the rounds are undone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from groundline.llm.base import Scratch
from groundline.llm.ranks import ranked
from groundline.operators.ordering import split_lookup

FAMILY, SHARED = 20, 4
#: Turns of one conversation that a task handles together.
SEGMENT = 4096
SPACE = "[\\x20\\x09-\\x0D]+"


def shared_turns(conv: Column) -> Column:
    """How many turns a conversation takes from the first one of its family."""
    return F.crc32(conv.cast("string")) % SHARED


def _segments(convs: DataFrame) -> DataFrame:
    """A row for every segment of a conversation, so that no join key has more than SEGMENT turns."""
    return convs.withColumn("segment", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"total div {SEGMENT}"))))


def _segment(place: str) -> Column:
    return F.expr(f"{place} div {SEGMENT}")


def rebuilt(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(conv_id, d, x, y, words, size) for every turn, d from 1, and (conv_id, size) for every conversation.

    x and y are hashes of role and text, ``words`` the number of words, size
    the turns of the rebuilt conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    spaced = F.trim(F.regexp_replace(text, SPACE, " "))
    own = scratch.write(turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.xxhash64(role, text).alias("x"), F.xxhash64(F.lit(1), text, role).alias("y"),
        F.when(spaced == "", 0).otherwise(F.size(F.split(spaced, " "))).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("row")), "turns")
    placed = scratch.write(ranked(own, scratch, "ordered", "conv_id", ["turn", "x", "y", "row"]).select(
        "conv_id", (F.col("rank") + 1).alias("d"), "x", "y", "words", "total"), "placed")
    first = F.expr(f"conv_id - conv_id % {FAMILY}")
    convs = placed.where("d = 1").select("conv_id", "total", first.alias("first"), shared_turns(F.col("conv_id")).alias("h"))
    heads = placed.where(f"d < {SHARED} and conv_id % {FAMILY} = 0").select(F.col("conv_id").alias("first"), "d", "x", "y", "words", F.col("total").alias("there"))
    convs = scratch.write(
        convs.join(heads.where("d = 1").select("first", "there"), "first", "left")
        .withColumn("got", F.least("h", F.coalesce("there", F.lit(0))))
        .withColumn("size", F.col("got") + F.greatest(F.col("total") - F.col("h"), F.lit(0))), "convs")
    columns = ["conv_id", "d", "x", "y", "words", "size"]
    taken = convs.where("got > 0").join(heads.drop("there"), "first").where("d <= got").select(columns)
    rest = (placed.withColumn("segment", _segment("d")).drop("total").join(_segments(convs), ["conv_id", "segment"])
            .where("d > h").withColumn("d", F.col("d") - F.col("h") + F.col("got")).select(columns))
    return taken.unionByName(rest), convs.select("conv_id", "size")


def _memberships(turns: DataFrame, convs: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, d, a, b, up_a, up_b, words, size): the node of every turn and its parent, and the root for every conversation."""
    rows = scratch.write(turns.select(
        "*", F.xxhash64("d", "x", "y").alias("u"), F.xxhash64("y", "d", "x").alias("v"), _segment("d - 1").alias("segment")).drop("x", "y"), "rebuilt")
    totals = rows.groupBy("conv_id", "segment").agg(F.bit_xor("u").alias("u"), F.bit_xor("v").alias("v"))
    before = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("conv_id", "segment", F.bit_xor("u").over(before).alias("base_u"), F.bit_xor("v").over(before).alias("base_v")).where("segment > 0")
    inside = Window.partitionBy("conv_id", "segment").orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hashed = rows.join(bases, ["conv_id", "segment"], "left").select(
        "conv_id", "d", "words", "size", "u", "v",
        *(F.bit_xor(c).over(inside).bitwiseXOR(F.coalesce(f"base_{c}", F.lit(0))).alias(n) for c, n in (("u", "a"), ("v", "b"))))
    nodes = hashed.select("conv_id", "d", "a", "b", F.col("a").bitwiseXOR(F.col("u")).alias("up_a"), F.col("b").bitwiseXOR(F.col("v")).alias("up_b"), "words", "size")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    roots = convs.select("conv_id", zero.alias("d"), zero.alias("a"), zero.alias("b"), none.alias("up_a"), none.alias("up_b"), zero.alias("words"), "size")
    return scratch.write(nodes.unionByName(roots), "members")


def _end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each node's ids; rows come sorted, so only one running digest is held."""
    key, running = None, None

    def done() -> pa.RecordBatch:
        d, a, b = key
        return pa.RecordBatch.from_pydict({"d": [d], "a": [a], "b": [b], "ends_sha256": [running.hexdigest()]})

    for batch in batches:
        for *at, conv in zip(*(batch.column(c).to_pylist() for c in ("d", "a", "b", "conv_id")), strict=True):
            if at != key:
                if key is not None:
                    yield done()
                key, running = at, hashlib.sha256(str(conv).encode())
            else:
                running.update(f",{conv}".encode())
    if key is not None:
        yield done()


def subtree_totals(tree: DataFrame, weights: list[str], scratch: Scratch, label: str = "tree") -> DataFrame:
    """(id, weights): each weight summed over every node's subtree, itself included.

    ``tree`` has one row per node: id, parent (same type; null at roots), depth
    (growing downwards) and integer weights. Each round rakes all leaves into
    their parents and removes unary nodes whose digit is 1 while their only
    child's is not, or the child is not unary: digits of the depth first, which
    halve a chain, then coins. A removed node leaves the sum it adds on the way
    up with its child. Rounds grow with the logarithm of the depth and of the
    number of nodes. A parent's children combine before they are shuffled and
    every join meets one row per key on both sides, so a node with most of the
    nodes as children is no hot key.
    """
    kids = tree.where("parent is not null").groupBy("parent").agg(F.count("*").alias("kids")).withColumnRenamed("parent", "id")
    edges = [f"edge_{w}" for w in weights]
    state = scratch.write(tree.join(kids, "id", "left").select(
        "id", "parent", "depth", F.coalesce("kids", F.lit(0)).alias("kids"), *weights,
        *(F.lit(0).cast("long").alias(e) for e in edges)), f"{label}-0")
    deepest = int(state.agg(F.max("depth")).first()[0] or 0)
    raked, compressed, step = [], [], 0
    while not (inner := state.where("parent is not null")).isEmpty():
        leaves = inner.where("kids = 0")
        raked.append(leaves.select("id", *weights))
        given = leaves.groupBy("parent").agg(F.count("*").alias("gone"), *(F.sum(F.col(w) + F.col(e)).alias(f"got_{w}") for w, e in zip(weights, edges, strict=True)))
        rest = scratch.write(state.where("kids > 0 or parent is null").join(given.withColumnRenamed("parent", "id"), "id", "left").select(
            "id", "parent", "depth", (F.col("kids") - F.coalesce("gone", F.lit(0))).alias("kids"),
            *((F.col(w) + F.coalesce(f"got_{w}", F.lit(0))).alias(w) for w in weights), *edges), f"{label}-{step}-raked")
        digit = F.shiftright("depth", step) if deepest >> step else F.xxhash64(F.lit(step), "id")
        unary = (F.col("kids") == 1) & F.col("parent").isNotNull() & (F.pmod(digit, F.lit(2)) == 1)
        only = rest.where("parent is not null").groupBy("parent").agg(
            F.count("*").alias("n"), F.min(F.struct("id", unary.alias("leaves"), *edges)).alias("child")).where("n = 1 and not child.leaves")
        out = scratch.write(rest.where(unary).join(only.select(F.col("parent").alias("id"), "child"), "id").select(
            "id", "parent", F.col("child.id").alias("child"),
            *((F.col(w) + F.col(f"child.{e}")).alias(w) for w, e in zip(weights, edges, strict=True)),
            *((F.col(w) + F.col(e)).alias(f"add_{w}") for w, e in zip(weights, edges, strict=True))), f"{label}-{step}-compressed")
        compressed.append(out)
        changes = out.select("id", F.lit(True).alias("gone"), F.lit(None).cast(out.schema["parent"].dataType).alias("above"), *(F.lit(0).cast("long").alias(f"add_{w}") for w in weights)).unionByName(
            out.select(F.col("child").alias("id"), F.lit(False).alias("gone"), F.col("parent").alias("above"), *(f"add_{w}" for w in weights)))
        step += 1
        state = scratch.write(rest.join(changes, "id", "left").where("gone is null or not gone").select(
            "id", F.coalesce("above", "parent").alias("parent"), "depth", "kids", *weights,
            *((F.col(e) + F.coalesce(f"add_{w}", F.lit(0))).alias(e) for w, e in zip(weights, edges, strict=True))), f"{label}-{step}")
    known = state.select("id", *weights)
    for part in raked:
        known = known.unionByName(part)
    for i, out in reversed(list(enumerate(compressed))):
        below = known.select(F.col("id").alias("child"), *(F.col(w).alias(f"below_{w}") for w in weights))
        found = out.join(below, "child").select("id", *((F.col(w) + F.col(f"below_{w}")).alias(w) for w in weights))
        known = known.unionByName(scratch.write(found, f"{label}-{i}-expanded"))
    return known


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row for every node of the trie of the rebuilt conversations.

    Columns: conv_id (smallest member), depth, parent_conv_id (null at the
    root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256. A
    conversation takes the first h turns of the first one of its family of 20
    (h: CRC-32 of the decimal id modulo 4) in place of its own first h.

    Turns are ordered by turn, null first, then by hashes of role and text
    (repeated rows are turns of their own). Null roles and texts are empty,
    texts count whole; rows with a null conv_id are dropped, other columns are
    ignored; an empty table gives no rows, not even a root. SHA-256 takes its
    input in order, so the ids that end at one node pass through one task as a
    sorted stream; it holds one batch of them.
    """
    scratch = Scratch(turns.sparkSession, "trie")
    members = _memberships(*rebuilt(turns, scratch), scratch)
    nodes = scratch.write(members.groupBy("d", "a", "b").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("words").alias("words"),
        F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b")), "nodes")
    key = ["up_d", "up_a", "up_b"]
    below = nodes.where("d > 0").withColumn("up_d", F.col("d") - 1)
    children = below.groupBy(*key).agg(F.count("*").alias("n_children"))
    linked = scratch.write(nodes.join(children.toDF("d", "a", "b", "n_children"), ["d", "a", "b"], "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0))), "linked")
    parents = linked.where("n_children > 0").select(
        F.col("d").alias("up_d"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    lower = linked.where("d > 0").withColumn("up_d", F.col("d") - 1)
    named = split_lookup(lower, parents, key, "n_children").drop("up_d").unionByName(
        linked.where("d = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    named = scratch.write(named, "named")
    tree = named.select(
        F.struct("conv_id", "d").alias("id"), F.when(F.col("d") > 0, F.struct(F.col("parent_conv_id").alias("conv_id"), (F.col("d") - 1).alias("d"))).alias("parent"),
        F.col("d").alias("depth"), (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    totals = subtree_totals(tree, ["n_leaves", "saved_tokens"], scratch).select("id.*", "n_leaves", "saved_tokens")
    ends = members.where("d = size").select("d", "a", "b", "conv_id").repartition("d", "a", "b").sortWithinPartitions("d", "a", "b", "conv_id")
    ends = scratch.write(ends.mapInArrow(_end_digests, "d long, a long, b long, ends_sha256 string"), "ends")
    out = named.join(totals, ["conv_id", "d"]).join(ends, ["d", "a", "b"], "left")
    return out.select("conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
