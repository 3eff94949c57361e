"""Connected components of a table of links, with a distributed label contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from groundline.llm.base import Scratch


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step: each node links its larger (or its smaller) neighbours to its smallest neighbour.

    The minimum per node combines before the shuffle; rows of a hot node are
    joined to it, where adaptive execution can split them.
    """
    if large:
        edges = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = edges.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        # a is the larger end of every link
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(id, component) for every end of a link; component is its smallest reachable id.

    ``edges`` has long columns a and b. Loops, repeated and turned links are
    allowed, null ends are dropped, no links give no rows. Alternates large-star
    and small-star steps until a round changes nothing: every node is then
    linked to its component's smallest id. Each round is written, so a lost
    executor never costs more than one round.
    """
    edges = edges.where("a is not null and b is not null").select(
        F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
    current = scratch.write(edges.where("a <> b").distinct(), f"{label}-0")
    loops = edges.where("a = b").select("a", "b")
    loops = scratch.write(loops.distinct(), f"{label}-loops")
    state, step = None, 0
    while True:
        now = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not now[0] or tuple(now) == state:
            break
        state, step = tuple(now), step + 1
        half = scratch.write(_stars(current, True), f"{label}-{step}-large")
        scratch.drop(f"{label}-{step - 1}")
        current = scratch.write(_stars(half, False), f"{label}-{step}")
        scratch.drop(f"{label}-{step}-large")
    linked = current.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = current.select(F.col("b").alias("id"), F.col("b").alias("component"))
    alone = loops.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return linked.union(roots).union(alone).groupBy("id").agg(F.min("component").alias("component"))
