"""N-gram Jaccard join with signature trees.

Sets are brought together by exact keys first: two sets with few differing
shingles agree in at least one of as many parts, plus one, of their shingles.
Within such a cluster a signature tree is built: its nodes hold the OR of their
sets' bitmaps and ranges of size. A traversal of node pairs, from the top down,
drops pairs whose sets cannot overlap enough; remaining pairs of sets are
compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from groundline.llm.base import Scratch, flat, mix, ragged, slices
from groundline.llm.components import components
from groundline.llm.near import class_sets, set_identity, shingles
from groundline.llm.ranks import ranked
from groundline.operators.ordering import split_lookup

#: Sets of a cluster that a tree takes; larger clusters are cut into blocks of about half of it.
GROUP = 512
PIVOTS = 32
FANOUT = 8
#: Bits of a bitmap for each shingle of a cluster's largest set, and their limits.
BITS_PER_SHINGLE, LEAST_BITS, MOST_BITS = 8, 256, 1 << 16
#: Pairs of sets that are looked at together.
PAIRS = 1 << 16

ROWS = "doc_id long, n_shingles long, set_a long, set_b long, keys array<long>"


@lru_cache
def size_classes(percent: int, limit: int = 1 << 40) -> np.ndarray:
    """Smallest size of each class; partners of a set are in its class or a neighbouring one."""
    lows = [1]
    while lows[-1] < limit:
        lows.append(lows[-1] * 100 // percent + 1)
    return np.array(lows, np.int64)


def part_keys(values: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each set, one set after the other, and their number.

    A linked pair with sizes x <= y has y <= 100 x / percent and differs in at
    most x * (100 - percent) / percent shingles. For the class of x that number
    is at most d, so that of d + 1 parts at least one is the same in both. A set
    is keyed as the smaller one (its class) and as the larger one (its class and
    the class below). Classes with d = 0 only link equal sets and need no keys.
    """
    lows = size_classes(percent)
    own = np.searchsorted(lows, counts, side="right") - 1
    ends = np.cumsum(counts)
    keys, owner = [], []
    with np.errstate(over="ignore"):
        for down in (0, 1):
            level = own - down
            fit = np.flatnonzero((counts > 0) & (level >= 0))
            high = lows[level[fit] + 1] - 1
            parts = high * (100 - percent) // percent + 1
            fit, level, parts = fit[parts > 1], level[fit][parts > 1], parts[parts > 1]
            if not len(fit):
                continue
            first = np.cumsum(parts) - parts
            sums = np.zeros(int(parts.sum()), np.uint64)
            chosen = values[ragged(ends[fit] - counts[fit], counts[fit])]
            n = np.repeat(parts, counts[fit]).astype(np.uint64)
            part = (mix(chosen ^ np.uint64(0x2545F4914F6CDD1D)) % n).astype(np.int64) + np.repeat(first, counts[fit])
            np.add.at(sums, part, mix(chosen + np.uint64(0x9E3779B97F4A7C15)))
            place = np.arange(len(sums)) - np.repeat(first, parts)
            name = (np.repeat(level, parts) << 40) + place
            keys.append(mix(sums ^ mix(name.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))))
            owner.append(np.repeat(fit, parts))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(len(counts), np.int64)
    keys, owner = np.concatenate(keys), np.concatenate(owner)
    return keys[np.argsort(owner, kind="stable")].view(np.int64), np.bincount(owner, minlength=len(counts))


def _keyed(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                values, counts = shingles(part.column("text"), size)
                counts = counts.astype(np.int64)
                totals = set_identity(values, counts)
                keys, n = part_keys(values, counts, percent)
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [flat(part.column("doc_id")), pa.array(counts), *(pa.array(t) for t in totals),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys))],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "keys"])
    return run


class Tree:
    """Levels of nodes over sets, from the sets upwards; order keeps like sets together (least shingle first)."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        self.order = np.array(sorted(range(len(sets)), key=lambda i: (int(sets[i][0]), len(sets[i]))), np.int64)
        sizes = np.array([len(sets[i]) for i in self.order], np.int64)
        maps = np.zeros((len(sets), bits // 8), np.uint8)
        for row, i in enumerate(self.order):
            one = np.zeros(bits, bool)
            one[(mix(sets[i]) % np.uint64(bits)).astype(np.int64)] = True
            maps[row] = np.packbits(one)
        maps = maps.view(np.uint64)
        # a set's shingles that share a bit with another one: what a bitmap may hide
        hidden = sizes - np.bitwise_count(maps).sum(1, dtype=np.int64)
        self.levels = [(maps, sizes, sizes, hidden)]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, hidden = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(hidden, at)))


def possible(left: tuple, i: np.ndarray, right: tuple, j: np.ndarray, percent: int) -> np.ndarray:
    """Which node pairs may hold a linked pair, by size ranges and the largest possible overlap.

    Of a set's shingles at most those with a bit in both nodes, and as many as
    its own bits hide, can be in a set of the other node.
    """
    maps, low, high, hidden = left
    maps_, low_, high_, hidden_ = right
    fit = (100 * high[i] >= percent * low_[j]) & (100 * high_[j] >= percent * low[i])
    at = np.flatnonzero(fit)
    i, j = i[at], j[at]
    common = np.empty(len(at), np.int64)
    step = max(1, (8 << 20) // max(1, maps.shape[1] * 8))
    for s in range(0, len(at), step):
        common[s:s + step] = np.bitwise_count(maps[i[s:s + step]] & maps_[j[s:s + step]]).sum(1, dtype=np.int64)
    overlap = np.minimum(common + np.minimum(hidden[i], hidden_[j]), np.minimum(high[i], high_[j]))
    fit[at] = (100 + percent) * overlap >= percent * (low[i] + low_[j])
    return fit


def candidate_pairs(left: Tree, right: Tree, same: bool, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places (in the trees' orders) that the traversal leaves, in batches of bounded size."""
    def children(node: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
        first = node * FANOUT
        return first, np.minimum(first + FANOUT, below) - first

    stack = [(len(left.levels) - 1, len(right.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        a, b, i, j = stack.pop()
        if len(i) > PAIRS:
            stack += [(a, b, i[s:s + PAIRS], j[s:s + PAIRS]) for s in range(0, len(i), PAIRS)]
            continue
        fit = possible(left.levels[a], i, right.levels[b], j, percent)
        i, j = i[fit], j[fit]
        if a == b == 0:
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j
            continue
        if not len(i):
            continue
        if a >= b:
            first, n = children(i, len(left.levels[a - 1][0]))
            i, j, a = ragged(first, n), np.repeat(j, n), a - 1
            if same and a == b:
                i, j = i[i <= j], j[i <= j]
        else:
            first, n = children(j, len(right.levels[b - 1][0]))
            i, j, b = np.repeat(i, n), ragged(first, n), b - 1
            if same and a == b:
                i, j = i[i <= j], j[i <= j]
        stack.append((a, b, i, j))


def is_linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on full sorted sets."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    at = np.searchsorted(large, small)
    shared = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def tree_links(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join the same sets as all links do: pairs already joined are not compared again.

    Sides 0 and 1 are only compared with each other, side 2 with itself.
    """
    bits = LEAST_BITS
    while bits < min(MOST_BITS, BITS_PER_SHINGLE * max(map(len, sets))):
        bits *= 2
    same = bool((side == 2).any())
    groups = [np.arange(len(ids))] if same else [np.flatnonzero(side == 0), np.flatnonzero(side == 1)]
    if any(not len(g) for g in groups):
        return []
    trees = [Tree([sets[k] for k in g], bits) for g in groups]
    left, right = trees[0], trees[-1]
    rows, columns = groups[0][left.order], groups[-1][right.order]
    # rows of one node id are one from the start
    label = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    out = []
    for i, j in candidate_pairs(left, right, same, percent):
        i, j = rows[i], columns[j]
        while len(i):
            open_ = label[i] != label[j]
            i, j = i[open_], j[open_]
            # one partner for each row at a time: what they join is not compared again
            turn, rest = np.unique(i, return_index=True)[1], np.ones(len(i), bool)
            rest[turn] = False
            for k in turn.tolist():
                p, q = int(i[k]), int(j[k])
                if label[p] != label[q] and is_linked(sets[p], sets[q], percent):
                    out.append((int(ids[p]), int(ids[q])))
                    label[label == label[q]] = label[p]
            i, j = i[rest], j[rest]
    return out


def _join(percent: int):
    def run(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(s, np.uint64) for s in table.column("shingle_set").to_pylist()]
        found = tree_links(table.column("node").to_numpy(), sets, table.column("side").to_numpy(), percent)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})
    return run


def _clusters(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component): sets that share a key, directly or through others; every linked pair is in one."""
    keys = classes.select("node", F.explode("keys").alias("key"))
    # the least set of a key combines before the shuffle; the others are tied to it
    buckets = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key", "low")
    ties = scratch.write(keys.join(buckets.hint("merge"), "key").where("node <> low").select(
        F.col("node").alias("a"), F.col("low").alias("b")).distinct(), "ties")
    return components(ties, scratch, "cluster")


def jaccard_join(docs: DataFrame, shingle_words: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every input row.

    Documents are linked if 100 * |intersection| >= percent * |union| of their
    distinct word shingles (words without case of A-Z; a text with fewer words
    is one shingle). component_id is the smallest doc_id that links reach. No
    link between different sets is missed, but for equal 64-bit hashes of
    shingles. Null texts and texts without words have no shingles and only
    themselves. Rows with the same doc_id are one node of the links, whatever
    their texts, and give one row each; a null doc_id has a null component.
    Texts are read whole; other columns are ignored; an empty table gives no rows.

    Equal sets are one class from the start. Clusters of up to ``GROUP`` classes
    are one tree; those of more are cut into blocks, each compared with some
    pivots first; then only what is outside the cluster's main component is
    compared with all blocks.
    """
    scratch = Scratch(docs.sparkSession, "signature")
    source = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    node = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.xxhash64("set_a", "set_b"))
    rows = scratch.write(source.mapInArrow(_keyed(shingle_words, percent), ROWS).withColumn("node", node), "rows")
    whole = rows.where("node is not null")
    classes = scratch.write(whole.groupBy("node").agg(
        F.min("doc_id").alias("doc"), F.count("*").alias("copies"), F.min("n_shingles").alias("size"),
        F.min("set_a").alias("set_a"), F.min("set_b").alias("set_b"), F.first("keys").alias("keys")), "classes")
    clusters = scratch.write(_clusters(classes, scratch), "clusters").withColumnsRenamed({"id": "node", "component": "cluster"})
    many = clusters.groupBy("cluster").agg(F.count("*").alias("sets"))
    members = scratch.write(classes.select("node", "doc", "size", "set_a", "set_b").join(clusters.hint("merge"), "node"), "members")
    wanted = members.select(F.col("doc").alias("doc_id"), "cluster", "node", "set_a", "set_b")
    sets = scratch.write(source.join(wanted.hint("merge"), "doc_id").select("cluster", F.col("node").alias("doc"), "set_a", "set_b", "text")
                         .mapInArrow(class_sets(shingle_words), "cluster long, doc long, shingle_set binary").withColumnRenamed("doc", "node"), "sets")
    if sets.count() > members.count():  # repeated rows
        sets = scratch.write(sets.groupBy("cluster", "node").agg(F.min("shingle_set").alias("shingle_set")), "sets-once")
    join, schema = _join(percent), "a long, b long"
    small = sets.join(many.where(F.col("sets") <= GROUP).select("cluster"), "cluster")
    links = scratch.write(small.withColumn("side", F.lit(2)).groupBy("cluster").applyInArrow(join, schema), "links-small")
    links = links.unionByName(_large_links(sets, members, many.where(F.col("sets") > GROUP), percent, scratch))

    # different texts of one doc_id are one node of the links
    several = whole.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("other")).where("b <> other").select("doc_id", "b")
    links = links.unionByName(whole.join(several, "doc_id").select(F.col("node").alias("a"), "b").where("a <> b"))
    joined = scratch.write(components(links, scratch, "links"), "joined").withColumnsRenamed({"id": "node", "component": "top"})
    named = scratch.write(classes.select("node", "doc", "copies").join(joined, "node", "left").withColumn("top", F.coalesce("top", "node")), "named")
    least = named.groupBy("top").agg(F.min("doc").alias("component_id"), F.count("*").alias("n"))
    named = scratch.write(split_lookup(named, least, ["top"], "n").select("node", "copies", "component_id"), "components")
    found = split_lookup(whole.select("doc_id", "n_shingles", "node"), named, ["node"], "copies").select("doc_id", "n_shingles", "component_id")
    return found.unionByName(rows.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def _large_links(sets: DataFrame, members: DataFrame, many: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links that join large clusters: pivots with every block, then what is outside the main component.

    Blocks follow the size of the sets, so that only blocks with matching size
    ranges meet; these ranges and pairs are rows of blocks, not of sets.
    """
    join, schema, width = _join(percent), "a long, b long", GROUP // 2
    placed = scratch.write(members.join(many, "cluster").select("cluster", "node", "size", "sets"), "large")
    if placed.isEmpty():
        return sets.sparkSession.createDataFrame([], schema)
    placed = scratch.write(ranked(placed, scratch, "large-ranked", "cluster", ["size", "node"]).withColumn(
        "block", F.expr(f"rank div {width}")), "large-blocks")
    large = scratch.write(sets.join(placed.select("cluster", "node", "block", "size", "sets").hint("merge"), ["cluster", "node"]), "large-sets")
    blocks = placed.groupBy("cluster", "block").agg(F.min("size").alias("low"), F.max("size").alias("high"))

    def meeting(left: DataFrame) -> DataFrame:
        """Rows of ``left`` (cluster, part, size) once for each block with a size range that may hold partners."""
        near = (100 * F.col("high") >= percent * F.col("size")) & (100 * F.col("size") >= percent * F.col("low"))
        return left.join(blocks, "cluster").where(near).drop("low", "high")

    def compared(left: DataFrame, label: str) -> DataFrame:
        """Links between ``left`` (cluster, part, node, size) and all sets, a task for each part and block."""
        cells = scratch.write(meeting(left.select("cluster", "part", "size").distinct()).select("cluster", "part", "block").distinct(), f"{label}-cells")
        columns = ["cluster", "part", "block", "node", "shingle_set"]
        one = large.drop("block").join(left.select("cluster", "part", "node"), ["cluster", "node"]).join(cells, ["cluster", "part"]).select(*columns, F.lit(0).alias("side"))
        other = large.join(cells, ["cluster", "block"]).select(*columns, F.lit(1).alias("side"))
        return scratch.write(one.unionByName(other).groupBy("cluster", "part", "block").applyInArrow(join, schema), label)

    pivots = placed.where(F.pmod(F.xxhash64("node", F.lit(1)), F.ceil(F.col("sets") / PIVOTS)) == 0)
    first = compared(pivots.select("cluster", F.lit(0).cast("long").alias("part"), "node", "size"), "links-pivots")
    parts = scratch.write(
        placed.select("cluster", "node", "size").join(components(first, scratch, "large").withColumnRenamed("id", "node"), "node", "left")
        .select("cluster", "node", "size", F.coalesce("component", "node").alias("component")), "large-parts")
    main = (parts.groupBy("cluster", "component").count().groupBy("cluster")
            .agg(F.max_by("component", F.struct("count", "component")).alias("main")))
    outside = scratch.write(parts.join(main, "cluster").where("component <> main").select("cluster", "node", "size"), "outside")
    dealt = ranked(outside, scratch, "outside-ranked", "cluster", ["size", "node"]).select("cluster", F.expr(f"rank div {width}").alias("part"), "node", "size")
    return first.unionByName(compared(scratch.write(dealt, "outside-parts"), "links-rest"))
