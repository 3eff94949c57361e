"""Near-duplicate documents: MinHash with tensored banding, links confirmed on full shingle sets.

Two collections of ``SIDE`` small sketches (``DEPTH`` minhashes each) are
computed; every pair of one sketch from each collection is the key of a hash
table. ``SIDE`` squared tables of 2 * DEPTH minhashes thus cost only
2 * SIDE * DEPTH minhashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from groundline.llm.base import Scratch, flat, mix, slices, word_hashes, words
from groundline.llm.components import components
from groundline.operators.ordering import split_lookup

SIDE, DEPTH = 10, 2
#: Clusters up to this size are compared in one task; larger ones in blocks of about half of it.
GROUP = 512
PIVOTS = 32
#: A table hit leads to a comparison if at least this share of all minhashes agrees. For a pair at
#: the similarity of 0.8, 16 or fewer of 40 agree with a probability of about 4e-8.
LEAST_AGREEMENT = 0.4

SKETCHES = "doc_id long, n_shingles long, set_a long, set_b long, sketch array<long>"


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after the other, and their number.

    A text with fewer words has its whole word sequence as one shingle, a text without words none.
    """
    found, counts = words(texts)
    hashes = word_hashes(found)
    n_text = len(counts)
    ends = np.cumsum(counts)
    number = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    full = len(hashes) - size + 1
    rolled = np.zeros(max(full, 0), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            rolled = mix(rolled + hashes[i:i + full] * np.uint64(2 * i + 3)) if full > 0 else rolled
        doc = np.repeat(np.arange(n_text), counts)
        at = np.arange(max(full, 0))
        inside = at + size <= ends[doc[:full]] if full > 0 else np.zeros(0, bool)
        values, owner = rolled[inside], doc[:max(full, 0)][inside]
        short = np.flatnonzero((counts > 0) & (counts < size))
        extra = np.zeros(len(short), np.uint64)
        for k, t in enumerate(short.tolist()):
            for i in range(int(counts[t])):
                extra[k] = mix(extra[k:k + 1] + hashes[ends[t] - counts[t] + i:ends[t] - counts[t] + i + 1] * np.uint64(2 * i + 3))[0]
            extra[k] = mix(extra[k:k + 1] ^ np.uint64(int(counts[t])))[0]
    values, owner = np.concatenate([values, extra]), np.concatenate([owner, short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[keep], owner[keep]
    return values, np.bincount(owner, minlength=n_text) if n_text else number


def minhash_sketches(values: np.ndarray, counts: np.ndarray, side: int, depth: int) -> np.ndarray:
    """2 * side sketches per non-empty set; a sketch packs ``depth`` (1 or 2) 32-bit minhashes."""
    starts = (np.cumsum(counts) - counts)[counts > 0]
    random = np.random.default_rng(20240229)
    out = np.zeros((len(starts), 2 * side), np.uint64)
    with np.errstate(over="ignore"):
        for column in range(2 * side):
            for _ in range(depth):
                factor, shift = random.integers(1, 1 << 63, 2, dtype=np.uint64)
                hashed = values * (factor | np.uint64(1)) + shift
                hashed ^= hashed >> np.uint64(29)
                hashed *= np.uint64(0x9E3779B97F4A7C15)
                least = np.minimum.reduceat((hashed >> np.uint64(32)).astype(np.uint32), starts) if len(starts) else np.zeros(0, np.uint32)
                out[:, column] = (out[:, column] << np.uint64(32)) | least
    return out.view(np.int64)


def set_identity(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each set; zeros for empty ones."""
    totals = np.zeros((2, len(counts)), np.uint64)
    some = counts > 0
    if some.any():
        starts = (np.cumsum(counts) - counts)[some]
        totals[0, some] = np.add.reduceat(mix(values ^ np.uint64(0x5851F42D4C957F2D)), starts)
        totals[1, some] = np.bitwise_xor.reduceat(mix(values + np.uint64(0x14057B7EF767814F)), starts)
    return totals.view(np.int64)


def _sketch(size: int, side: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                values, counts = shingles(part.column("text"), size)
                some = counts > 0
                totals = set_identity(values, counts)
                flat_sketch = minhash_sketches(values, counts, side, depth).ravel()
                offsets = np.concatenate([[0], np.cumsum(some * 2 * side)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [flat(part.column("doc_id")), pa.array(counts.astype(np.int64)), pa.array(totals[0]), pa.array(totals[1]),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat_sketch))],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "sketch"])
    return run


def class_sets(size: int):
    """Sets of rows whose text is the one of their class (a doc_id may have other texts, too)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                values, counts = shingles(part.column("text"), size)
                ends, found = np.cumsum(counts), set_identity(values, counts)
                own = (found[0] == part.column("set_a").to_numpy()) & (found[1] == part.column("set_b").to_numpy())
                packed = [values[ends[i] - counts[i]:ends[i]].tobytes() for i in np.flatnonzero(own)]
                rows = part.filter(pa.array(own))
                yield pa.RecordBatch.from_arrays([flat(rows.column("cluster")), flat(rows.column("doc")), pa.array(packed, pa.binary())],
                                                 names=["cluster", "doc", "shingle_set"])
    return run


def linked_pairs(left: list[np.ndarray], right: list[np.ndarray], percent: int, columns: int = 4096) -> np.ndarray:
    """Which pairs of sets have 100 * intersection >= percent * union; intersections by matrix products."""
    n_left, n_right = (np.array([len(s) for s in side]) for side in (left, right))
    a, b = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(a, b)
    shared = np.zeros((len(left), len(right)), np.float32)
    rows_a, rows_b = np.repeat(np.arange(len(left)), n_left), np.repeat(np.arange(len(right)), n_right)
    at_a, at_b = np.searchsorted(common, a), np.searchsorted(common, b)
    in_a = (at_a < len(common)) & (common[np.minimum(at_a, len(common) - 1)] == a) if len(common) else np.zeros(len(a), bool)
    in_b = (at_b < len(common)) & (common[np.minimum(at_b, len(common) - 1)] == b) if len(common) else np.zeros(len(b), bool)
    at_a, rows_a, at_b, rows_b = at_a[in_a], rows_a[in_a], at_b[in_b], rows_b[in_b]
    for start in range(0, len(common), columns):
        width = min(columns, len(common) - start)
        x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        part_a, part_b = (at_a >= start) & (at_a < start + width), (at_b >= start) & (at_b < start + width)
        x[rows_a[part_a], at_a[part_a] - start] = 1
        y[rows_b[part_b], at_b[part_b] - start] = 1
        shared += x @ y.T
    shared = shared.astype(np.int64)
    return 100 * shared >= percent * (n_left[:, None] + n_right[None, :] - shared)


def spanning_links(ids: np.ndarray, left: np.ndarray, right: np.ndarray, linked: np.ndarray) -> pa.Table:
    """For each group of rows joined by links: a link from every row to the smallest id of its group."""
    label = ids.copy()
    while True:
        new = label.copy()
        high = np.iinfo(np.int64).max
        np.minimum.at(new, left, np.where(linked, label[right][None, :], high).min(1, initial=high))
        np.minimum.at(new, right, np.where(linked, label[left][:, None], high).min(0, initial=high))
        if (new == label).all():
            break
        label = new
    some = label != ids
    return pa.table({"a": pa.array(ids[some]), "b": pa.array(label[some])})


def _compare(percent: int):
    """Links among the rows of a group; with sides, only between side 0 and side 1."""
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("doc").to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in table.column("shingle_set").to_pylist()]
        side = table.column("side").to_numpy()
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        if not len(left) or not len(right):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        return spanning_links(ids, left, right, linked_pairs([sets[i] for i in left], [sets[i] for i in right], percent))
    return run


def _candidate_clusters(classes: DataFrame, scratch: Scratch, side: int) -> DataFrame:
    """(id, component): sets that tables bring together, directly or through others."""
    keys = (classes.select("doc", "sketch")
            .select("doc", "sketch", F.posexplode(F.slice("sketch", 1, side)).alias("i", "x"))
            .select("doc", "i", "x", F.posexplode(F.slice("sketch", side + 1, side)).alias("j", "y"))
            .select("doc", F.xxhash64("i", "j", "x", "y").alias("key")))
    # two pivots a bucket; both combine before the shuffle
    buckets = keys.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high")
    hits = keys.join(buckets.hint("merge"), "key")
    pairs = scratch.write(hits.select("doc", F.explode(F.array("low", "high")).alias("pivot")).where("doc <> pivot").select(
        F.greatest("doc", "pivot").alias("a"), F.least("doc", "pivot").alias("b")).distinct(), "pairs")
    sketch = classes.select("doc", "sketch")
    low = F.lit(0xFFFFFFFF)
    # these sides grow with the documents: never a broadcast, whatever their number
    agree = F.aggregate(
        F.zip_with("x", "y", lambda x, y: (x.bitwiseAND(low) == y.bitwiseAND(low)).cast("int")
                   + (F.shiftrightunsigned(x, 32) == F.shiftrightunsigned(y, 32)).cast("int")),
        F.lit(0), lambda t, v: t + v)
    close = (pairs.join(sketch.select(F.col("doc").alias("a"), F.col("sketch").alias("x")).hint("merge"), "a")
             .join(sketch.select(F.col("doc").alias("b"), F.col("sketch").alias("y")).hint("merge"), "b")
             .where(agree >= LEAST_AGREEMENT * 4 * side).select("a", "b"))
    return components(close, scratch, "cluster")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, side: int = SIDE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every input row.

    Documents are linked if 100 * |intersection| >= percent * |union| of their
    distinct word shingles (words without case of A-Z). component_id is the
    smallest doc_id that links reach, kept marks it. Null or empty texts have no
    shingles and only themselves. Rows with the same doc_id are one node of the
    links and give one row each; a null doc_id has a null component and is kept.
    Other columns are ignored; an empty table gives no rows.

    Equal sets are one class from the start, so copies never meet in a table. A
    pair at exactly the threshold misses all tables with a probability of about
    2 * (1 - 0.8 ** DEPTH) ** SIDE = 7e-5, closer pairs far less. Tables only send
    each class to two pivots per bucket; that forms clusters. Small clusters are
    compared whole in one task. A large one is compared with some pivots first;
    then only documents outside its main component are compared with all of it,
    in blocks spread over tasks, and just a spanning set of links is emitted.
    """
    scratch = Scratch(docs.sparkSession, "near")
    source = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    # a class is named by its set: two texts of one doc_id stay apart until their links are known
    doc = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.xxhash64("set_a", "set_b"))
    sketches = scratch.write(source.mapInArrow(_sketch(shingle_words, side, DEPTH), SKETCHES).withColumn("doc", doc), "sketches")
    whole = sketches.where("doc is not null")
    classes = scratch.write(whole.groupBy("doc").agg(
        F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.min("set_a").alias("set_a"), F.min("set_b").alias("set_b"),
        F.min("sketch").alias("sketch")), "classes")
    clusters = scratch.write(_candidate_clusters(classes, scratch, side), "clusters")
    sizes = clusters.groupBy("component").count()
    members = classes.select("doc", F.col("least").alias("doc_id"), "set_a", "set_b").join(
        clusters.select(F.col("id").alias("doc"), F.col("component").alias("cluster")).hint("merge"), "doc")
    sets = scratch.write(
        source.join(members.hint("merge"), "doc_id").select("cluster", "doc", "set_a", "set_b", "text")
        .mapInArrow(class_sets(shingle_words), "cluster long, doc long, shingle_set binary"), "sets")
    sized = sets.join(sizes.select(F.col("component").alias("cluster"), F.col("count").alias("size")), "cluster")
    compare, schema = _compare(percent), "a long, b long"
    links = scratch.write(
        sized.where(F.col("size") <= GROUP).select("cluster", "doc", "shingle_set", F.lit(2).alias("side"))
        .groupBy("cluster").applyInArrow(compare, schema), "links-small")

    large = sized.where(F.col("size") > GROUP).withColumn("blocks", F.ceil(F.col("size") * 2 / GROUP).cast("int"))
    block = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")
    is_pivot = F.pmod(F.xxhash64("doc", F.lit(1)), F.ceil(F.col("size") / PIVOTS)) == 0
    pivots = large.where(is_pivot).select("cluster", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
                                          "doc", "shingle_set", F.lit(0).alias("side"))
    rest = large.select("cluster", block.alias("block"), "doc", "shingle_set", F.lit(1).alias("side"))
    first = scratch.write(pivots.union(rest).groupBy("cluster", "block").applyInArrow(compare, schema), "links-pivots")

    part = scratch.write(
        large.select("cluster", "blocks", "doc").distinct()
        .join(components(first, scratch, "large").withColumnRenamed("id", "doc"), "doc", "left")
        .select("cluster", "blocks", "doc", F.coalesce("component", "doc").alias("component")), "large-parts")
    main = (part.groupBy("cluster", "component").count().groupBy("cluster")
            .agg(F.max_by("component", F.struct("count", "component")).alias("main")))
    outside = part.join(main, "cluster").where("component <> main").select("cluster", "doc")
    n_outside = outside.groupBy("cluster").agg(F.ceil(F.count("*") * 2 / GROUP).cast("int").alias("out_blocks"))
    cells = large.join(n_outside, "cluster")
    out_block = F.pmod(F.xxhash64("doc"), F.col("out_blocks")).cast("int")
    left = cells.join(outside, ["cluster", "doc"], "left_semi").select(
        "cluster", out_block.alias("out_block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        "doc", "shingle_set", F.lit(0).alias("side"))
    right = cells.select("cluster", F.explode(F.sequence(F.lit(0), F.col("out_blocks") - 1)).alias("out_block"), block.alias("block"),
                         "doc", "shingle_set", F.lit(1).alias("side"))
    second = scratch.write(left.union(right).groupBy("cluster", "out_block", "block").applyInArrow(compare, schema), "links-rest")
    scratch.drop("sets")

    # rows of one doc_id with different texts are one node: tie their classes together
    several = whole.groupBy("doc_id").agg(F.min("doc").alias("b"), F.max("doc").alias("other")).where("b <> other").select("doc_id", "b")
    ties = whole.join(several, "doc_id").select(F.col("doc").alias("a"), "b").where("a <> b")
    joined = scratch.write(components(links.union(first).union(second).union(ties), scratch, "links"), "joined")
    named = scratch.write(classes.select("doc", "least", "copies").join(
        joined.select(F.col("id").alias("doc"), F.col("component").alias("top")), "doc", "left").withColumn("top", F.coalesce("top", "doc")), "named")
    # hot components and hot copies are looked up without a shuffle of their rows
    smallest = named.groupBy("top").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = scratch.write(split_lookup(named, smallest, ["top"], "n").select("doc", "copies", "component_id"), "components")
    found = split_lookup(whole.select("doc_id", "n_shingles", "doc"), named, ["doc"], "copies").select("doc_id", "n_shingles", "component_id")
    out = found.unionByName(sketches.where("doc is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
