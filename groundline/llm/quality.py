"""Quality scores by Bradley-Terry pairwise ranking.

A document's strength is linear in its features. Preference pairs (a good and a
bad labelled document) give a logistic loss on feature differences; scores are
cut at the quantile of training scores that the share of bad labels names. The
fit may use a sample, the quantile is that of all training rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from groundline.llm.base import Scratch, flat, ship_package, slices, word_hashes, words

#: Labelled rows of each class that the fit may use at most; the fit's memory is bounded by it.
SAMPLE_PER_CLASS = 4000
#: Pairs drawn for the loss: partners for each labelled row.
PARTNERS = 20
BINS = 12
#: score >= THRESHOLD means: at least the cut quantile.
THRESHOLD = 0.3

FEATURES = ("log_words", "word_length", "upper", "lower", "digits", "space", "symbols", "sentence_marks", "non_ascii",
            "distinct_words", "repeats_previous", "repeats_second", "words_of_capitals", "words_with_symbol_end",
            "symbol_words", "longest_repeat", "newlines", "largest_word_share")


def _classes() -> np.ndarray:
    kind = np.full(256, 6, np.uint8)
    kind[65:91], kind[97:123], kind[48:58] = 0, 1, 2
    kind[[9, 10, 11, 12, 13, 32]] = 3
    kind[[ord(c) for c in ".,;:'\"-?"]] = 5
    kind[128:] = 4
    return kind


KIND = _classes()


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=float)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES per text; empty and null texts give zeros."""
    texts = flat(texts).fill_null("")
    n = len(texts)
    encoded = [t.encode() for t in texts.to_pylist()]
    size = np.array([len(t) for t in encoded], np.int64)
    data = np.frombuffer(b"".join(encoded), np.uint8)
    kind = KIND[data]
    found, counts = words(texts, lower=False)
    hashes = word_hashes(found)
    owner = np.repeat(np.arange(n), counts)
    at_least_one = np.maximum(counts, 1)
    out = np.zeros((n, len(FEATURES)))
    long = np.maximum(size, 1)
    share = {k: _sums(kind == k, size) / long for k in range(7)}
    out[:, 0] = np.log1p(counts)
    out[:, 1] = np.log1p((size - _sums(kind == 3, size)) / at_least_one)
    out[:, 2], out[:, 3], out[:, 4], out[:, 5], out[:, 6], out[:, 7], out[:, 8] = (
        share[0], share[1], share[2], share[3], share[6], share[5], share[4])
    out[:, 16] = _sums(data == 10, size) / long
    if len(hashes):
        order = np.lexsort((hashes, owner))
        new = np.ones(len(order), bool)
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        out[:, 9] = np.bincount(owner[order][new], minlength=n) / at_least_one
        runs = np.diff(np.append(np.flatnonzero(new), len(order)))
        np.maximum.at(out[:, 17], owner[order][new], runs)
        out[:, 17] /= at_least_one
        for column, step in ((10, 1), (11, 2)):
            same = (hashes[step:] == hashes[:-step]) & (owner[step:] == owner[:-step])
            out[:, column] = np.bincount(owner[step:][same], minlength=n) / at_least_one
        change = np.ones(len(hashes), bool)
        change[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        length = np.diff(np.append(np.flatnonzero(change), len(hashes)))
        np.maximum.at(out[:, 15], owner[change], np.log(length))
        # words by the bytes they are made of
        inside = kind != 3
        starts = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]]) | inside & _text_starts(size, len(data)))
        if len(starts) == len(hashes):
            stops = np.append(starts[1:], len(data))
            last = np.maximum.accumulate(np.where(inside, np.arange(len(data)), 0))[stops - 1]
            upper, lower, symbols = (np.add.reduceat((kind == k).astype(np.int64), starts) for k in (0, 1, 6))
            letters = np.add.reduceat(((kind == 4) | (kind < 2)).astype(np.int64), starts)
            for column, values in ((12, (upper > 1) & (lower == 0)), (13, (kind[last] == 6) & (letters > 0)), (14, (letters == 0) & (symbols > 0))):
                out[:, column] = np.bincount(owner[values], minlength=n) / at_least_one
    return out


def _text_starts(size: np.ndarray, total: int) -> np.ndarray:
    out = np.zeros(total, bool)
    starts = (np.cumsum(size) - size)[size > 0]
    out[starts] = True
    return out


@dataclass(frozen=True)
class Ranker:
    """Quantile edges per feature, a weight per bin, and the raw score at the cut."""

    edges: np.ndarray
    weights: np.ndarray
    cut: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return sum((self.weights[j, np.searchsorted(self.edges[j], x[:, j], side="right")] for j in range(len(self.edges))), np.zeros(len(x)))

    def scaled(self, strength: np.ndarray) -> np.ndarray:
        """0 to 1; THRESHOLD at the cut."""
        raw = strength - self.cut + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(self.strength(x))


def fit_ranker(x: np.ndarray, good: np.ndarray, bins: int = BINS, rounds: int = 300, decay: float = 1e-4, seed: int = 7) -> Ranker:
    """Weights that minimise the mean of log(1 + exp(-(s_good - s_bad))) over drawn pairs.

    Without both classes there are no pairs: all weights are 0 and every score is above the threshold.
    """
    edges = np.stack([np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]) for j in range(x.shape[1])]) if len(x) else np.zeros((x.shape[1], bins - 1))
    width = edges.shape[1] + 1
    weights = np.zeros(edges.shape[0] * width)
    up, down = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(up) or not len(down):
        return Ranker(edges, weights.reshape(-1, width), -1.0)
    hot = np.zeros((len(x), len(weights)), np.float32)
    for j in range(len(edges)):
        hot[np.arange(len(x)), j * width + np.searchsorted(edges[j], x[:, j], side="right")] = 1
    random = np.random.default_rng(seed)
    winner = np.concatenate([np.repeat(up, PARTNERS), random.choice(up, len(down) * PARTNERS)])
    loser = np.concatenate([random.choice(down, len(up) * PARTNERS), np.repeat(down, PARTNERS)])
    momentum = np.zeros_like(weights)
    for _ in range(rounds):
        strength = hot @ weights.astype(np.float32)
        pull = 1 / (1 + np.exp(np.clip(strength[winner] - strength[loser], -30, 30)))
        per_row = np.bincount(winner, pull, len(x)) - np.bincount(loser, pull, len(x))
        slope = hot.T @ per_row.astype(np.float32) / len(winner) - decay * weights
        momentum = 0.9 * momentum + slope
        weights = weights + 8.0 * momentum
    strength = hot @ weights.astype(np.float32)
    return Ranker(edges, weights.reshape(-1, width), quantile_cut(strength, good))


def quantile_cut(strength: np.ndarray, good: np.ndarray) -> float:
    """Score at the quantile of training scores where as many lie below as are labelled bad.

    Each class counts as in the sample; the cut is halfway between the neighbours.
    """
    order = np.sort(strength)
    below = int((~good).sum())
    return float((order[below - 1] + order[min(below, len(order) - 1)]) / 2)


def held_out(doc_id: str = "doc_id", parts: int = 5):
    """Rows whose crc32 of the doc_id as text is divisible by ``parts`` (a null doc_id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts == 0


def _featured(docs: DataFrame) -> DataFrame:
    """(doc_id, x): features of whole texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = features(part.column("text"))
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                yield pa.RecordBatch.from_arrays([flat(part.column("doc_id")), flat(part.column("good")), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))],
                                                 names=["doc_id", "good", "x"])
    return docs.mapInArrow(run, "doc_id long, good boolean, x array<double>")


def _votes(labels: DataFrame, folds: int) -> DataFrame:
    """(doc_id, good) of every labelled document that is not held out."""
    return (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
            .where("doc_id is not null and quality is not null").where(~held_out("doc_id", folds))
            .groupBy("doc_id").agg((F.min("quality") > 0).alias("good")))


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, folds: int = 5) -> Ranker:
    """Ranker from labelled documents that are not held out.

    The weights use at most ``per_class`` labels of either class, those of the
    smallest hash of their doc_id, so the labels sent to the scan and the rows
    that come back are bounded. A document with several labels counts as bad if
    one says so; labels that are null or name no document are not used. The cut
    is that of the sample; ``population_cut`` gives that of all training rows.
    """
    voted = _votes(labels, folds)
    chosen = None
    for value in (True, False):
        rows = voted.where(F.col("good") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = rows if chosen is None else chosen.union(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = _featured(texts.join(F.broadcast(chosen), "doc_id")).orderBy("doc_id").limit(4 * per_class).toArrow()
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    return fit_ranker(x, np.array(rows.column("good").to_pylist(), bool))


def order_keys(strength: np.ndarray) -> np.ndarray:
    """Integers in the order of the strengths."""
    bits = (strength + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFF_FFFF_FFFF_FFFF), bits)


def _strengths(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """(doc_id, held_out, strength, key) for every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                strength = ranker.strength(features(part.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [flat(part.column("doc_id")), flat(part.column("held_out")), pa.array(strength), pa.array(order_keys(strength))],
                    names=["doc_id", "held_out", "strength", "key"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, held_out boolean, strength double, key long")


def _nth_key(keys: DataFrame, n: int) -> int:
    """The key with ``n`` smaller or equal ones before it, 16 bits a step: at most 65,536 counts reach the driver."""
    prefix = None
    for shift in (48, 32, 16, 0):
        rows = keys if prefix is None else keys.where(F.shiftright("key", shift + 16) == prefix)
        for prefix, count in sorted(map(tuple, rows.groupBy(F.shiftright("key", shift).alias("prefix")).agg(F.count("*").alias("n")).collect())):
            if n < count:
                break
            n -= count
    return prefix


def population_cut(strengths: DataFrame, labels: DataFrame, scratch: Scratch, folds: int = 5) -> float | None:
    """``quantile_cut`` over every labelled row that is not held out; None if a class has no rows.

    ``strengths``: stored (doc_id, key), one for each row of the documents.
    """
    # ids and labels grow with the documents: never a broadcast
    trained = scratch.write(strengths.select("doc_id", "key").join(_votes(labels, folds).hint("merge"), "doc_id").select("key", "good"), "trained")
    total, below = trained.agg(F.count("*"), F.count_if(~F.col("good"))).first()
    if below in (0, total):
        return None
    low = _nth_key(trained, below - 1)
    up_to, above = trained.agg(F.count_if(F.col("key") <= low), F.min(F.when(F.col("key") > low, F.col("key")))).first()
    high = low if up_to > below or above is None else above
    bits = np.array([low, high], np.int64)
    return float(np.where(bits < 0, bits ^ np.int64(0x7FFF_FFFF_FFFF_FFFF), bits).view(np.float64).sum() / 2)


def _at_population(ranker: Ranker, strengths: DataFrame, labels: DataFrame, scratch: Scratch) -> Ranker:
    cut = population_cut(strengths, labels, scratch)
    return ranker if cut is None or not ranker.weights.any() else replace(ranker, cut=cut)


def score_documents(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every input row, from its whole text alone.

    Null and empty texts have zero features and a score too; repeated rows give
    repeated results; other columns are ignored. The fit reads the sampled texts
    by a broadcast of at most ``2 * per_class`` labels. Strengths are written
    once; only the ids and strengths of labelled rows are shuffled, for the cut.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    ranker = train(docs, labels, per_class)
    strengths = scratch.write(_strengths(docs, ranker), "strengths")
    ranker = _at_population(ranker, strengths, labels, scratch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = ranker.scaled(batch.column("strength").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"])

    return strengths.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """The rows with a score of at least THRESHOLD, all columns unchanged.

    Texts are read three times (fit, cut, result) and never shuffled.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    ranker = train(docs, labels, per_class)
    strengths = scratch.write(_strengths(docs.where(F.col("doc_id").isNotNull() & ~held_out()), ranker), "strengths")
    ranker = _at_population(ranker, strengths, labels, scratch)
    scratch.drop("strengths", "trained")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(ranker.score(features(part.column("text"))) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
