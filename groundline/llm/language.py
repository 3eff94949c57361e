"""Language-model scores by deleted interpolation.

Maximum-likelihood bigram, unigram and uniform estimates are mixed; the weights
depend on how often the context occurs and are learned by expectation
maximisation on the counts of documents that were left out of the estimates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from groundline.llm.base import Scratch, flat, mix, text_bytes, word_hashes, words
from groundline.llm.blocks import ASKED, BLOCK_BYTES, BUCKET_BYTES, answer_all, blocked, in_order, request, unpacked, with_answers

#: Kinds of documents: counted, left out for the weights, not learned from.
COUNTED, LEFT_OUT, UNSEEN = 0, 1, 2
FOLDS = 10
#: Buckets of context counts: 0, 1, 2-3, 4-7, ...; the last is open.
CONTEXT_BUCKETS = 16
#: Cells per doubling in the table of estimates that the weights are learned from.
STEPS = 4
LEAST_LOG2 = -40
START, END = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x6A09E667F3BCC909)

SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def fold(column: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % FOLDS


def block_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unigram keys, bigram keys and tokens per text (words, then one end).

    Each text begins with a start mark in the unigram keys (its lowest two bits
    are 0; those of words are 1), so position i's context is position i - 1.
    Bigram keys end in 2 and stand at the position of their second token.
    """
    found, counts = words(texts)
    n = len(counts)
    total = len(found) + 2 * n
    ends = np.cumsum(counts + 2)
    starts = ends - counts - 2
    tokens = np.empty(total, np.uint64)
    mark = np.zeros(total, bool)
    mark[starts] = mark[ends - 1] = True
    tokens[~mark] = word_hashes(found)
    tokens[starts], tokens[ends - 1] = START, END
    low = np.uint64(3)
    mixed = mix(tokens)
    unigram = (mixed & ~low) | np.uint64(1)
    unigram[starts] = mixed[starts] & ~low
    with np.errstate(over="ignore"):
        bigram = (mix(np.roll(mixed, 1) * np.uint64(3) + tokens) & ~low) | np.uint64(2)
    bigram[starts] = unigram[starts]
    return unigram, bigram, counts + 1


def _keys(unigram: np.ndarray, bigram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a block in order, with their counts (start marks are counted once a text)."""
    return np.unique(np.concatenate([unigram, bigram[(bigram & np.uint64(3)) == 2]]), return_counts=True)


def _ask(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        unigram, bigram, _ = block_tokens(table.column("text"))
        keys, counts = _keys(unigram, bigram)
        return request(table.column("block")[0].as_py(), keys, [counts.astype(np.uint32)], buckets)
    return run


def _answer(table: pa.Table) -> pa.Table:
    """Counts of each asked key: counted documents, left-out documents. Block -1: totals of the bucket."""
    asked = list(unpacked(table))
    keys, place = np.unique(np.concatenate([k for _, k, _ in asked]), return_inverse=True)
    totals = np.zeros((len(keys), 3), np.int64)
    at = 0
    for block, own, extra in asked:
        totals[place[at:at + len(own)], block % 3] += np.frombuffer(extra, np.uint32)
        at += len(own)
    bucket = table.column("bucket")[0].as_py()
    rows, at = [], 0
    for block, own, _ in asked:
        rows.append((block, totals[place[at:at + len(own)], :2].astype(np.uint32).tobytes()))
        at += len(own)
    word = totals[(keys & np.uint64(3)) == 1]
    learned = word[:, 0] + word[:, 1]
    rows.append((-1, np.array([word[:, 0].sum(), (word[:, 0] > 0).sum(), learned.sum(), (learned > 0).sum()], np.int64).tobytes()))
    return pa.table({"block": pa.array([r[0] for r in rows], pa.int32()), "bucket": pa.array([bucket] * len(rows), pa.int32()),
                     "answer": pa.array([r[1] for r in rows], pa.binary())})


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Column sums of the buckets' totals, one row for each batch."""
    for batch in batches:
        total = sum((np.frombuffer(a, np.int64) for a in batch.column("answer").to_pylist()), np.zeros(4, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in total], names=["a", "b", "c", "d"])


def _block_counts(docs: pa.Table, answers: pa.Table):
    """Per token of a block (its texts' words and ends): counts of the token, of its context, of both; two columns each."""
    unigram, bigram, sizes = block_tokens(docs.column("text"))
    keys, _ = _keys(unigram, bigram)
    counts = in_order(answers, np.uint32).reshape(-1, 2).astype(np.int64)
    one = counts[np.searchsorted(keys, unigram)]
    token = (unigram & np.uint64(3)) == 1
    at = np.flatnonzero(token)
    return one[at], one[at - 1], counts[np.searchsorted(keys, bigram[at])], sizes


def context_bucket(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))) + 1, 0), CONTEXT_BUCKETS - 1).astype(np.int64)


@dataclass(frozen=True)
class Totals:
    """Tokens and distinct tokens."""

    tokens: int
    distinct: int


def _cells(total: Totals):
    """Table of (context bucket, estimates in steps of 1/STEPS doubling) for left-out tokens; 1 is no estimate."""
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        empty = {c: pa.array([], pa.int64()) for c in ("bucket", "two", "one", "n")}
        if not docs.num_rows:
            return pa.table(empty)
        token, context, both, _ = (x if x.ndim == 1 else x[:, 0] for x in _block_counts(docs, answers))
        with np.errstate(divide="ignore"):
            two = np.log2(both) - np.log2(np.maximum(context, 1))
            one = np.log2(token) - math.log2(max(total.tokens, 1))
        step = [np.where(np.isfinite(x), np.round(np.maximum(x, LEAST_LOG2) * STEPS), 1).astype(np.int64) for x in (two, one)]
        cell, n = np.unique(np.stack([context_bucket(context), *step], 1), axis=0, return_counts=True)
        return pa.table({"bucket": cell[:, 0], "two": cell[:, 1], "one": cell[:, 2], "n": n})
    return run


def learn_weights(cells: np.ndarray, distinct: int, rounds: int = 100) -> np.ndarray:
    """Weights (bigram, unigram, uniform) per context bucket by expectation maximisation.

    ``cells`` rows: bucket, log2 steps of the bigram and unigram estimate, tokens.
    A bucket without tokens keeps the weights it starts with.
    """
    weights = np.tile([0.4, 0.4, 0.2], (CONTEXT_BUCKETS, 1))
    for b in range(CONTEXT_BUCKETS):
        own = cells[cells[:, 0] == b]
        if not len(own):
            continue
        parts = np.stack([np.where(own[:, c] <= 0, 2.0 ** (own[:, c] / STEPS), 0) for c in (1, 2)] + [np.full(len(own), 1 / (distinct + 1))], 1)
        for _ in range(rounds):
            shares = weights[b] * parts
            shares = shares / shares.sum(1, keepdims=True) * own[:, 3:4]
            weights[b] = shares.sum(0) / own[:, 3].sum()
    # the uniform part never vanishes, so unseen tokens keep a probability
    weights[:, 2] = np.maximum(weights[:, 2], 1e-6)
    return weights / weights.sum(1, keepdims=True)


def _score(weights: np.ndarray, total: Totals):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            docs = docs.slice(0, 0)
            token = context = both = np.zeros(0)
            sizes = np.zeros(0, np.int64)
        else:
            token, context, both, sizes = _block_counts(docs, answers)
            token, context, both = (x.sum(1) for x in (token, context, both))
        w = weights[context_bucket(context)]
        model = np.log10(w[:, 0] * both / np.maximum(context, 1) + w[:, 1] * token / max(total.tokens, 1) + w[:, 2] / (total.distinct + 1))
        base = np.log10((token + 0.1) / (total.tokens + 0.1 * (total.distinct + 1)))
        starts = np.cumsum(sizes) - sizes
        per_text = [np.add.reduceat(x, starts) if len(starts) else np.zeros(0) for x in (model, base, (token > 0).astype(np.int64))]
        unseen = np.full(len(sizes), bool(docs.num_rows) and docs.column("block")[0].as_py() % 3 == UNSEEN)
        return pa.table({"doc_id": flat(docs.column("doc_id")), "held_out": unseen, "n_tokens": sizes,
                         "n_known": per_text[2].astype(np.int64), "train_tokens": np.full(len(sizes), total.tokens, np.int64),
                         "base_score": per_text[1].astype(float), "score": per_text[0].astype(float)})
    return run


def score_documents(docs: DataFrame) -> DataFrame:
    """Scores of every input row: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Learned from rows whose crc32 of the doc_id as text is not divisible by 10
    (a null doc_id counts as the empty text, which is: never learned from); of those the
    remainder 1 is left out when the weights are learned and counted for the
    scores. Null and empty texts are one end token. Repeated rows count and are
    scored each time; without any learned text the model is uniform. Other
    columns are ignored; an empty table gives no rows. base_score adds 0.1 to
    each token's count; score is the interpolated bigram model's log10
    probability. Words are told apart by 64-bit hashes.

    Counting and scoring exchange packed key arrays between blocks of documents
    and buckets of keys, so what is gathered grows with the distinct bigrams per
    block and no bigram or context is a hot key.
    """
    scratch = Scratch(docs.sparkSession, "language")
    size = text_bytes(docs)
    buckets = max(1, math.ceil(size / BUCKET_BYTES))
    kind = F.when(fold() == 0, UNSEEN).when(fold() == 1, LEFT_OUT).otherwise(COUNTED)
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    # a fold is a tenth of the rows: fewer, so equally large, blocks
    few = max(1, math.ceil(blocks / 8))
    texts = blocked(docs, blocks, kind, 3)
    source = texts.withColumn("block", F.when(F.col("block") % 3 == COUNTED, F.col("block")).otherwise(
        F.pmod(F.floor(F.col("block") / 3), F.lit(few)).cast("int") * 3 + F.col("block") % 3).cast("int"))
    asked = source.groupBy("block").applyInArrow(_ask(buckets), ASKED)
    answers = scratch.write(answer_all(asked, _answer), "answers")

    sums = answers.where("block = -1").select("answer").mapInArrow(_totals, "a long, b long, c long, d long").agg(
        *(F.coalesce(F.sum(c), F.lit(0)) for c in "abcd"))
    totals = sums.first()
    counted, learned = Totals(int(totals[0]), int(totals[1])), Totals(int(totals[2]), int(totals[3]))
    left_out = F.col("block") % 3 == LEFT_OUT
    cells = with_answers(source.where(left_out), answers.where(left_out & (F.col("block") >= 0)), _cells(counted),
                         "bucket long, two long, one long, n long").groupBy("bucket", "two", "one").agg(F.sum("n").alias("n"))
    # at most CONTEXT_BUCKETS * (40 * STEPS + 2) ** 2 cells, whatever the input
    rows = cells.toArrow()
    table = np.stack([rows.column(c).to_numpy() for c in ("bucket", "two", "one", "n")], 1) if rows.num_rows else np.zeros((0, 4), np.int64)
    weights = learn_weights(table.astype(float), counted.distinct)
    return with_answers(source, answers.where("block >= 0"), _score(weights, learned), SCORES)
