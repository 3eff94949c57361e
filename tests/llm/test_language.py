"""Counts and scores against plain counting."""

import collections
import math
import zlib

import numpy as np

from groundline.llm import language
from tests.llm.helpers import documents, odd_documents, plain, words


def rest(doc_id, n=10):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def check(rows, result):
    tokens = [(i, [*words(t), None]) for i, t in rows]
    counts = collections.Counter(w for i, t in tokens if rest(i) for w in t)
    total, distinct = sum(counts.values()), len(counts)
    want = sorted(((i is None, i, len(t), sum(counts[w] > 0 for w in t), total, rest(i) == 0,
                    round(sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in t), 6)) for i, t in tokens), key=repr)
    got = sorted(((r.doc_id is None, r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.held_out, round(r.base_score, 6)) for r in result), key=repr)
    assert got == want


def test_odd_documents(spark):
    check([r[:2] for r in odd_documents()], language.score_documents(documents(spark)).collect())


def test_whole_table_and_gain(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    from groundline.llm.catalogue import QUERIES
    out = QUERIES["op1_deleted_interpolation"](spark, data).collect()
    check([tuple(r) for r in docs.select("doc_id", "text").collect()], out)
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_model_probability(spark):
    """Nothing is left out, so every bucket has start weights: each token's estimate by hand."""
    ids = [i for i in range(100) if rest(i) not in (0, 1)][:2]
    out = {r.doc_id: r.score for r in language.score_documents(plain(spark, [(ids[0], "a b a"), (ids[1], "a b")])).collect()}
    weights = language.learn_weights(np.zeros((0, 4)), 3)[0]
    unigram = {"a": 3 / 7, "b": 2 / 7, "end": 2 / 7}
    bigram = {("start", "a"): 1, ("a", "b"): 2 / 3, ("b", "a"): 1 / 2, ("a", "end"): 1 / 3, ("b", "end"): 1 / 2}
    for doc, text in zip(ids, (["start", "a", "b", "a", "end"], ["start", "a", "b", "end"]), strict=True):
        want = sum(math.log10(weights @ [bigram[x], unigram[x[1]], 1 / 4]) for x in zip(text, text[1:]))
        assert math.isclose(out[doc], want, rel_tol=1e-9)


def test_weights_rise_in_likelihood():
    """One context bucket: the learned weights are a stationary point of the held-out likelihood."""
    cells = np.array([[3, -4, -20, 50], [3, 1, -24, 30], [3, -8, -16, 20]], float)
    w = language.learn_weights(cells, 1000, rounds=5000)[3]
    parts = np.stack([np.where(cells[:, c] <= 0, 2.0 ** (cells[:, c] / language.STEPS), 0) for c in (1, 2)] + [np.full(3, 1 / 1001)], 1)
    value = lambda v: (cells[:, 3] * np.log(parts @ v)).sum()
    for a in range(3):
        for b in range(3):
            moved = w.copy()
            step = min(1e-3, moved[a])
            moved[a] -= step
            moved[b] += step
            assert value(moved) <= value(w) + 1e-3  # the uniform part has a floor


def test_empty(spark):
    assert language.score_documents(plain(spark, [])).count() == 0
