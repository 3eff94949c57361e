"""The signature-tree join against all pairs."""

import random

import numpy as np
import pytest

from groundline.llm import signature
from tests.llm.helpers import documents, odd_documents, plain, words


def shingle_set(text, size):
    w = words(text)
    if len(w) < size:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1))


def brute(rows, size=3, percent=90):
    sets = [(i, shingle_set(t, size)) for i, t in rows]
    label = {i: i for i, _ in sets if i is not None}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    distinct = {}
    for i, s in sets:
        if i is not None and s:
            distinct.setdefault(s, i)
            a, b = sorted((top(i), top(distinct[s])))
            label[b] = a
    unlike = list(distinct.items())
    for n, (s, i) in enumerate(unlike):
        for t, j in unlike[:n]:
            if 10 * min(len(s), len(t)) >= 8 * max(len(s), len(t)):
                common = len(s & t)
                if 100 * common >= percent * (len(s) + len(t) - common):
                    a, b = sorted((top(i), top(j)))
                    label[b] = a
    return sorted(((i, len(s), top(i) if i is not None else None) for i, s in sets), key=repr)


def found(spark, pairs, **options):
    return sorted(map(tuple, signature.jaccard_join(plain(spark, pairs).repartition(4), **options).collect()), key=repr)


def families(n_families, n_copies, length, seed):
    random.seed(seed)
    rows = []
    for f in range(n_families):
        base = [f"w{random.randrange(400)}" for _ in range(length)]
        for _ in range(n_copies):
            text = list(base)
            for _ in range(random.randrange(0, max(2, length // 25))):
                text[random.randrange(length)] = f"v{random.randrange(10 ** 6)}"
            rows.append(" ".join(text))
    random.shuffle(rows)
    return [(i - 5, t) for i, t in enumerate(rows)]


def test_odd_documents(spark):
    rows = odd_documents() + [(6, "x " * 40), (90, "x " * 40), (91, "one two"), (92, "One\ttwo")]
    result = signature.jaccard_join(documents(spark, [(*r[:2], "en", "s", 0, 0, 0, 0, 0.0, "") for r in rows]))
    assert sorted(map(tuple, result.collect()), key=repr) == brute([r[:2] for r in rows])


@pytest.mark.parametrize("group", [512, 24])
def test_families(spark, monkeypatch, group):
    """Near copies around the threshold, as one tree and in blocks."""
    monkeypatch.setattr(signature, "GROUP", group)
    monkeypatch.setattr(signature, "PIVOTS", 3)
    rows = families(6, 50, 90, 2) + [(i + 10_000, t) for i, (_, t) in enumerate(families(8, 6, 12, 4))]
    expected = brute(rows)
    assert len({r[2] for r in expected}) not in (len(rows), 14)
    assert found(spark, rows) == expected


def test_shared_template(spark):
    """Texts that share half of their words are in one cluster but not linked."""
    random.seed(8)
    half = [f"t{i}" for i in range(60)]
    rows = [(i, " ".join(half + [f"u{random.randrange(10 ** 6)}" for _ in range(60)])) for i in range(300)]
    assert found(spark, rows) == brute(rows)


def test_keys_meet():
    """Any two linked sets share a key, also at the threshold."""
    rng = np.random.default_rng(5)
    for n in [*range(1, 60), 99, 100, 250, 999]:
        for extra in {0, n // 9}:
            x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            y = np.unique(np.concatenate([x, rng.integers(0, 1 << 63, extra, dtype=np.uint64)]))
            if len(y) > len(x):
                assert signature.is_linked(x, y, 90) == (100 * len(x) >= 90 * len(y))
                keys, counts = signature.part_keys(np.concatenate([x, y]), np.array([len(x), len(y)]), 90)
                assert np.intersect1d(keys[:counts[0]], keys[counts[0]:]).size


def test_traversal_keeps_all_links():
    rng = np.random.default_rng(7)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 1 << 63, 80, dtype=np.uint64)
        sets += [np.unique(np.concatenate([base[rng.random(80) > 0.04], rng.integers(0, 1 << 63, 2, dtype=np.uint64)])) for _ in range(9)]
    tree = signature.Tree(sets, 1024)
    pairs = {tuple(sorted((int(tree.order[a]), int(tree.order[b])))) for i, j in signature.candidate_pairs(tree, tree, True, 90) for a, b in zip(i, j, strict=True)}
    linked = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if signature.is_linked(sets[a], sets[b], 90)}
    assert linked and linked <= pairs
    assert len(pairs) < len(sets) * (len(sets) - 1) // 8


def test_empty(spark):
    assert found(spark, []) == []


def test_whole_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, signature.jaccard_join(docs).collect()), key=repr) == brute(rows)
