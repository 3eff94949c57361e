"""The prefix trie and its contraction against direct computations."""

import hashlib
import random
import re
import zlib

from groundline.llm import trie
from groundline.llm.base import Scratch

SCHEMA = "conv_id long, turn long, role string, text string, d string, a long, size string"


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    members, ends = {}, {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = c - (c % 20 if c >= 0 else -(-c % 20))
        path = tuple(convs.get(first, [])[:h] + own[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved, out = {}, {}, []
    for path in sorted(members, key=len, reverse=True):
        below = children.get(path, [])
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        leaves[path] = sum(leaves[p] for p in below) if below else 1
        saved[path] = (len(members[path]) - 1) * words + sum(saved[p] for p in below)
        out.append((min(members[path]), len(path), min(members[path[:-1]]) if path else None, len(members[path]), len(below),
                    leaves[path], saved[path], hashlib.sha256(",".join(map(str, sorted(ends.get(path, [])))).encode()).hexdigest()))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)


def same(found, expected):
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))


def odd_turns():
    random.seed(3)
    rows = [(c, t, random.choice(["user", "assistant", None]), random.choice(["a b", "", None, " \t", "é x y", "z" * 50]))
            for c in range(60) for t in range(random.randrange(1, 5)) if c not in (20, 21, 22)]
    rows += [(c, 0, "user", "only") for c in (21, 22, 24, -3, -20, -41)]
    rows += [(7, None, "user", "first of all"), (None, 1, "user", "lost"), (101, 5, "user", "gap"), (101, 5, "user", "gap")]
    rows += [(c, t, "user", f"same {t}") for c in (200, 201, 202, 203, 204) for t in range(40)]
    return rows + [(205, t, "user", f"same {t}" if t < 37 else "other") for t in range(45)]


def test_prefix_trie(spark, monkeypatch):
    rows = odd_turns()
    same(trie.prefix_trie(frame(spark, rows)).collect(), brute(rows))
    monkeypatch.setattr(trie, "SEGMENT", 4)
    same(trie.prefix_trie(frame(spark, rows)).collect(), brute(rows))


def test_empty(spark):
    assert trie.prefix_trie(frame(spark, [])).collect() == []


def test_contraction_rounds(spark):
    """A chain, a star, a comb and two roots; a chain of 300 takes about log2 rounds."""
    random.seed(1)
    parent = {0: None, 1000: None}
    parent |= {i: i - 1 for i in range(1, 300)} | {i: 0 for i in range(300, 400)} | {i: i - 400 + 5 for i in range(400, 440)}
    depth = lambda i: 0 if parent[i] is None else depth(parent[i]) + 1
    rows = [(i, p, depth(i), random.randrange(-5, 9)) for i, p in parent.items()]
    total = {i: w for i, _, _, w in rows}
    for i, p, _, _ in sorted(rows, key=lambda r: -r[2]):
        if p is not None:
            total[p] += total[i]
    scratch = Scratch(spark, "test-tree")
    steps = []
    write, scratch.write = scratch.write, lambda df, name: (steps.append(name), write(df, name))[1]
    found = trie.subtree_totals(spark.createDataFrame(rows, "id long, parent long, depth long, w long"), ["w"], scratch)
    assert dict(map(tuple, found.collect())) == total
    assert sum(s.endswith("compressed") for s in steps) <= 25


def test_whole_table(spark, data):
    turns = spark.read.parquet(f"{data}/conversations.parquet")
    same(trie.prefix_trie(turns).collect(), brute([tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()]))
