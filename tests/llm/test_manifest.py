"""The Merkle manifest against a direct computation."""

import hashlib
import zlib

import pytest

from groundline.llm import manifest
from tests.llm.helpers import documents, odd_documents, plain


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc, source, lang, n_chars, text):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n_chars, text)))


def levels(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [digest("".join(nodes[i:i + 3])) for i in range(0, len(nodes), 3)]
        out.append(nodes)
    return out


def path(tree, at):
    for nodes in tree[:-1]:
        run = at - at % 3
        yield "".join(nodes[run:at]), "".join(nodes[at + 1:run + 3])
        at //= 3


def brute(rows):
    groups = {}
    for doc, text, lang, source, n_chars, *_ in rows:
        changed = text.replace("\n", "") if text is not None and doc is not None and zlib.crc32(str(doc).encode()) % 2 == 0 else text
        groups.setdefault(source, []).append((doc, leaf(doc, source, lang, n_chars, text), leaf(doc, source, lang, n_chars, changed)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = {name: levels([h for _, h, _ in groups[name]]) for name in names}
    top = levels([trees[n][-1][0] for n in names])
    out = []
    for i, name in enumerate(names):
        for at, (doc, h, changed) in enumerate(groups[name]):
            steps = [*path(trees[name], at), *path(top, i)]
            folded = changed
            for left, right in steps:
                folded = digest(left + folded + right)
            out.append((doc, h, trees[name][-1][0], top[-1][0], digest("".join(a + b for a, b in steps)), folded, folded == top[-1][0]))
    return out


def same(found, expected):
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))


def with_sources(rows):
    names = [None, "", "ä", "z", "src1", "\U0001F600"]
    return [(i, t, lang if k % 4 else None, names[k % 5] if k % 11 else names[5], n, *rest) for k, (i, t, lang, _, n, *rest) in enumerate(rows)]


@pytest.mark.parametrize("levels_per_block", [1, 6])
def test_manifest(spark, monkeypatch, levels_per_block):
    monkeypatch.setattr(manifest, "LEVELS", levels_per_block)
    rows = with_sources(odd_documents())
    same(manifest.manifest(documents(spark, rows)).collect(), brute(rows))


def test_one_source_of_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(manifest, "LEVELS", 2)
    for n in (1, 4, 9, 82):
        rows = [(i, f"a\nb{i}", "en", "s", 4, 0, 0, 0, 0.0, "") for i in range(n)]
        same(manifest.manifest(documents(spark, rows)).collect(), brute(rows))


def test_empty(spark):
    assert manifest.manifest(plain(spark, [])).collect() == []


def test_whole_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    found = manifest.manifest(docs).collect()
    same(found, brute(rows))
    assert 0 < sum(not r["verified"] for r in found) < len(found)
