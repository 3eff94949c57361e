"""Quality ranking, exact top-k, licence scan, and the pipeline."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from groundline.llm import licenses, near, quality, topk
from groundline.llm.catalogue import ORACLE, QUERIES
from tests.compare import connect, differences
from tests.llm.helpers import documents, odd_documents, plain


@pytest.mark.parametrize("name", list(ORACLE))
def test_sql(spark, data, name):
    assert differences(QUERIES[name](spark, data), connect(data), ORACLE[name]) == []


# ---- quality ---------------------------------------------------------------------

def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.01"
    out = {r.doc_id: r for r in QUERIES["op2_quality_classifier"](spark, folder).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    held = [r for r in labels if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(out[r.doc_id].held_out for r in held)
    right = np.mean([out[r.doc_id].predicted == r.quality for r in held])
    assert right > 0.9
    assert all((r.score >= 0.3) == (r.predicted == 1) and 0 <= r.score <= 1 for r in out.values())


def test_quality_odd_cases(spark):
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 0), (11, 0, 1), (14, 1, 0), (None, 1, 0), (9, None, 0), (12345, 0, 0)], "doc_id long, quality int, toxic int")
    docs = documents(spark)
    out = quality.score_documents(docs, labels)
    assert out.count() == docs.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    kept = quality.keep_good(docs, labels)
    assert kept.schema == docs.schema and kept.count() == out.where("predicted = 1").count()
    assert quality.score_documents(docs, labels.limit(0)).where("predicted = 0").count() == 0
    assert quality.score_documents(plain(spark, []), labels).count() == 0


def test_ranker_orders_pairs():
    random = np.random.default_rng(1)
    good = random.random(600) < 0.7
    x = random.normal(size=(600, len(quality.FEATURES)))
    x[:, 3] += 4 * good
    ranker = quality.fit_ranker(x, good)
    s = ranker.strength(x)
    assert np.mean(s[good][:, None] > s[~good][None, :]) > 0.95
    assert abs(np.mean(ranker.score(x) < quality.THRESHOLD) - np.mean(~good)) < 0.02


def test_quality_cut_of_all_rows(spark):
    """Classes that overlap and are capped in the fit: as many rows are rejected as are labelled bad."""
    random = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(500):
        bad = i % 10 == 0
        rows.append((i, " ".join("word" if random.random() < (0.6 if bad else 0.4) else f"w{random.integers(10 ** 6)}" for _ in range(20))))
        labels.append((i, int(not bad)))
    docs, votes = plain(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")
    used = [r for r in quality.score_documents(docs, votes, per_class=30).collect() if not r.held_out]
    bad = sum(r.doc_id % 10 == 0 for r in used)
    ties = max(sum(r.score == s for r in used) for s in {r.score for r in used})
    assert abs(sum(r.predicted == 0 for r in used) - bad) <= ties < len(used) // 20
    kept = {r.doc_id for r in quality.keep_good(docs, votes, per_class=30).collect()}
    assert kept == {r.doc_id for r in quality.score_documents(docs, votes, per_class=30).collect() if r.predicted}


# ---- top-k -----------------------------------------------------------------------

def best_by_hand(rows, k):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            w = [int(np.floor(256 * float(x))) for x in v]
            good[i] = min(good.get(i, w), w)
    out = []
    for q, a in good.items():
        if q % 50 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), c) for c, b in good.items() if c != q and len(a) == len(b))[:k]
            out += [(q, rank, c, -s) for rank, (s, c) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e11])
def test_topk(spark, scale):
    random = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in random.normal(size=6) * scale]) for i in range(300)]
    rows += [(400 + i, rows[7][1]) for i in range(40)] + [(50, rows[50][1]), (50, [0.0] * 6), (None, [1.0] * 6), (450, None), (500, [1.0, None]),
                                                         (550, [float("nan")] * 6), (600, [float("inf")] * 6), (650, [1.0, 2.0]), (651, [3.0, -2.0]), (700, []), (750, [5.0])]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, score int, rank int")
    vectors = topk.integer_vectors(table)
    from pyspark.sql import functions as F
    for size in (1 << 20, 100):  # one pass, several passes
        got = topk.top_k(vectors, F.col("vec_id") % 50 == 0, 5, size).collect()
        if scale < 1e11:
            assert sorted(tuple(r) for r in got) == best_by_hand(rows, 5)
        else:  # beyond a long: cut to its range, but complete
            assert len(got) == len(best_by_hand(rows, 5))
    assert topk.top_k(vectors.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# ---- licences --------------------------------------------------------------------

def test_licenses(spark):
    rows = [(1, "Intro\nReleased under the MIT License.\nend"), (2, "RELEASED  under the -- mit licence"), (3, "released under the ISC license!"), (4, None), (5, ""),
            (6, "This work is licensed\nunder the GNU General Public\nLicense, version 3.\n\nunrelated words stand here"), (7, "be " * 5000), (1, "Released under the MIT License."), (None, "Licensed under CC BY-NC 4.0.")]
    got = sorted(((r.doc_id, r.unit, r.number, r.license_id) for r in licenses.scan(plain(spark, rows)).collect()), key=lambda r: (r[0] is None, r))
    assert got == [(1, "line", 0, "MIT"), (1, "line", 1, "MIT"), (3, "line", 0, "ISC"), (6, "paragraph", 0, "GPL-3.0"), (6, "text", 0, "GPL-3.0"), (None, "line", 0, "CC-BY-NC-4.0")]
    assert licenses.scan(plain(spark, [])).count() == 0
    none = spark.createDataFrame([], "license_id string, text string")
    assert licenses.scan(plain(spark, rows), none).count() == 0
    assert licenses.scan(documents(spark)).where("license_id = 'MIT'").count() == 1


def test_licenses_amid_other_words(spark):
    """Full texts, headers in comments, notices with words around them and over two lines."""
    texts = {i: t for i, t in licenses.FULL_TEXTS}
    rows = [(1, "Released under the MIT License. See LICENSE for details"), (2, "Some words come first. This work is licensed under\nthe GNU General Public License, version 3. And more words follow here."),
            (3, "Copyright (c) 2020 A\n\n" + texts["MIT"].replace(". ", ".\n\n") + "\n\ncode = 1\n" * 50), (4, "import os\n" + "# SPDX-License-Identifier: Apache-2.0\nx = 1"),
            (5, "Copyright B\n" + texts["BSD-3-Clause"] + "\nand " + texts["BSD-3-Clause"]), (6, "/*\n" + "\n".join(f" * {w}" for w in texts["Apache-2.0"].split(". ")) + "\n*/"), (7, "the license of the software " * 300)]
    got = sorted((r.doc_id, r.license_id) for r in licenses.scan(plain(spark, rows)).where("unit = 'window'").collect())
    assert got == [(1, "MIT"), (2, "GPL-3.0"), (3, "MIT"), (4, "Apache-2.0"), (5, "BSD-3-Clause"), (5, "BSD-3-Clause"), (6, "Apache-2.0")]


# ---- pipeline --------------------------------------------------------------------

def test_pipeline(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "minhash_dedup", "decontamination", "secret_scan", "packing"]
    kept, ids = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, folder).collect(), docs.schema)
        ids.append({r.doc_id for r in kept.collect()})
    score = {r.doc_id: r.predicted for r in QUERIES["op2_quality_classifier"](spark, folder).collect()}
    assert ids[0] == {i for i, p in score.items() if p}
    left = docs.where(docs.doc_id.isin([int(i) for i in ids[0]]))
    assert ids[1] == {r.doc_id for r in near.near_duplicates(left).collect() if r.kept}
    assert ids[2] == ids[1] - {r.doc_id for r in QUERIES["op10_decontamination"](spark, folder).collect()}
    assert ids[3] == ids[2]
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {p.doc_id for p in pieces} == ids[3]


def test_pipeline_odd_documents(spark, tmp_path):
    spark.createDataFrame([(1, "not here at all in any document")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    documents(spark).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    rows = [r[:2] for r in odd_documents()]
    assert {p.doc_id for p in pieces} <= {i for i, _ in rows}
    whole = [p for p in pieces if p.doc_id == 5 and p.start == 0]
    assert len(whole) == 1  # three copies and an upper-case one are one document
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty_out = stage(spark, empty, str(tmp_path))
        assert empty_out.count() == 0
