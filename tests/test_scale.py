"""Hot keys, ties and bounded passes."""

import numpy as np
from pyspark.sql import functions as F

from groundline import session
from groundline.operators import lexical, ordering, topk
from groundline.operators.vectors import vector_topk


def test_split_lookup_hot_and_cold(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"))
    values = rows.groupBy("key").agg(F.max("id").alias("v"), F.count("*").alias("n"))
    got = ordering.split_lookup(rows, values, ["key"], "n", hot_rows=100)
    want = rows.join(values.drop("n"), "key")
    assert got.count() == 1000 and got.select("id", "v").exceptAll(want.select("id", "v")).count() == 0


def test_lookup_with_hot_missing_key(spark):
    rows = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.lit("gone")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"))
    values = rows.filter("key <> 'gone'").groupBy("key").agg(F.max("id").alias("v"))
    got = ordering.lookup(rows, values, ["key"], hot_rows=100)
    assert got.select("id", "key", "v").exceptAll(rows.join(values, "key", "left").select("id", "key", "v")).count() == 0 and got.count() == 900


def test_join_per_key_salted(spark, monkeypatch):
    rows = spark.range(600).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("source"))
    names = spark.createDataFrame([("hot",), ("k1",), ("none",)], "source string")
    small = {h: ordering.join_per_key(rows, names, ["source"], h, "id") for h in ("inner", "left_semi", "left_anti")}
    monkeypatch.setattr(session, "BROADCAST_LIMIT", 0)
    for how, want in small.items():
        got = ordering.join_per_key(rows, names, ["source"], how, "id")
        assert "_salt" in got._jdf.queryExecution().optimizedPlan().toString()
        assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_positions_in_one_hot_group(spark):
    rows = spark.range(5000).select(F.lit("s").alias("source"), (F.col("id") * 7 % 5000).alias("doc"))
    got = ordering.position(rows, ["source"], F.floor(F.col("doc") / 100), ["doc"], "pos")
    assert got.filter("pos <> doc").count() == 0


def test_first_per_key(spark):
    rows = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("b", 2, "z")], "k string, o int, v string")
    got = {r["k"]: (r["v"], r["n_rows"]) for r in ordering.first_per_key(rows, ["k"], ["o"]).collect()}
    assert got == {"a": ("y", 2), "b": ("z", 1)}


def test_local_topk_keeps_lowest_ids_of_ties():
    best = topk.LocalTopK(2, 3)
    for lo in (50, 0, 25):
        ids = np.arange(lo, lo + 25)
        best.add(0, ids, np.stack([np.full(25, 0.5), (ids % 7) / 10 + 0.1], axis=1))
    assert list(best.ids[best.q == 0]) == [0, 1, 2]
    assert list(best.ids[best.q == 1]) == [6, 13, 20]


def chunks(spark):
    texts = ["alpha beta gamma", "alpha alpha", "beta", "delta " * 5, "", "alpha beta"] * 40
    return spark.createDataFrame(list(enumerate(texts)), "chunk_id long, search_text string").repartition(6)


def questions(spark):
    return spark.createDataFrame([(1, "alpha beta beta"), (2, "delta unknown"), (3, "nothing here"), (4, "")], "query_id long, query string")


def test_bm25_equals_posting_scores(spark):
    index = lexical.term_index(chunks(spark))
    got = lexical.bm25_topk(index, questions(spark), 5)
    want = lexical.rank_by_score(lexical.postings_scores(index, questions(spark)), 5)

    def rows(df):
        return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in df.collect())

    assert rows(got) == rows(want) and {r[0] for r in rows(got)} == {1, 2}


def test_many_passes_give_the_same(spark, monkeypatch):
    index = lexical.term_index(chunks(spark))
    want = sorted(map(tuple, lexical.bm25_topk(index, questions(spark), 4).select("query_id", "rank", "chunk_id").collect()))
    monkeypatch.setattr(topk, "BROADCAST_LIMIT", 100)
    monkeypatch.setattr(lexical, "BROADCAST_LIMIT", 100)
    got = sorted(map(tuple, lexical.bm25_topk(index, questions(spark), 4).select("query_id", "rank", "chunk_id").collect()))
    assert got == want


def test_vector_topk(spark):
    rng = np.random.default_rng(5)
    v, q = rng.normal(size=(300, 8)), rng.normal(size=(7, 8))
    vectors = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(300)] + [(999, None), (998, [1.0])], "chunk_id long, embedding array<double>").repartition(5)
    asked = spark.createDataFrame([(i, [float(x) for x in q[i]]) for i in range(7)] + [(50, None)], "query_id long, embedding array<double>")
    got = {}
    for r in vector_topk(vectors, asked, 6).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    cos = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T
    assert got == {i: list(np.argsort(-cos[i])[:6]) for i in range(7)}


def test_no_stats_on_empty_tables(spark):
    index = lexical.term_index(chunks(spark).filter("chunk_id < 0"))
    assert lexical.bm25_topk(index, questions(spark), 5).count() == 0
    assert lexical.corpus_stats(index).first().asDict() == {"n_chunks": 0, "avg_len": 1.0}


def test_limits_are_parameters(spark):
    from pyspark.sql import functions as F

    from groundline.functions import rules
    from groundline.operators import evidence, tasks

    rows = spark.createDataFrame([("t", "own", "FACT_LOOKUP", [f"q{i}" for i in range(6)]), ("u", "own", "COMPARISON", [f"q{i}" for i in range(6)])],
                                 "task_id string, query string, task_type string, research_questions array<string>")
    count = lambda n: {r["task_id"]: r["count"] for r in tasks.task_queries(rows, max_queries=n).groupBy("task_id").count().collect()}
    assert count(None) == {"t": 6, "u": 6} and count(4) == {"t": 1, "u": 4}
    pool = spark.createDataFrame([("t", f"e{i}", i, 0) for i in range(30)], "task_id string, evidence_id string, rank long, query_no long")
    assert evidence.round_robin(pool).count() == 30 and evidence.round_robin(pool, 18).count() == 18
    text = "x" * 230 + " token=abcdefghijkl end"
    whole, short = spark.range(1).select(rules.redact(F.lit(text)), rules.redact(F.lit(text), 240)).first()
    assert whole == "x" * 230 + " [REDACTED] end" and short == whole[:240]


def test_chunk_numbers_without_moving_text(spark):
    from groundline.operators.chunking import window_chunks

    docs = spark.range(3000).select(F.xxhash64("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"),
                                    F.repeat(F.lit("word "), (F.col("id") % 9).cast("int")).alias("text"))
    got = window_chunks(docs, 10, 2, bucket_docs=50)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.split("\n") if "Exchange hashpartitioning" in line and "text" in line]
    want = {}
    for r in sorted(docs.collect(), key=lambda r: (r["source"], r["doc_id"])):
        flat = r["text"].strip()
        for part in range(-(-len(flat) // 8) if flat else 0):
            at = want.setdefault(r["source"], [])
            at.append((r["doc_id"], part, flat[part * 8:part * 8 + 10]))
    rows = got.collect()
    assert len(rows) == sum(map(len, want.values()))
    assert all(want[r["source"]][r["source_index"]] == (r["doc_id"], r["part"], r["content"]) for r in rows)


def test_postings_without_a_shuffle(spark):
    rows = [(1, ["a", "b", "a"]), (2, []), (3, None), (4, ["b"] * 5 + ["ü"])] + [(10 + i, ["a", f"t{i}"] * 2) for i in range(5000)]
    index = spark.createDataFrame(rows, "chunk_id long, terms array<string>").repartition(3)
    post = lexical.postings(index)
    assert "Exchange hashpartitioning(chunk_id" not in post._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, post.collect()))
    assert got[:4] == [(1, "a", 2), (1, "b", 1), (4, "b", 5), (4, "ü", 1)] and len(got) == 10004
    assert all(r[2] == 2 for r in got[4:])


def test_texts_move_once_and_unsorted_beyond_the_broadcast(spark, monkeypatch):
    from groundline.operators import chunking

    docs = spark.range(2000).select("id", F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.col("id").alias("doc_id"),
                                    F.repeat(F.lit("wörd  "), (F.col("id") % 7).cast("int")).alias("text")).drop("id")
    want = chunking.window_chunks(docs, 10, 2)
    monkeypatch.setattr(chunking, "BROADCAST_LIMIT", 0)
    got = chunking.window_chunks(docs, 10, 2)
    lines = got._jdf.queryExecution().executedPlan().toString().split("\n")
    assert not [x for x in lines if " Sort " in x and "text" in x] and any("ShuffledHashJoin" in x for x in lines)
    assert got.count() == want.count() > 2000 and got.exceptAll(want).count() == 0


def test_chunks_are_cut_once(spark, data):
    from groundline.catalogue import base

    base.chunks(spark, data).count()
    for df in (base.chunks(spark, data), base.chunk_vectors(spark, data)):
        assert "documents.parquet" not in df._jdf.queryExecution().optimizedPlan().toString() and not [
            f for f in df.inputFiles() if "documents.parquet" in f]


def test_many_hits_are_expanded_without_moving_texts_thrice(spark, monkeypatch):
    from groundline.operators import hybrid

    rows = spark.range(9000).select(
        F.col("id").alias("chunk_id"), F.when(F.col("id") % 3 == 0, F.lit("research:a")).when(F.col("id") % 300 == 1, F.lit(None)).otherwise(F.lit("b")).alias("source"),
        F.floor(F.col("id") / 3).alias("source_index"), F.when(F.col("id") % 7 > 0, F.floor(F.col("id") / 20).cast("string")).alias("section"), F.concat(F.lit("text "), "id").alias("content"))
    hits = spark.range(0, 9500).select(F.col("id").alias("chunk_id"), (F.col("id") % 5).alias("query_id"))
    want = hybrid.expand(hits, rows, 1)
    monkeypatch.setattr(hybrid, "BROADCAST_LIMIT", 0)
    got = hybrid.expand(hits, rows, 9500).select(want.columns)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and got.count() == want.count() == 9500
    assert got.exceptAll(want).count() == 0


def test_both_runs_of_an_ingest_job_clean_the_pages_once(spark, data, monkeypatch):
    from groundline.catalogue import ingest as queries
    from groundline.operators import ingest

    calls, clean = [], ingest.clean_pages
    monkeypatch.setattr(ingest, "clean_pages", lambda pages: calls.append(1) or clean(pages))
    assert queries.ingest_job(spark, data).columns[0] == "run" and len(calls) == 1


def test_texts_are_cut_and_counted_in_blocks(spark):
    from groundline.functions import text as T
    from groundline.operators.chunking import window_chunks, windows

    odd = "".join(chr(c) for c in (0x1c, 0x85, 0xa0, 0x1680, 0x200b, 0x2003, 0x2028, 0xfeff))
    texts = ["", None, " \n ", "a  b" + odd + "c ", "\u3000Ä é\U0001f600 x" * 30, "word\tword " * 40, "x", "中文 ab 中"]
    docs = spark.createDataFrame([(i, "s" if i % 2 else "t", t) for i, t in enumerate(texts)], "doc_id long, source string, text string")
    got = window_chunks(docs, size=20, overlap=5)
    assert "regexp_replace" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = docs.withColumn("text", T.collapse("text")).select("doc_id", F.posexplode(windows(F.col("text"), 20, 5)).alias("part", "content"))
    assert got.select("doc_id", "part", "content").exceptAll(want).count() == 0 and got.count() == want.count()
    numbered = got.select((F.col("doc_id") * 1000 + F.col("part")).alias("chunk_id"), "content")
    index = lexical.term_index(session.materialize(numbered, "numbered"), "content")
    long = lexical.postings(index)
    terms, chunks = lexical.term_totals(index), lexical.chunk_totals(index)
    assert sorted(map(tuple, terms.collect())) == sorted(map(tuple, long.groupBy("term").agg(F.count("*"), F.sum("tf")).collect()))
    assert sorted(map(tuple, chunks.collect())) == sorted(map(tuple, long.groupBy("chunk_id").agg(F.count("*"), F.sum("tf"), F.max("tf")).collect()))
    assert "Aggregate" not in chunks._jdf.queryExecution().optimizedPlan().toString()


def test_registered_task_queries_without_terms_ask_without_vector(spark, data):
    from groundline.catalogue.evidence import query_vectors

    asked = spark.createDataFrame([("task-1", 0, "Ö"), ("task-1", 1, "a word"), ("task-1", 2, "文")], "task_id string, query_no long, query string")
    got = {r["query_no"]: r["embedding"] is not None for r in query_vectors(spark, data)(asked).collect()}
    assert got == {0: False, 1: True, 2: True}
