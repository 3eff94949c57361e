"""File sources and sinks on small folders."""

import json

import pytest
from pyspark.sql import functions as F

from groundline.functions import models
from groundline.operators import tables
from groundline.sources import corpus, feeds, files


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())


def test_source_tree(spark, tmp_path):
    write(tmp_path / "README.md", "# Title\ntext here\n\n## Part\nmore")
    write(tmp_path / "pkg/mod.py", "def f():\n    return 1\n")
    write(tmp_path / "pkg/bad.py", "def f(:\n")
    write(tmp_path / "node_modules/x.md", "skip")
    write(tmp_path / "data.bin", b"\x00\x01")
    write(tmp_path / "latin.txt", b"caf\xe9")
    write(tmp_path / "blank.rst", "  \n")
    write(tmp_path / "big.txt", "x" * 1_000_001)
    tree = files.source_tree(spark, str(tmp_path), 1_000_000)
    assert {r["file_path"]: r["status"] for r in tree.collect()} == {
        "README.md": "kept", "pkg/mod.py": "kept", "pkg/bad.py": "kept", "node_modules/x.md": "skipped_path", "data.bin": "skipped_suffix",
        "latin.txt": "skipped_encoding", "blank.rst": "skipped_blank", "big.txt": "skipped_size"}
    got = sorted((r["file_path"], r["symbol"], r["content_type"]) for r in files.documentation_chunks(tree).collect())
    assert got == [("README.md", "Part", "documentation"), ("README.md", "Title", "documentation")]
    assert files.source_tree(spark, str(tmp_path)).filter("status = 'skipped_size'").count() == 0
    root = str(tmp_path)
    write(tmp_path / f"build{root}/c.md", "x")  # the root's name again below it
    again = {r["file_path"]: r["status"] for r in files.source_tree(spark, f"file:{root}").collect()}
    assert again[f"build{root}/c.md"] == "skipped_path" and again["README.md"] == "kept"


def test_text_files_drop_bad_bytes(spark, tmp_path):
    write(tmp_path / "a.txt", b"ab\xffc \xe4\xb8\xad")
    assert files.text_files(spark, str(tmp_path)).first()["text"] == "abc 中"


def manifest(root, name, **extra):
    base = {"source_id": name, "title": name.upper(), "source_type": "paper", "source_url": "https://x.org", "retrieved_at": "2026-01-02",
            "original_format": "pdf", "conversion_method": "m", **extra}
    write(root / f"data/corpus/{name}/source.json", json.dumps(base))


def test_corpus(spark, tmp_path):
    manifest(tmp_path, "one", normalized_file="norm/one.md", repository_files=[
        {"file_path": "src/a.py", "raw_file": "raw/a.py", "repository_url": "https://github.com/a/b", "commit": "c1", "source_url": "https://x.org"}])
    manifest(tmp_path, "two")
    write(tmp_path / "norm/one.md", "# H\nbody")
    write(tmp_path / "raw/a.py", "def go():\n    pass\n")
    root, base = str(tmp_path / "data/corpus"), str(tmp_path)
    with pytest.raises(FileNotFoundError):
        corpus.manifests(spark, root, base)
    write(tmp_path / "data/corpus/two/content.md", "plain   text")
    rows = sorted((r["source"], r["file_path"], r["symbol"], r["content"]) for r in corpus.bootstrap(spark, root, base).fillna("-").collect())
    assert rows == [("research:one", "norm/one.md", "H", "## H\n\nbody"), ("research:two", "-", "-", "plain text")]
    write(tmp_path / "data/corpus/two/content.md", " ")
    with pytest.raises(ValueError):
        corpus.bootstrap(spark, root, base)


def test_event_text(spark, tmp_path):
    text = ": ping\r\nevent: task.started\r\nid: 7\r\ndata: {\"a\":\r\ndata: 1}\r\n\r\n\r\ndata: nope\n\nevent: x\n\ndata:{\"中\": 2}"
    write(tmp_path / "log.txt", text)
    rows = feeds.read_sse(spark, str(tmp_path)).orderBy("block_no").collect()
    assert [(r["event"], r["id"], r["data"], r["error"]) for r in rows] == [
        ("task.started", "7", '{"a":\n1}', None), ("message", None, "nope", "invalid_sse_json"), ("x", None, "", "invalid_sse"), ("message", None, '{"中": 2}', None)]


def test_event_text_round_trip(spark, tmp_path):
    rows = [(1, i, f"event: e{i}\ndata: {{\"n\":{i}}}\n\n") for i in range(1, 4)]
    feeds.write_sse(spark.createDataFrame(rows, "run_id long, sequence long, sse string"), str(tmp_path / "out"))
    back = feeds.read_sse(spark, str(tmp_path / "out/run_id=1")).orderBy("block_no").collect()
    assert [r["event"] for r in back] == ["e1", "e2", "e3"]


def test_translation_cache(spark, tmp_path):
    entry = ("id1", "research:a", 3, "S", "h", "text", None, "en", "failed", "m", None, None, False, "E: x")
    entries = spark.createDataFrame([entry], feeds.TRANSLATION)
    feeds.write_translations(entries, str(tmp_path / "cache"))
    back = feeds.read_translations(spark, str(tmp_path / "cache"))
    assert tuple(back.select(*entries.columns).first()) == entry


def test_checkpoint(spark, tmp_path):
    write(tmp_path / "c.json", json.dumps({"schema_version": 1, "results": [{"case_id": "a", "v": "1"}, {"case_id": "a", "v": "2"}, {"v": "3"}]}))
    done = tables.completed_cases(feeds.read_checkpoint(spark, str(tmp_path / "c.json"))).collect()
    assert [(r["case_id"], r["payload"]["v"]) for r in done] == [("a", "2")]


def test_partition_overwrite_and_snapshot(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([("a", 1), ("b", 2)], "source string, v long")
    files.overwrite_sources(old, path)
    files.overwrite_sources(spark.createDataFrame([("a", 9)], "source string, v long"), path)
    assert sorted((r["source"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", 9), ("b", 2)]
    stamped = files.write_snapshot(old, str(tmp_path / "snap"), "20260102-030405-000000")
    assert spark.read.parquet(stamped).count() == 2


def test_model_hooks(spark):
    df = spark.createDataFrame([("ab",), ("c",)], "t string")
    vec = models.embed(lambda texts: [[float(len(t))] for t in texts], batch=1)
    assert sorted(r[0][0] for r in df.select(vec(F.col("t"))).collect()) == [1.0, 2.0]
    up = models.complete(lambda p: p.upper())
    assert sorted(r[0] for r in df.select(up(F.col("t"))).collect()) == ["AB", "C"]


def test_metadata_only_change_is_a_patch(spark):
    schema = "source string, source_index long, content string, revision string, metadata_json string"
    old = spark.createDataFrame([("s", 0, "a", "r1", "{}"), ("t", 0, "b", "r1", "{}"), ("u", 0, "c", "r1", None)], schema)
    new = spark.createDataFrame([("s", 0, "a", "r1", '{"k": 1}'), ("t", 0, "b", "r1", "{}"), ("u", 0, "d", "r1", None)], schema)
    got = {r["source"]: (r["action"], r["metadata_json"], r["content"]) for r in tables.ensure_sources(old, new).collect()}
    assert got == {"s": ("patch", '{"k": 1}', "a"), "t": ("keep", "{}", "b"), "u": ("replace", None, "d")}


def log_rows(spark, path):
    return sorted((r["case_id"], r["payload"]["v"]) for r in feeds.read_log(spark, path).collect())


def test_checkpoint_log(spark, tmp_path):
    """What is appended is read back, also after a compaction and one that stopped half-way."""
    path = str(tmp_path / "log")
    rows = lambda *r: spark.createDataFrame([(i, c, {"v": v}) for i, (c, v) in enumerate(r)], feeds.LOG_ROW)
    assert log_rows(spark, path) == []
    assert feeds.append_log(rows(("a", "1"), ("b", "1"), ("a", "2"), (None, "x"), ("", "y")), path) == 1
    feeds.append_log(rows(("b", "2")), path)
    expected = [("a", "2"), ("b", "2")]
    assert log_rows(spark, path) == expected
    write(tmp_path / "log/segment-000000003/part-0.json", '{"pos": 0, "case_id": "b", "payload": {"v": "torn"}}')
    assert log_rows(spark, path) == expected
    assert feeds.compact_log(spark, path) == 4
    assert sorted(p.name for p in (tmp_path / "log").iterdir()) == ["segment-000000004"] and log_rows(spark, path) == expected
    feeds.append_log(rows(("c", "1"), ("a", "3")), path)
    assert log_rows(spark, path) == [("a", "3"), ("b", "2"), ("c", "1")]
    cases = spark.createDataFrame([("a",), ("d",)], "case_id string")
    assert [r["case_id"] for r in tables.pending_cases(cases, feeds.read_log(spark, path)).collect()] == ["d"]


def test_prune_snapshots(spark, tmp_path):
    root, one = str(tmp_path / "snap"), spark.range(3)
    with pytest.raises(FileNotFoundError):
        files.prune_snapshots(spark, root, 1)
    stamps = [f"20260102-03040{i}-000000" for i in range(5)]
    for stamp in stamps:
        files.write_snapshot(one, root, stamp)
    write(tmp_path / "snap/20260102-030409-000000/part-0.parquet", "unfinished")
    assert files.prune_snapshots(spark, root, 2, pinned=(stamps[0],)) == stamps[1:3]
    assert files.prune_snapshots(spark, root, 0) == [stamps[0], stamps[3]]
    assert sorted(p.name for p in (tmp_path / "snap").iterdir()) == [stamps[4], "20260102-030409-000000"]
    assert spark.read.parquet(f"{root}/{stamps[4]}").count() == 3
