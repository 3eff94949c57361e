"""Text functions against plain Python on adversarial strings."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from groundline.functions import rules
from groundline.functions import text as T
from groundline.operators import tasks as K


def py_tokens(s):
    low = s.lower()
    cjk = [c for c in low if "一" <= c <= "鿿"]
    return re.findall(r"[a-z0-9_]+|[一-鿿]", low) + ["".join(p) for p in zip(cjk, cjk[1:])]


def strings(n=200, seed=7):
    rng = random.Random(seed)
    alphabet = list("abcXYZ019_ .,;:!?-\n\t'\"#@(){}%") + ["é", "ß", "中", "文", "检", "，", "。", "？", " ", "　", "\x1c", "\x0b", "\r\n", "``"]
    return ["", " ", "the the the", "中文检索 test 中"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def pairs(spark):
    a, b = strings(seed=1), strings(seed=2)
    return spark.createDataFrame(list(zip(range(len(a)), a, b)), "i int, a string, b string"), a, b


def values(df, c):
    return [r[0] for r in df.orderBy("i").select(c).collect()]


def test_tokens(pairs):
    df, a, _ = pairs
    assert values(df, T.tokens("a")) == [py_tokens(x) for x in a]


def test_strip_and_collapse(pairs):
    df, a, _ = pairs
    assert values(df, T.strip("a")) == [x.strip() for x in a]
    assert values(df, T.collapse("a")) == [re.sub(r"\s+", " ", x).strip() for x in a]
    assert values(df, T.compact("a")) == [re.sub(r"\s+", "", x.lower()) for x in a]


def test_lines(pairs):
    df, a, _ = pairs
    assert values(df, T.lines("a")) == [[r.strip() for r in x.splitlines() if r.strip()] for x in a]


def test_alnum(pairs):
    df, a, _ = pairs
    assert values(df, T.alnum("a")) == ["".join(c.lower() for c in x if c.isalnum()) for x in a]


def test_cosine_coverage(pairs):
    df, a, b = pairs
    listed = df.withColumn("l", T.tokens("a")).withColumn("r", T.tokens("b"))

    def cosine(x, y):
        l, r = Counter(py_tokens(x)), Counter(py_tokens(y))
        if not l or not r:
            return 0.0
        dot = sum(v * r[k] for k, v in l.items())
        return dot / math.sqrt(sum(v * v for v in l.values())) / math.sqrt(sum(v * v for v in r.values()))

    assert values(listed, T.token_cosine(F.col("l"), F.col("r"))) == pytest.approx([cosine(x, y) for x, y in zip(a, b)])
    cover = [len(set(py_tokens(x)) & set(py_tokens(y))) / len(set(py_tokens(x))) if py_tokens(x) else 0.0 for x, y in zip(a, b)]
    assert values(listed, T.token_coverage(F.col("l"), F.col("r"))) == pytest.approx(cover)


def test_keyword_phrase(spark):
    rows = [(0, "graph, neural  nets", "Neural graph of things"), (1, "a b", "a b"), (2, "", "x"), (3, "深度 学习", "关于深度学习"), (4, "Neural graph", "the neuralgraph")]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    assert values(df, T.keyword_score("a", "b")) == pytest.approx([2 / 3, 0.0, 0.0, 1.0, 1.0])
    assert values(df, T.phrase_score("a", "b")) == pytest.approx([2 / 3, 1.0, 0.0, 1.0, 1.0])


def test_headings(spark):
    rows = [(0, "## A title  \nbody"), (1, "no heading"), (2, "  # x"), (3, "####### seven"), (4, "")]
    df = spark.createDataFrame(rows, "i int, a string")
    assert values(df, T.markdown_section("a")) == ["A title", None, "x", None, None]
    assert values(df, T.first_line_section("a")) == ["A title", None, "x", "seven", None]


def test_noise_and_page_numbers(spark):
    rows = [(0, "two\x01 controls\x02"), (1, "a1b c2d plain"), (2, "a1b c2d words here that are long enough to be fine really"),
            (3, "7KLQN 2EV 5HPRWH zzzzzzzz"), (4, "Page 3 of 9"), (5, "12"), (6, "3 / 9"), (7, "page three"), (8, "3 ／9"), (9, "")]
    df = spark.createDataFrame(rows, "i int, a string")
    assert values(df, rules.corrupted_block(F.col("a"))) == [True, False, False, True] + [False] * 6
    assert values(df, rules.page_number_line(F.col("a"))) == [False] * 4 + [True, True, True, False, True, False]


def test_context_rules(spark):
    rows = [(0, "short", "short"), (1, "What did they find in the experiment on large graphs?", "x"), (2, "Explain graph neural network training in detail please", "y"),
            (3, "它如何工作以及为什么会在大规模数据上表现良好呢请详细说明", "z")]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    assert values(df, K.needs_context(F.col("a"))) == [True, True, False, True]
    wrapped = F.concat(F.lit("History. Current research question: "), "a")
    assert values(df, K.unwrap_question(wrapped)) == [r[1] for r in rows]
    got = values(df, K.query_for_analysis(F.col("a"), wrapped))
    assert got[2] == rows[2][1] and got[0].startswith("History.")


def test_source_rules(spark):
    n = F.lit(None).cast("string")
    rows = [(0, "research:repo-x"), (1, "arxiv_1"), (2, "docs"), (3, "leaderboard"), (4, "other thing"), (5, "github paper")]
    df = spark.createDataFrame(rows, "i int, a string")
    assert values(df, rules.source_type(F.col("a"), n, n, n, n)) == ["repository", "paper", "documentation", "benchmark", "other", "repository"]
    assert values(df, rules.source_type(F.col("a"), F.lit("PAPER"), n, F.lit("c"), n)) == ["paper"] * 6
    labels = [(0, "raw", "raw", "research:my_doc"), (1, None, "A: b", "s"), (2, "", "content", "document"), (3, "research:a_b", "x", "y")]
    df = spark.createDataFrame(labels, "i int, m string, t string, s string")
    assert values(df, rules.source_label(F.col("m"), F.col("t"), F.col("s"))) == ["my-doc", "A", None, "a-b"]


def test_repository_address(spark):
    rows = [(0, "https://github.com/a/b.git"), (1, "https://www.github.com/a/b/"), (2, "http://github.com/a/b"), (3, "https://github.com/a"), (4, "https://user@github.com/a/b"),
            (5, "https://github.com/a/b?x=1"), (6, "https://github.com/a/b/c"), (7, " https://github.com/a/b ")]
    df = spark.createDataFrame(rows, "i int, a string")
    want = "https://github.com/a/b"
    assert values(df, rules.repository_url(F.col("a"))) == [want, want, None, None, None, None, None, want]


def test_display(spark):
    df = spark.createDataFrame([(0, 1), (1, 1024), (2, 1536), (3, 5 * 1024 * 1024)], "i int, n long")
    assert values(df, rules.byte_size(F.col("n"))) == ["1 B", "1.0 KB", "1.5 KB", "5.0 MB"]
    df = spark.createDataFrame([(0, "task:research:draft"), (1, "task:own_kind")], "i int, a string")
    assert values(df, rules.task_label(F.col("a"))) == ["Draft Generation", "own kind"]
    df = spark.createDataFrame([(0, "2026-01-02T03:04:05"), (1, "bad")], "i int, a string")
    assert values(df, rules.display_time(F.col("a"))) == ["Jan 2, 2026, 3:04 AM", "Not available"]
