"""Heading-aware chunks, windows and code chunks against small brute-force readers."""

import random
import re

from pyspark.sql import functions as F

from groundline.functions import rules
from groundline.functions import text as T
from groundline.operators.chunking import section_chunks, windows


def brute_cut(s, limit):
    out = []
    while len(s) > limit:
        space = s[:limit].rfind(" ")
        at = space if space >= limit // 2 else limit
        out.append(s[:at].strip())
        s = s[at:].strip()
    return [x for x in out + [s] if x]


def brute_pack(units, limit, glue):
    out, open_ = [], ""
    for text, sealed in units:
        if sealed:
            out += ([open_] if open_ else []) + [text]
            open_ = ""
        elif open_ and len(open_ + glue + text) > limit:
            out.append(open_)
            open_ = text
        else:
            open_ = open_ + glue + text if open_ else text
    return out + ([open_] if open_ else [])


def brute_chunks(doc, size):
    found, rows = [["Document", []]], []
    for line in doc.splitlines():
        m = re.match(r"^(#{1,6})\s+(.+?)\s*$", line)
        if m:
            found.append([m.group(2).strip(), []])
        else:
            found[-1][1].append(line)
    for section, lines in found:
        head = f"## {section}\n\n"
        limit, units = max(1, size - len(head)), []
        for p in filter(None, (x.strip() for x in re.split(r"\n\s*\n", "\n".join(lines).strip()))):
            if len(p) <= limit:
                units.append(p)
                continue
            sents = []
            for s in filter(None, (x.strip() for x in re.split(r"(?<=[.!?。！？])\s+", p))):
                sents += [(s, False)] if len(s) <= limit else [(c, True) for c in brute_cut(s, limit)]
            units += brute_pack(sents, limit, " ")
        rows += [head + b for b in brute_pack([(u, False) for u in units], limit, "\n\n")]
    return rows


def documents():
    rng = random.Random(3)
    parts = ["# One\n", "## Two words  \n", "\n\n", "\n \t\n", "word ", "Sentence here. ", "中文句子。 ", "x" * 70 + " ", "!? ", "```\n# not code\n```\n", "\r\n", "\x0c", "#nohead\n", "##\n", "\x85", "tail", "### " + "h" * 80 + "\n"]
    return ["", "only text", "# head only", "## a\nbody"] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(150)]


def test_section_chunks(spark):
    docs = documents()
    df = spark.createDataFrame(list(enumerate(docs)), "i int, text string")
    for size in (60, 200, 1800):
        got = {}
        for r in section_chunks(df, "text", size).orderBy("i", "section_no", "part").collect():
            got.setdefault(r["i"], []).append(r["content"])
        assert [got.get(i, []) for i in range(len(docs))] == [brute_chunks(d, size) for d in docs]


def test_windows(spark):
    texts = ["", "a", "ab" * 40, "é中" * 33]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(windows(F.col("t"), 10, 3)).collect()]
    assert got == [[t[i:i + 10] for i in range(0, len(t), 7)] for t in texts]


def test_identifier_columns(spark):
    row = spark.range(1).select(rules.structural_tokens(T.strings(["run.messages", "items"])).alias("t"),
                                rules.identifier_aliases(T.strings(["message", "unknown_word"])).alias("a")).first()
    assert list(row["t"]) == sorted({"run.messages", "items", "run", "messages", "run.message", "item"}) and row["a"] == "消息"
