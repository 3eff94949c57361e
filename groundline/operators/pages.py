"""Page text: dropped noise blocks, removed running heads, page sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from groundline.functions import text as T
from groundline.functions.rules import corrupted_block, page_number_line
from groundline.operators.chunking import section_chunks
from groundline.operators.ordering import join_per_key, split_lookup
from groundline.session import materialize


def page_text(blocks: DataFrame) -> DataFrame:
    """(doc, page, block_no, text) blocks to one text per page; pages left without blocks stay, empty."""
    text = T.strip("text")
    keep = (text != "") & ~corrupted_block(text)
    return blocks.groupBy("doc", "page").agg(
        F.array_sort(F.collect_list(F.when(keep, F.struct("block_no", text.alias("text"))))).alias("_b"),
    ).select("doc", "page", F.array_join(F.col("_b.text"), "\n\n").alias("text"), F.size("_b").cast("long").alias("n_blocks"))


def repeated_edges(pages: DataFrame) -> DataFrame:
    """Per document: page count and the lines most of its pages start or end with.

    A page offers at most four lines and a repeated line needs half of the pages,
    so a document has at most eight of them.
    """
    lines = F.col("_l")
    edges = F.array_distinct(F.concat(F.slice(lines, 1, 2), F.slice(lines, F.greatest(F.lit(1), F.size(lines) - 1), 2)))
    counts = materialize(pages.groupBy("doc").agg(F.count("*").alias("n_pages")), "page-counts")
    seen = (
        pages.select("doc", T.lines("text").alias("_l")).filter(F.size("_l") > 0)
        .select("doc", F.explode(edges).alias("line")).groupBy("doc", "line").agg(F.count("*").alias("n"))
    )
    need = F.greatest(F.lit(2), F.floor((F.col("n_pages") + 1) / 2))
    repeated = seen.filter((F.col("n") >= 2) & (F.length("line") <= 160))
    repeated = join_per_key(repeated, counts, ["doc"], "inner", "line").filter(F.col("n") >= need)
    return counts.join(repeated.groupBy("doc").agg(F.collect_list("line").alias("repeated")), "doc", "left")


def clean_pages(pages: DataFrame) -> DataFrame:
    """Pages without running heads and page-number lines."""
    stored = materialize(pages, "pages")
    rows = split_lookup(stored, materialize(repeated_edges(stored), "edges"), ["doc"], "n_pages")
    drop = F.coalesce("repeated", T.strings([]))
    kept = F.filter(T.lines("text"), lambda x: ~F.array_contains(drop, x) & ~page_number_line(x))
    joined = F.regexp_replace(F.array_join(kept, "\n"), r"[ \t]+", " ")
    return rows.select(*[c for c in pages.columns if c != "text"], T.strip(joined).alias("text"))


def page_chunks(pages: DataFrame, size: int | None = None) -> DataFrame:
    """Section chunks of cleaned non-empty pages, each page under its own heading."""
    titled = pages.filter("text <> ''").withColumn(
        "text", F.concat(F.lit("## Page "), F.col("page").cast("string"), F.lit("\n\n"), "text"))
    return section_chunks(titled, "text", size) if size else section_chunks(titled, "text")
