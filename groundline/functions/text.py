"""Text primitives as Column expressions (no UDFs)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from groundline import config as C

# Unicode white space and line breaks, spelled out because Java's
# \s and \R do not cover the same characters.
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
INLINE_WS = r"[ \t\x1f\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"
WS_CHARS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
CJK = r"[\x{4e00}-\x{9fff}]"
TERM_SPLIT = WS[:-1] + "，。！？、；：,.!?;:]+"
EDGE_MARKS = "。.!！?？;；"
NUL = "\x00"

Text = Column | str


def col(c: Text) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def strip(c: Text) -> Column:
    return F.btrim(col(c), F.lit(WS_CHARS))


def collapse(c: Text) -> Column:
    """White-space runs to one blank, ends trimmed.

    Every white-space character becomes a blank first, so the pattern only has to
    find runs of two or more, which are rare.
    """
    blanks = F.translate(col(c), WS_CHARS, " " * len(WS_CHARS))
    return F.btrim(F.regexp_replace(blanks, "  +", " "), F.lit(" "))


def compact(c: Text) -> Column:
    return F.regexp_replace(F.lower(col(c)), WS + "+", "")


def alnum(c: Text) -> Column:
    """Lower-cased letters and digits only: the form names are matched in."""
    return F.lower(F.regexp_replace(col(c), r"[^\p{L}\p{N}]", ""))


def contains_any(c: Text, terms) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(col(c), F.lit(t)) for t in terms])


def has_chinese(c: Text) -> Column:
    return F.regexp_like(col(c), F.lit(CJK))


def lines(c: Text) -> Column:
    """Trimmed non-blank lines."""
    return F.filter(F.transform(F.split(col(c), LINE_BREAK), lambda x: strip(x)), lambda x: x != "")


def ordered_distinct(c: Text) -> Column:
    return F.array_distinct(col(c))


# ---- search terms -------------------------------------------------------------

def tokens(c: Text) -> Column:
    """Word tokens and single CJK characters, then bigrams over all CJK characters."""
    low = F.lower(col(c))
    words = F.regexp_extract_all(low, F.lit(r"[a-z0-9_]+|" + CJK), F.lit(0))
    cjk = F.regexp_replace(low, r"[^\x{4e00}-\x{9fff}]+", "")
    # the look-ahead captures overlapping pairs
    pairs = F.regexp_extract_all(cjk, F.lit("(?=(..))"), F.lit(1))
    # most texts hold no CJK character and need no second pass
    return F.when(F.regexp_like(low, F.lit(CJK)), F.concat(words, pairs)).otherwise(words)


def selector_tokens(c: Text) -> Column:
    """Distinct Latin words of three or more characters without stop words."""
    found = F.regexp_extract_all(col(c), F.lit(r"[A-Za-z][A-Za-z0-9_-]{2,}"), F.lit(0))
    return F.array_except(F.transform(found, F.lower), strings(C.SELECTOR_STOP_WORDS))


def keyword_terms(query: Text) -> Column:
    return F.filter(F.split(F.lower(col(query)), TERM_SPLIT), lambda t: F.length(t) >= 2)


def keyword_score(query: Text, content: Text) -> Column:
    terms, low = keyword_terms(query), F.lower(col(content))
    hits = F.size(F.filter(terms, lambda t: F.contains(low, t)))
    return F.when(F.size(terms) == 0, F.lit(0.0)).otherwise(hits / F.size(terms))


def phrase_score(query: Text, content: Text) -> Column:
    q = compact(query)
    return (
        F.when(q == "", F.lit(0.0))
        .when(F.contains(compact(content), q), F.lit(1.0))
        .otherwise(keyword_score(query, content))
    )


def count_of(array: Column, value: Column) -> Column:
    return F.size(array) - F.size(F.array_remove(array, value))


def squared_norm(array: Column) -> Column:
    """Sum of squared term counts of a token list, by run lengths of the sorted list."""
    start = F.struct(F.lit("").alias("term"), F.lit(0).alias("run"), F.lit(0).cast("long").alias("total"))

    def step(s, t):
        run = F.when(s["term"] == t, s["run"] + 1).otherwise(F.lit(1))
        # (r)^2 - (r-1)^2 = 2r - 1 when a run grows from r-1 to r
        return F.struct(t.alias("term"), run.alias("run"), (s["total"] + (2 * run - 1).cast("long")).alias("total"))

    return F.aggregate(F.array_sort(array), start, step, lambda s: s["total"])


def token_cosine(left: Column, right: Column) -> Column:
    """Cosine of term counts of two token-list columns."""
    dot = F.aggregate(
        F.array_intersect(left, right), F.lit(0).cast("long"),
        lambda acc, t: acc + (count_of(left, t) * count_of(right, t)).cast("long"),
    )
    norm = F.sqrt(squared_norm(left).cast("double")) * F.sqrt(squared_norm(right).cast("double"))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(dot / norm)


def token_coverage(query: Column, content: Column) -> Column:
    return F.when(F.size(query) == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(query, content)) / F.size(F.array_distinct(query))
    )


# ---- headings and keys ---------------------------------------------------------

def markdown_section(c: Text) -> Column:
    """Text of a heading at the start of ``c``; NULL when there is none."""
    found = F.regexp_extract(strip(c), r"^#{1,6}" + WS + r"+([^\n]+?)" + WS + r"*(\n|$)", 1)
    return F.nullif(strip(found), F.lit(""))


def first_line_section(c: Text) -> Column:
    """First line without leading ``#`` marks when it starts with one."""
    first = strip(F.element_at(F.split(col(c), LINE_BREAK), 1))
    return F.when(F.startswith(first, F.lit("#")), strip(F.ltrim(first, F.lit("#"))))


def digest(parts, length: int = 64) -> Column:
    """SHA-256 of NUL-separated parts, cut to ``length`` hex digits."""
    sep = F.lit(NUL)
    joined = parts[0]
    for p in parts[1:]:
        joined = F.concat(joined, sep, p)
    return F.substring(F.sha2(joined, 256), 1, length)


def sha(c: Text) -> Column:
    return F.sha2(col(c), 256)


def coalesce_text(*cs: Text) -> Column:
    """First value that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in cs])


def retrieval_text(zh: Column, provenance: list[Column], content: Text) -> Column:
    """Searchable text: translation, provenance fields, content; empty parts left out."""
    prov = F.concat_ws(" ", *[F.coalesce(p.cast("string"), F.lit("")) for p in provenance])
    return F.concat_ws("\n", *[F.nullif(x, F.lit("")) for x in (zh, prov, col(content))])
