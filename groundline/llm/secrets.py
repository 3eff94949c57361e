"""Secret scan: fixed patterns, and random strings found by their token efficiency.

A byte-pair vocabulary spends few tokens on words and many on random strings, so
the characters per token of a run of key-like characters tell the two apart.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from groundline.llm.base import flat, ship_package, slices

KINDS = ("assign", "access", "hex", "random")
#: Fixed patterns of the base kinds (ASCII letters in either case for the keyword of ``assign``).
ASSIGN = re.compile(r"""((?:(?ai:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORD_PARTS = ("passw", "secret", "token", "api")
#: Key-like runs that the token-efficiency test looks at.
RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
#: Hex digits of known digests: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
HEX_ANY = re.compile(r"[0-9A-Fa-f]+")
PART = re.compile(r"([A-Za-z]+)[0-9]{0,4}|[0-9]*")
MAX_CHARS_PER_TOKEN = 2.0

SCHEMA = ("doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
          "n_random long")


@lru_cache(maxsize=4)
def vocabulary(path: str | None):
    """tiktoken encoding of a rank file (default: the installed byte-level vocabulary)."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def is_known(run: str, encoding, limit: float = MAX_CHARS_PER_TOKEN) -> bool:
    """Digests, UUIDs, numbers and identifiers made of words and short numbers.

    The shape alone makes no identifier: its letters must have ``limit`` characters a token.
    """
    if UUID.fullmatch(run) or (len(run) in DIGEST_LENGTHS and HEX_ANY.fullmatch(run)):
        return True
    parts = [PART.fullmatch(part) for part in re.split(r"[+/_=-]", run)]
    if not all(parts):
        return False
    letters = [m[1] for m in parts if m[1]]
    if len(letters) > 1:  # constants in capitals have the words of lower case
        letters = [w.lower() if w.isupper() else w for w in letters]
    return sum(map(len, letters)) >= limit * sum(len(encoding.encode_ordinary(w)) for w in letters)


def random_spans(text: str, encoding, limit: float = MAX_CHARS_PER_TOKEN) -> list[tuple[int, int]]:
    """Key-like runs of under ``limit`` characters a token that are no known digest or identifier."""
    return [(m.start(), m.end()) for m in RUN.finditer(text)
            if len(m[0]) < limit * len(encoding.encode_ordinary(m[0])) and not is_known(m[0], encoding, limit)]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the fixed patterns in code points, sorted."""
    found: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(part in low for part in KEYWORD_PARTS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def scan_text(text: str, encoding) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) of one text."""
    base = base_spans(text)
    extra = [(a, b, 3) for a, b in random_spans(text, encoding)]
    return base, sorted(base + extra, key=lambda s: (s[0], s[2])) if extra else base


def scan(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """Secret spans of every document: one row per input row, any input order.

    Null texts count as empty and give zero counts, an empty ``spans`` and the
    hash of the empty string. Repeated rows give repeated results; a null doc_id
    stays null; other columns are ignored. Offsets are code points, ends exclusive.
    Each text is handled whole and alone, so there is no shuffle.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = vocabulary(vocabulary_path)
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for text in pc.fill_null(flat(part.column("text")), "").to_pylist():
                    base, spans = scan_text(text, encoding)
                    n = [sum(s[2] == k for s in spans) for k in range(4)]
                    rows.append((*n[:3], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), n[3]))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [flat(part.column("doc_id")), *(pa.array(columns[i], pa.int64()) for i in range(3)),
                     pa.array(columns[3], pa.string()), pa.array(columns[4], pa.string()), pa.array(columns[5], pa.int64())],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, vocabulary_path: str | None = None, mark: str = "[secret]") -> DataFrame:
    """Documents with every found span replaced by ``mark``; ``n_chars`` follows the new text.

    Overlapping spans are replaced once. Null texts stay null. Columns, rows and
    texts without secrets are returned as they are.
    """
    ship_package(docs.sparkSession)

    def clean(text: str, encoding) -> str:
        spans = scan_text(text, encoding)[1]
        if not spans:
            return text
        out, at = [], 0
        for start, end, _ in spans:
            if start >= at:
                out += [text[at:start], mark]
            at = max(at, end)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = vocabulary(vocabulary_path)
        for batch in batches:
            texts = [None if t is None else clean(t, encoding) for t in batch.column("text").to_pylist()]
            new = {"text": pa.array(texts, pa.string())}
            if "n_chars" in batch.schema.names:
                n = pa.array([None if t is None else len(t) for t in texts], pa.int64())
                new["n_chars"] = n.cast(batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in batch.schema.names], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
