"""Benchmark decontamination by pigeonhole pieces and bit-parallel edit distance.

An item of m words may differ from a passage in e words (inserted, deleted or
replaced). Cut into e + 1 pieces, at least one piece then stands in the passage
unchanged, so exact piece hits give every candidate, and Myers' bit-parallel
distance, over words, decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from groundline.llm.base import flat, mix, ship_package, slices, words

#: Share of an item's words that may differ.
ERROR_SHARE = 0.2
#: Bytes of item text searched for in one pass over the documents.
PASS_BYTES = 8 << 20
EDGE = re.compile(r"^\W+|\W+$")
SCHEMA = "doc_id long, item_id long, start_word long, end_word long, distance long, errors_allowed long"


def match_hashes(found: pa.Array) -> np.ndarray:
    """Hash per word without case (A-Z) and without punctuation at its ends."""
    coded = pc.dictionary_encode(found)
    distinct = np.fromiter((xxhash.xxh3_64_intdigest(EDGE.sub("", w)) for w in coded.dictionary.to_pylist()),
                           np.uint64, len(coded.dictionary))
    return distinct[coded.indices.to_numpy(zero_copy_only=False)] if len(found) else np.zeros(0, np.uint64)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = mix(out + hashes[i:i + n] * np.uint64(2 * i + 3))
    return out


def piece_ranges(n_words: int, errors: int) -> list[tuple[int, int]]:
    """``errors + 1`` consecutive ranges of nearly equal length that cover all words."""
    cuts = np.linspace(0, n_words, errors + 2).astype(int)
    return [(int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


def best_match(pattern: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(least edit distance of the pattern to any run of the text, end of the first such run).

    Myers' column recurrence on integers of any width; the text side is free at both ends.
    """
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    at: dict[int, int] = {}
    for i, c in enumerate(pattern.tolist()):
        at[c] = at.get(c, 0) | (1 << i)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text.tolist(), 1):
        eq = at.get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(horizontal | plus))
        down = plus & horizontal
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1) & full, (down << 1) & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        if score < best:
            best, end = score, j
    return best, end


class Items:
    """Pieces of one pass of items: sorted piece hashes by piece length."""

    def __init__(self, rows: list[tuple[int, str]], share: float):
        self.ids, self.words, self.errors = [], [], []
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for item, text in rows:
            hashes = match_hashes(words(pa.array([text], pa.string()))[0])
            if not len(hashes):
                continue
            number, errors = len(self.ids), int(share * len(hashes))
            self.ids.append(item)
            self.words.append(hashes)
            self.errors.append(errors)
            for a, b in piece_ranges(len(hashes), errors):
                pieces.setdefault(b - a, []).append((int(windows(hashes[a:b], b - a)[0]), number, a))
        self.pieces = {}
        for size, found in pieces.items():
            found.sort()
            self.pieces[size] = (np.array([f[0] for f in found], np.uint64), np.array([f[1:] for f in found], np.int64))

    def search(self, hashes: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text number, item number, start, end, distance) for each item's best run in each text."""
        ends = np.cumsum(counts)
        spots: set[tuple[int, int, int]] = set()
        for size, (keys, targets) in self.pieces.items():
            seen = windows(hashes, size)
            left = np.searchsorted(keys, seen)
            hit = np.flatnonzero(keys[np.minimum(left, len(keys) - 1)] == seen)
            row = np.searchsorted(ends, hit, side="right")
            inside = hit + size <= ends[row] if len(hit) else np.zeros(0, bool)
            hit, row = hit[inside], row[inside]
            right = np.searchsorted(keys, seen[hit], side="right")
            for h, r, a, b in zip(hit.tolist(), row.tolist(), left[hit].tolist(), right.tolist(), strict=True):
                for number, offset in targets[a:b].tolist():
                    spots.add((r, number, h - offset))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        at, number = None, None
        for r, number, where in sorted(spots):
            low, high = int(ends[r] - counts[r]), int(ends[r])
            errors, pattern = self.errors[number], self.words[number]
            key = (r, number)
            # where the item would start; shifted by at most ``errors`` words
            if at is not None and at[0] == key and where == at[1]:
                continue
            at = (key, where)
            if key in best and best[key][0] == 0:
                continue
            a, b = max(low, where - errors), min(high, where + len(pattern) + errors)
            distance, end = best_match(pattern, hashes[a:b])
            if distance <= errors:
                # the reversed prefix gives the run's start
                back = best_match(pattern[::-1], hashes[a:a + end][::-1])[1]
                found = (distance, a + end - back - low, a + end - low)
                best[key] = min(best.get(key, found), found)
        return [(r, n, s, e, d) for (r, n), (d, s, e) in best.items()]


def item_passes(items: DataFrame, limit: int) -> list[list[tuple[int, str]]]:
    """Item rows in passes of at most ``limit`` bytes each (an item over the limit is a pass of its own).

    Only one pass is sent to tasks at a time.
    """
    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where(
        "text is not null").distinct().orderBy("item_id", "text").toLocalIterator()
    out, size = [], 0
    for item, text in rows:
        n = len(text.encode())
        if out and size + n > limit:
            yield out
            out, size = [], 0
        out.append((item, text))
        size += n
    if out:
        yield out


def find_leaks(docs: DataFrame, items: DataFrame, share: float = ERROR_SHARE, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """One row for each document and item it contains within the item's error budget.

    Words are compared without case and outer punctuation; an item of m words
    may differ in floor(share * m) of them. Returned: the run of least distance,
    as word numbers (start, end exclusive). Null texts and texts without words
    contain nothing, items without words are found nowhere, a null doc_id or
    item_id stays null, repeated rows give repeated results, no items or documents give no
    rows; other columns are ignored. Whole texts are searched where they lie:
    there is no shuffle, and the items go to the tasks in passes of bounded size.
    """
    ship_package(docs.sparkSession)
    source = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    out = None
    for rows in item_passes(items, pass_bytes):
        def run(batches: Iterator[pa.RecordBatch], rows=rows) -> Iterator[pa.RecordBatch]:
            wanted = Items(rows, share)
            for batch in batches:
                for part in slices(batch, "text"):
                    found, counts = words(part.column("text"))
                    hits = wanted.search(match_hashes(found), counts)
                    if hits:
                        r, n, start, end, distance = (list(c) for c in zip(*hits, strict=True))
                        yield pa.RecordBatch.from_arrays(
                            [flat(part.column("doc_id")).take(pa.array(r, pa.int64())),
                             *(pa.array(c, pa.int64()) for c in ([wanted.ids[i] for i in n], start, end, distance, [wanted.errors[i] for i in n]))],
                            names=["doc_id", "item_id", "start_word", "end_word", "distance", "errors_allowed"])

        found = source.mapInArrow(run, SCHEMA)
        out = found if out is None else out.union(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def keep_clean(docs: DataFrame, items: DataFrame, share: float = ERROR_SHARE, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Documents that contain no item within its error budget; all columns and rows stay as they are."""
    ship_package(docs.sparkSession)
    for rows in item_passes(items, pass_bytes):
        def run(batches: Iterator[pa.RecordBatch], rows=rows) -> Iterator[pa.RecordBatch]:
            wanted = Items(rows, share)
            for batch in batches:
                for part in slices(batch, "text"):
                    found, counts = words(part.column("text"))
                    keep = np.ones(part.num_rows, bool)
                    keep[[h[0] for h in wanted.search(match_hashes(found), counts)]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
