"""Removal of byte strings that occur more than once, by bucket-pointer refinement.

A sparse suffix array is enough: of every window of ``length`` bytes only the
leftmost least q-gram inside it, its anchor, is looked at. Equal windows have
equal anchors at equal offsets, so

1. suffixes at anchors fall into buckets by their first q bytes; a bucket with a
   single suffix has no repeated window and is dropped,
2. a bucket is refined by the bucket of the whole text range that the anchor's
   windows can reach; where two suffixes still agree, all their windows repeat,
3. only suffixes left alone by step 2 in a bucket that others share are refined
   to single windows. Windows of classes settled in step 2 take part through one
   member, whose result serves all of them.

Bucket identifiers are 64-bit hashes of the bytes they stand for.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from groundline.llm.base import Scratch, flat, mix, slices, text_bytes
from groundline.llm.blocks import ASKED, BLOCK_BYTES, BUCKET_BYTES, answer_all, blocked, in_order, request, unpacked, with_answers

LENGTH, GRAM = 200, 100
#: Classes of one q-gram bucket that a block sends; with more, it knows the bucket to be shared.
CLASSES = 8
#: Low bits of a sort key that hold a position.
PLACE_BITS = 28
FACTOR = 0xD1342543DE82EF95
SETTLED, REFINE = 1, 2

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


@dataclass
class Part:
    """Texts of one slice as bytes, with prefix hashes."""

    data: np.ndarray
    starts: np.ndarray
    prefix: np.ndarray
    inverse: np.ndarray

    def hash(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Hash of the bytes from low to high (exclusive)."""
        with np.errstate(over="ignore"):
            return mix((self.prefix[high] - self.prefix[low]) * self.inverse[low] + (high - low).astype(np.uint64))


BYTE_VALUES = np.random.default_rng(20240307).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** n modulo 2 ** 64; kept for the next slice, which is about as long."""
    known = POWERS.get(base)
    if known is None or len(known) <= n:
        with np.errstate(over="ignore"):
            known = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n + n // 8, base, np.uint64)]), dtype=np.uint64)
        POWERS[base] = known
    return known[:n + 1]


def read_part(texts: list[bytes]) -> Part:
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    prefix = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE_VALUES[data] * powers(FACTOR, len(data))[:-1], out=prefix[1:])
    return Part(data, starts, prefix, powers(pow(FACTOR, -1, 1 << 64), len(data)))


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every run of ``width`` values, from running minima of fixed blocks."""
    n = len(values) - width + 1
    high = np.iinfo(values.dtype).max
    grid = np.concatenate([values, np.full(-len(values) % width, high, values.dtype)]).reshape(-1, width)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1:width - 1 + n])


@dataclass
class Anchors:
    """Per anchor: text, position, its first and last window, q-gram bucket and range bucket."""

    text: np.ndarray
    place: np.ndarray
    first: np.ndarray
    last: np.ndarray
    gram: np.ndarray
    reach: np.ndarray


def find_anchors(part: Part, length: int, gram: int) -> Anchors:
    n = len(part.data)
    none = np.zeros(0, np.int64)
    if n < length:
        return Anchors(none, none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    at = np.arange(n - gram + 1)
    grams = part.hash(at, at + gram)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = window_minimum((grams & ~low) | at.astype(np.uint64), length - gram + 1)
    whole = np.zeros(n - length + 1, bool)
    for a, b in zip(part.starts[:-1].tolist(), part.starts[1:].tolist(), strict=True):
        if b - a >= length:
            whole[a:b - length + 1] = True
    windows = np.flatnonzero(whole)
    if not len(windows):
        return Anchors(none, none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    anchor = (least[windows] & low).astype(np.int64)
    new = np.ones(len(windows), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    begin = np.flatnonzero(new)
    place = anchor[begin]
    first, last = windows[begin], windows[np.append(begin[1:], len(windows)) - 1]
    text = np.searchsorted(part.starts, place, side="right") - 1
    left = np.maximum(place - (length - gram), part.starts[text])
    right = np.minimum(place + length, part.starts[text + 1])
    with np.errstate(over="ignore"):
        reach = mix(part.hash(left, right) + ((place - left) * 4096 + (right - place)).astype(np.uint64))
    return Anchors(text, place, first, last, grams[place], reach)


def _parts(table: pa.Table) -> Iterator[tuple[pa.Table, Part]]:
    for piece in slices(table, "text"):
        yield piece, read_part([t.encode() for t in pc.fill_null(flat(piece.column("text")), "").to_pylist()])


@dataclass
class Classes:
    """Distinct (gram, reach) pairs of a block in order, how often each occurs, and which are asked about."""

    gram: np.ndarray
    reach: np.ndarray
    times: np.ndarray
    asked: np.ndarray
    crowded: np.ndarray
    member: np.ndarray

    @property
    def own(self) -> np.ndarray:
        """What the block knows without asking."""
        return np.where(self.crowded, REFINE, 0) | np.where(self.times > 1, SETTLED, 0)


def classes(gram: np.ndarray, reach: np.ndarray) -> Classes:
    order = np.lexsort((reach, gram))
    g, r = gram[order], reach[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
    begin = np.flatnonzero(new)
    times = np.diff(np.append(begin, len(g)))
    member = np.empty(len(g), np.int64)
    member[order] = np.cumsum(new) - 1
    g, r = g[begin], r[begin]
    head = np.ones(len(g), bool)
    head[1:] = g[1:] != g[:-1]
    heads = np.flatnonzero(head)
    per_gram = np.diff(np.append(heads, len(g)))
    rank = np.arange(len(g)) - np.repeat(heads, per_gram)
    crowded = np.repeat(per_gram > CLASSES, per_gram)
    return Classes(g, r, times, ~crowded | (rank < 2), crowded, member)


def _block_classes(anchors: list[Anchors]) -> Classes:
    empty = [np.zeros(0, np.uint64)]
    return classes(np.concatenate([a.gram for a in anchors] or empty), np.concatenate([a.reach for a in anchors] or empty))


def _ask_classes(length: int, gram: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        found = _block_classes([find_anchors(part, length, gram) for _, part in _parts(table)])
        sent = found.asked
        return request(table.column("block")[0].as_py(), found.gram[sent],
                       [found.reach[sent], np.minimum(found.times[sent], 2).astype(np.uint8)], buckets)
    return run


def _answer_classes(table: pa.Table) -> pa.Table:
    """For each asked class: is it settled (it occurs twice), and must this block refine its windows?"""
    asked = sorted(unpacked(table), key=lambda a: a[0])
    sizes = [len(k) for _, k, _ in asked]
    gram = np.concatenate([k for _, k, _ in asked])
    reach = np.concatenate([np.frombuffer(e[:8 * n], np.uint64) for (_, _, e), n in zip(asked, sizes, strict=True)])
    times = np.concatenate([np.frombuffer(e[8 * n:], np.uint8) for (_, _, e), n in zip(asked, sizes, strict=True)]).astype(np.int64)
    order = np.lexsort((reach, gram))  # stable: a class's first row is of its lowest block
    g, r = gram[order], reach[order]
    head = np.ones(len(g), bool)
    head[1:] = g[1:] != g[:-1]
    new = head.copy()
    new[1:] |= r[1:] != r[:-1]
    class_of, gram_of = np.cumsum(new) - 1, np.cumsum(head) - 1
    settled = np.bincount(class_of, times[order])[class_of] >= 2
    shared = np.bincount(gram_of, new)[gram_of] >= 2
    status = np.where(settled, SETTLED, 0) | np.where(shared & (new | ~settled), REFINE, 0)
    out = np.empty(len(g), np.uint8)
    out[order] = status
    return _split(table, asked, sizes, out)


def _split(table: pa.Table, asked: list, sizes: list[int], out: np.ndarray) -> pa.Table:
    ends = np.cumsum(sizes)
    return pa.table({"block": pa.array([b for b, _, _ in asked], pa.int32()),
                     "bucket": pa.array([table.column("bucket")[0].as_py()] * len(asked), pa.int32()),
                     "answer": pa.array([out[e - n:e].tobytes() for e, n in zip(ends, sizes, strict=True)], pa.binary())})


def _statuses(anchors: list[Anchors], answers: pa.Table) -> list[np.ndarray]:
    """Status of every anchor of a block, slice by slice."""
    found = _block_classes(anchors)
    status = found.own.astype(np.uint8)
    status[found.asked] |= in_order(answers, np.uint8)
    cuts = np.cumsum([len(a.gram) for a in anchors])[:-1]
    return np.split(status[found.member], cuts)


def _windows(anchors: Anchors, chosen: np.ndarray) -> np.ndarray:
    """Window positions of the chosen anchors."""
    first, n = anchors.first[chosen], (anchors.last - anchors.first + 1)[chosen]
    total = int(n.sum())
    return np.arange(total) + np.repeat(first - (np.cumsum(n) - n), n) if total else np.zeros(0, np.int64)


def _refined(parts: list[tuple[pa.Table, Part]], anchors: list[Anchors], status: list[np.ndarray], length: int):
    """Windows to decide singly in each slice and their buckets."""
    spots = [_windows(a, (s & REFINE) > 0) for a, s in zip(anchors, status, strict=True)]
    return spots, [p.hash(w, w + length) for (_, p), w in zip(parts, spots, strict=True)]


def _ask_windows(length: int, gram: int, buckets: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows or not answers.num_rows:
            return request(0, np.zeros(0, np.uint64), [], buckets)
        parts = list(_parts(docs))
        anchors = [find_anchors(p, length, gram) for _, p in parts]
        _, hashes = _refined(parts, anchors, _statuses(anchors, answers), length)
        keys, times = np.unique(np.concatenate(hashes), return_counts=True)
        return request(docs.column("block")[0].as_py(), keys, [np.minimum(times, 2).astype(np.uint8)], buckets)
    return run


def _answer_windows(table: pa.Table) -> pa.Table:
    """For each asked window: does it occur at least twice?"""
    asked = list(unpacked(table))
    _, place = np.unique(np.concatenate([k for _, k, _ in asked]), return_inverse=True)
    times = np.concatenate([np.frombuffer(e, np.uint8) for _, _, e in asked])
    out = (np.bincount(place, times)[place] >= 2).astype(np.uint8)
    return _split(table, asked, [len(k) for _, k, _ in asked], out)


def _runs(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Number of maximal runs of flags in each text."""
    before = np.concatenate([[False], flags[:-1]])
    before[starts[:-1][starts[:-1] < len(flags)]] = False
    total = np.concatenate([[0], np.cumsum(flags & ~before)])
    return total[starts[1:]] - total[starts[:-1]]


def _remove(length: int, gram: int, texts: bool):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        first = answers.filter(pc.equal(answers.column("round"), 1))
        second = answers.filter(pc.equal(answers.column("round"), 2))
        parts = list(_parts(docs))
        anchors = [find_anchors(p, length, gram) for _, p in parts]
        status = _statuses(anchors, first) if first.num_rows else [np.zeros(len(a.gram), np.uint8) for a in anchors]
        spots, hashes = _refined(parts, anchors, status, length)
        keys = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        repeated = in_order(second, np.uint8) > 0
        rows = []
        for (piece, part), a, s, spot, hashed in zip(parts, anchors, status, spots, hashes, strict=True):
            edge = np.zeros(len(part.data) + length + 1, np.int64)
            begin = np.concatenate([_windows(a, (s & SETTLED) > 0), spot[repeated[np.searchsorted(keys, hashed)]]])
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + length, -1)
            gone = np.cumsum(edge)[:len(part.data)] > 0
            spans = _runs(gone, part.starts)
            removed = np.concatenate([[0], np.cumsum(gone)])[part.starts]
            for i, doc in enumerate(piece.column("doc_id").to_pylist()):
                low, high = part.starts[i], part.starts[i + 1]
                kept = part.data[low:high][~gone[low:high]].tobytes()
                rows.append((doc, int(high - low), int(removed[i + 1] - removed[i]), int(spans[i]), hashlib.sha256(kept).hexdigest(), kept))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        shown = 6 if texts else 5
        return pa.table({n: pa.array(c, t) for n, c, t in list(zip(names, columns, types, strict=True))[:shown]})
    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, texts: bool = False) -> DataFrame:
    """Per input row what is left of its text's UTF-8 bytes once every repeated string of ``length`` bytes is cut.

    Every byte goes that lies in a ``length``-byte string which starts somewhere
    else too, in the same document or another; strings never cross documents and
    are judged on the input. Returned: doc_id, n_bytes, n_removed, n_spans
    (maximal removed runs), kept_sha256, and with ``texts`` the kept bytes. Null
    texts are empty, shorter texts are kept; repeated rows are documents of their
    own and so repeat each other; a null doc_id stays null; an empty table gives
    no rows; other columns are ignored.

    Blocks of documents exchange packed bucket identifiers (``blocks``): one per
    distinct anchor class and block, then one per undecided window and block.
    A string that stands in a third of all rows is sent once from each block,
    and of a q-gram with many continuations only two are.
    """
    if not 0 < gram < length:
        raise ValueError("gram must be between 1 and length - 1")
    scratch = Scratch(docs.sparkSession, "substrings")
    size = text_bytes(docs)
    # three rounds keep a block's anchors: half of the usual block
    blocks, buckets = max(1, math.ceil(2 * size / BLOCK_BYTES)), max(1, math.ceil(size / BUCKET_BYTES))
    source = blocked(docs, blocks)
    asked = source.groupBy("block").applyInArrow(_ask_classes(length, gram, buckets), ASKED)
    settled = scratch.write(answer_all(asked, _answer_classes), "classes")
    asked = with_answers(source, settled, _ask_windows(length, gram, buckets), ASKED)
    windows = scratch.write(answer_all(asked, _answer_windows), "windows")
    both = settled.withColumn("round", F.lit(1)).union(windows.withColumn("round", F.lit(2)))
    return with_answers(source, both, _remove(length, gram, texts), RESULT + (", kept binary" if texts else ""))
