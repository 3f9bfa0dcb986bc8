"""Exact deduplication of byte strings by suffix sorting in blocks, with a difference cover.

Suffixes are sorted a bucket at a time, each only as far as its window of `length` bytes needs. Within a bucket, the
suffixes at sample places (those whose place modulo V lies in a difference cover) are ranked first, by their
first V bytes and then by doubling. A window is ordered by its first V bytes; longer ties are resolved by the
rank of the sample suffix that follows within V bytes, so no tie is ever compared byte by byte, however long. Memory is the
bucket's bytes times a constant.

Segments are laid out so that their anchors stand at multiples of V. Windows that may be equal then have equal places
modulo V, and one distance to the sample serves all members of a tie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices
from .repeats import Group, Kind, covered, identified, repeated_places

V = 32
#: Every difference modulo V is one of two members: b - a for b a multiple of ROOT and a below it.
ROOT = int(np.ceil(np.sqrt(V)))
COVER = np.unique([*range(ROOT), *(ROOT * q % V for q in range(1, -(-(V - 1) // ROOT) + 1))])
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


PACKED_BITS = 21


def ranks(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of pairs of numbers, and each pair's rank from 1, equal for equal pairs. Up to 2**21 pairs of such numbers are sorted as plain integers, with their places in the low bits."""
    n = len(high)
    if n < 1 << PACKED_BITS and high.max(initial=0) < 1 << (62 - PACKED_BITS if low is _NONE else PACKED_BITS) and low.max(initial=0) < 1 << PACKED_BITS:
        keys = high if low is _NONE else high << PACKED_BITS | low
        keys = np.sort(keys << PACKED_BITS | np.arange(n))
        order = keys & ((1 << PACKED_BITS) - 1)
        keys >>= PACKED_BITS
        new = keys[1:] != keys[:-1]
    else:
        low = np.broadcast_to(low, n) if low is _NONE else low
        order = np.lexsort((low, high))
        new = (high[order[1:]] != high[order[:-1]]) | (low[order[1:]] != low[order[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.concatenate([np.ones(min(n, 1), np.int64), new]))
    return order, rank


_NONE = np.zeros(1, np.int64)


def equal_windows(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A number for each window data[start : start + length], equal for equal windows, which must have equal starts modulo V."""
    n = len(data)
    padded = np.zeros(n + V + 8, np.uint8)
    padded[:n] = data
    ahead = lambda rank, by: np.concatenate([rank[by:], np.zeros(min(by, len(rank)), np.int64)])

    # ranks by the first V bytes, doubled from four
    _, rank = ranks(np.ndarray((n,), ">u4", padded, 0, (1,)).astype(np.int64), _NONE)
    depth = 4
    while depth < V:
        _, rank = ranks(rank, ahead(rank, depth))
        depth *= 2
    head = rank[starts]

    # ranks of sample suffixes, up to `length` bytes or more: their places repeat modulo V, so doubling stays in the sample
    sample = np.flatnonzero(np.isin(np.arange(V), COVER)[np.arange(n) % V])
    index = np.full(n + V, -1, np.int64)
    index[sample] = np.arange(len(sample))
    rank = ranks(rank[sample], _NONE)[1]
    while depth < length:
        follow = index[np.minimum(sample + depth, n)]
        _, rank = ranks(rank, np.where(follow >= 0, rank[follow], 0))
        depth *= 2

    # windows, by their first V bytes, their place modulo V and the rank of the sample suffix that follows
    step = np.array([min((c - r) % V for c in COVER) for r in range(V)])
    _, head = ranks(head * V + starts % V, _NONE)
    order, _ = ranks(head, rank[index[starts + step[starts % V]]])

    # neighbours are equal if they agree in all bytes
    words = np.ndarray((n + V,), np.uint64, padded, 0, (1,))
    open_ = np.flatnonzero(head[order[1:]] == head[order[:-1]])
    a, b = starts[order[:-1]], starts[order[1:]]
    if length < 8:
        for at in range(length):
            open_ = open_[padded[a[open_] + at] == padded[b[open_] + at]]
    else:
        for at in [*range(0, length - 7, 8), length - 8]:
            open_ = open_[words[a[open_] + at] == words[b[open_] + at]]
    new = np.ones(len(starts), bool)
    new[open_ + 1] = False
    out = np.empty(len(starts), np.int64)
    out[order] = np.cumsum(new)
    return out


def layout(group: Group) -> tuple[np.ndarray, np.ndarray]:
    """The segments' bytes, each moved so that its anchor stands at a multiple of V, and where each starts."""
    sizes = np.diff(group.offsets)
    room = (sizes + 2 * V) // V * V + V
    at = np.cumsum(room) - room
    at += (-(at + group.lead)) % V
    data = np.zeros(int(room.sum()) + V, np.uint8)
    place = np.arange(len(group.tokens)) + np.repeat(at - group.offsets[:-1], sizes)
    data[place] = group.tokens
    return data, at


def suffix_compare(length: int):
    """Marks the windows of a bucket that occur twice."""

    def compare(group: Group) -> np.ndarray:
        data, at = layout(group)
        seg, number, _ = group.starts()
        starts = at[seg] + number
        same = equal_windows(data, starts, length)
        times = np.bincount(same, weights=group.copies[seg])
        return times[same] > 1

    return compare


def suffix_dedup(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sizes and the digest of each text without the bytes that a string of `length` bytes which starts twice or more covers.

    Defined results: a null text is empty; texts shorter than `length` keep all; places of one text count like those of
    several; all copies are removed; rows with equal or null ids are documents of their own; other columns are not carried."""
    kind = Kind(words=False, length=length, k=min(32, length), keep_first=False, block=16)
    found = repeated_places(identified(docs, id_col, text_col), kind, suffix_compare(length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                rows = []
                for text, places in zip(b.column("text").to_pylist(), b.column("places").to_pylist(), strict=True):
                    data = np.frombuffer(text.encode(), np.uint8)
                    gone = covered(len(data), places)
                    spans = int(gone[:1].sum() + np.count_nonzero(gone[1:] & ~gone[:-1]))
                    rows.append((len(data), int(gone.sum()), spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], [x.split()[0] for x in RESULT.split(", ")])

    return found.select("doc_id", "text", "places").mapInArrow(run, RESULT)
