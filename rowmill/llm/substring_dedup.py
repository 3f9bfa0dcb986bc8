"""Deduplication of word sequences with prefix-partitioned suffix trees.

The suffixes that start windows are split by variable-length prefixes: a group of suffixes that share a prefix and is
larger than `room` is split by one more word, until groups fit or the prefix is as long as a window. Each group's subtree
is built from its sorted suffixes and their longest common prefixes; its internal nodes at a depth of a window or
more are the repeats, and their leaves the places. Of a node's leaves the one that starts first is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices
from .repeats import Group, Kind, covered, identified, repeated_places

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def prefix_groups(tokens: np.ndarray, starts: np.ndarray, depth: int, room: int, at: int = 0) -> Iterator[tuple[np.ndarray, int]]:
    """(numbers of suffixes, length of the prefix they share) of the groups that prefixes of up to `depth` tokens make of at most `room` suffixes, where prefixes can."""
    todo = [(np.arange(len(starts)), at)]
    while todo:
        members, shared = todo.pop()
        if len(members) <= room or shared == depth:
            yield members, shared
            continue
        key = tokens[starts[members] + shared]
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        parts = np.split(members[order], cuts)
        # small groups go together: they differ in this token, but one subtree can hold them
        held: list[np.ndarray] = []
        for p in parts:
            if len(p) > room:
                todo.append((p, shared + 1))
            else:
                if held and sum(map(len, held)) + len(p) > room:
                    yield np.concatenate(held), shared
                    held = []
                held.append(p)
        if held:
            yield np.concatenate(held), shared


def subtree(tokens: np.ndarray, starts: np.ndarray, depth: int, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes that share their first `shared` tokens, to a depth, and the common prefix of each with the one before it: the leaves of a tree and the depths of its internal nodes between them."""
    columns = [tokens[starts + i] for i in range(shared, depth)]
    order = np.lexsort(columns[::-1]) if columns else np.arange(len(starts))
    common = np.full(len(order), shared, np.int64)
    open_ = np.arange(1, len(order))
    for c in columns:
        open_ = open_[c[order[open_]] == c[order[open_ - 1]]]
        common[open_] += 1
    common[:1] = 0
    return order, common


def deep_nodes(common: np.ndarray, depth: int) -> np.ndarray:
    """A number for each leaf in order: that of its highest ancestor at `depth` or deeper, or its own."""
    return np.cumsum(common < depth)


#: Suffixes of one subtree: its sort's columns stay in the processor's cache. Buckets hold some fifty times as many.
ROOM = 1 << 12


def tree_compare(length: int, room: int = ROOM):
    """Marks the windows that start again after their first place."""

    def compare(group: Group) -> np.ndarray:
        seg, number, starts = group.starts()
        _, tokens = np.unique(group.tokens, return_inverse=True)
        tokens = tokens.astype(np.int32)
        later = np.zeros(len(starts), bool)
        for members, shared in prefix_groups(tokens, starts, length, room):
            order, common = subtree(tokens, starts[members], length, shared)
            leaves, node = members[order], deep_nodes(common, length)
            by = np.lexsort([group.lo[seg[leaves]] + number[leaves], group.id[seg[leaves]], node])
            again = node[by[1:]] == node[by[:-1]]
            later[leaves[by[1:][again]]] = True
        return later

    return compare


def substring_dedup(docs: DataFrame, length: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sizes and the digest of each text's words without those that a window of `length` words covers which starts earlier too.

    Defined results: a null text has no words; texts shorter than a window keep all; earlier is a smaller id, or an earlier start in the same text;
    rows with equal or null ids are documents of their own, in the order of ids with nulls last; other columns are not carried."""
    kind = Kind(words=True, length=length, k=min(4, length), keep_first=True)
    found = repeated_places(identified(docs, id_col, text_col), kind, tree_compare(length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                rows = []
                for text, places in zip(b.column("text").to_pylist(), b.column("places").to_pylist(), strict=True):
                    words = text.encode().split()
                    gone = covered(len(words), places)
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if places else words
                    rows.append((len(words), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
                kinds = (pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], [x.split()[0] for x in RESULT.split(", ")])

    return found.select("doc_id", "text", "places").mapInArrow(run, RESULT)
