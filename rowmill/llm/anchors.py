"""Where windows of tokens may repeat: content-chosen anchors.

Every window of `length` tokens names one of its k-grams, the one with the smallest hash (of equal ones the first), as its
anchor. The choice depends on the window's content alone, so equal windows have equal anchors at equal places,
and windows need to be compared only if their anchors' k-grams are equal. Windows that start one after
another mostly share their anchor; such a run of windows is a segment. There are about 2 / (length - k + 2)
segments a token, which is what is shuffled instead of the windows themselves.
"""

from __future__ import annotations

import numpy as np

from .common import digests, gram_hashes, prefix_hash, span_hash

PLACE_BITS = np.uint64(26)
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minima of keys[i : i + width]: of blocks' suffixes and prefixes."""
    n = len(keys) - width + 1
    if n <= 0:
        return np.zeros(0, keys.dtype)
    blocks = np.full(-(-len(keys) // width) * width, NONE, np.uint64)
    blocks[: len(keys)] = keys
    blocks = blocks.reshape(-1, width)
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    right = np.minimum.accumulate(blocks, axis=1).ravel()[width - 1 : width - 1 + n]
    return np.minimum(left, right)


def segments(values: np.ndarray, offsets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(document, first window, number of windows, anchor's distance from it, hash of the anchor, digest of the segment) of each segment.

    values: the documents' tokens (bytes or uint64), one document after another at offsets; places are relative to
    the document. A segment holds its windows' tokens: number of windows + length - 1 of them."""
    n = len(values)
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if n < length:
        return empty
    assert n < 1 << int(PLACE_BITS)
    place = np.arange(n - k + 1)
    # bytes' anchors are only where windows meet; the windows themselves are compared
    grams = span_hash(prefix_hash(values), place, place + k) if values.dtype == np.uint8 else gram_hashes(values, k)
    keys = (grams & ~((np.uint64(1) << PLACE_BITS) - np.uint64(1))) | place.astype(np.uint64)
    least = sliding_min(keys, length - k + 1)
    # windows that lie within a document
    ends = np.repeat(offsets[1:], np.diff(offsets))[: n - length + 1]
    good = np.arange(n - length + 1) + length <= ends
    at = np.flatnonzero(good)
    if not len(at):
        return empty
    anchor = (least[at] & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    start, anchor = at[first], anchor[first]
    doc = np.searchsorted(offsets, start, "right") - 1
    whole = digests(values, start, start + count + length - 1)
    return doc, start - offsets[doc], count, anchor - start, grams[anchor], whole
