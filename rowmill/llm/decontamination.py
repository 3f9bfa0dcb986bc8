"""Benchmark decontamination: passages within an edit distance of a benchmark item.

With `free_ends`, as the query and the pipeline call it, a text is contaminated by an item of n words if some run of its
words, of any length, is within k = floor((1 - similarity) * n) word edits of it; such a run has n - k to n + k words.
Without, only runs of just n words count. Words are runs of letters and digits, lower-cased.

1. CGK. A walk embeds the words from a place on: at each step the current word is copied, and a random bit of (step, word) decides
   whether to move on. Sequences with few edits fall into step again, so edit distance becomes Hamming distance. All windows of all
   texts are embedded, whatever the items' sizes: what a walk of j steps has copied depends on j + 1 words at most. `walks`
   walks with bits of their own are used.
2. Bit sampling. Each walk has `tables` tables, whose keys are `bits` places of the embedding, sampled from a stretch of its steps; an item's
   own embedding is sampled at stretches from each of its words on. Windows that share a key with an item are candidates. Nothing else names
   candidates. A passage in reach, with k edits, keeps a run of z = n // (k + 1) words; a stretch of `reach` * z steps stays within such a run
   often enough, at one of the item's runs and walks, that the recall is over 0.99 also where edits are spread evenly, and most
   passages have longer runs. Keys that would need words beyond an item's end are not made.
3. A candidate names the item's place in the text; all places within k words are verified at once, by exact edit distance: with free ends
   that of the closest run around them, else those of the windows of the item's size.

Items are broadcast `block` at a time, and at most `block_bytes` of text; each block is searched in all texts. Nothing is shuffled.

Defined results: of equally close runs of a text and item the first is given; null and empty texts, and items without words, match nothing; repeated rows give repeated results; null ids
pass through; other columns are not carried, except by `drop_contaminated`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat_bytes, mix, seeded, slices, texts, word_hashes, word_spans

MATCHES = "doc_id long, item_id long, distance int, item_words int, start long"
#: Words that are embedded together.
PIECE = 1 << 14
_NO_WORD = np.ones(256, bool)
_NO_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def lower_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, and the texts' offsets."""
    data, offsets = flat_bytes(pa.array([t.lower() for t in texts(column)], pa.string()))
    starts, ends, first = word_spans(data, offsets, _NO_WORD)
    return word_hashes(data, starts, ends), first


def walked(words: np.ndarray, starts: np.ndarray, steps: int, walk: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The (copied words, their places) of each step of a walk from each start; words must go on for `steps` more."""
    # a bijection of the word, whose bits, one a step, decide on moves
    salts = seeded(f"walk {walk}", -(-steps // 64))
    at = np.array(starts)
    for j in range(steps):
        if j % 64 == 0:
            mixed = mix(words ^ salts[j // 64])
        word = mixed[at]
        yield word, at
        at = at + ((word >> np.uint64(j % 64)) & np.uint64(1)).view(np.int64)


def embed(windows: np.ndarray, walk: int) -> np.ndarray:
    """CGK embeddings, of 3n words, of windows of n words each (rows); after a window's end come zeros."""
    m, n = windows.shape
    padded = np.concatenate([windows, np.zeros((m, 3 * n), np.uint64)], axis=1)
    return np.stack([word for word, _ in walked(padded.ravel(), np.arange(m) * 4 * n, 3 * n, walk)], axis=1)


def sampled(stretch: int, walk: int, tables: int, bits: int) -> np.ndarray:
    """Rows of the steps, in order, that a walk's tables sample from a stretch."""
    order = [np.argsort(seeded(f"places {stretch} {walk} {t}", stretch))[: min(bits, stretch)] for t in range(tables)]
    return np.sort(np.stack(order), axis=1)


def lsh_keys(words: np.ndarray, starts: np.ndarray, stretches: list[int], walk: int, tables: int, bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(stretch, table, keys, place of the last word of each) of the walk from each start; words must go on for the longest stretch."""
    factor = seeded("key", bits) | np.uint64(1)
    places = {(z, t): row.tolist() for z in stretches for t, row in enumerate(sampled(z, walk, tables, bits))}
    keys: dict[tuple[int, int], np.ndarray] = {}
    for j, (word, at) in enumerate(walked(words, starts, max(stretches), walk)):
        for key, row in places.items():
            if j in row:
                part = word * factor[row.index(j)]
                keys[key] = keys[key] + part if key in keys else part
                if j == row[-1]:
                    yield *key, keys.pop(key), at


def edit_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Levenshtein distances of rows of words."""
    m, n = b.shape
    steps = np.arange(n + 1)
    row = np.broadcast_to(steps, (m, n + 1)).copy()
    for i in range(a.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (b != a[:, i : i + 1]))
        row = np.minimum.accumulate(new - steps, axis=1) + steps
    return row[:, -1]


def closest_runs(items: np.ndarray, sizes: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Levenshtein distance of each item, the first `sizes` words of a row and longest first, to the closest run of words of its region, and where the first such run begins."""
    m, n = regions.shape
    kind = np.int16 if n + items.shape[1] < 1 << 14 else np.int32
    back, steps = regions[:, ::-1], np.arange(n + 1, dtype=kind)
    row = np.zeros((m, n + 1), kind)
    # from the last word to the first, so that the last row is by the run's beginning
    for i in range(int(sizes.max(initial=0))):
        live = int(np.searchsorted(-sizes, -i))
        word = items[np.arange(live), sizes[:live] - 1 - i][:, None]
        new = np.empty((live, n + 1), kind)
        new[:, 0] = i + 1
        np.minimum(row[:live, 1:] + kind(1), row[:live, :-1] + (back[:live] != word), out=new[:, 1:])
        new -= steps
        np.minimum.accumulate(new, axis=1, out=new)
        row[:live] = new + steps
    return row.min(axis=1).astype(np.int64), row[:, ::-1].argmin(axis=1)


class ItemIndex:
    """Items' words and, for each walk, table and length of stretch, their keys."""

    def __init__(self, ids: list, column: pa.Array, similarity: float, walks: int, tables: int, bits: int, reach: int = 4):
        words, first = lower_words(column)
        self.ids, self.walks, self.tables, self.bits = ids, walks, tables, bits
        self.words = [words[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        self.edits = [int((1 - similarity) * len(w) + 1e-9) for w in self.words]
        self.flat, self.begins, self.sizes, self.limits = words, first[:-1], np.diff(first), np.array(self.edits, np.int64)
        # items of one length of stretch are embedded together, each followed by words of no text
        self.tables_of: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        by: dict[int, list[int]] = {}
        for i, (w, k) in enumerate(zip(self.words, self.edits, strict=True)):
            if len(w):
                by.setdefault(min(len(w), reach * max(1, len(w) // (k + 1))), []).append(i)
        self.stretches = sorted(by)
        for z, items in by.items():
            flat = np.concatenate([np.append(self.words[i], np.zeros(z, np.uint64)) for i in items])
            item = np.concatenate([np.full(len(self.words[i]), i) for i in items])
            offset = np.concatenate([np.arange(len(self.words[i])) for i in items])
            begin = np.repeat(np.cumsum([0, *(len(self.words[i]) + z for i in items[:-1])]), [len(self.words[i]) for i in items])
            end = begin + np.repeat([len(self.words[i]) for i in items], [len(self.words[i]) for i in items])
            for r in range(walks):
                for _, t, keys, last in lsh_keys(flat, begin + offset, [z], r, tables, bits):
                    good = np.flatnonzero(last < end)
                    good = good[np.argsort(keys[good], kind="stable")]
                    size = np.uint64(64 - max(20, min(25, len(good).bit_length() + 5)))
                    seen = np.zeros(1 << int(64 - size), bool)
                    seen[(keys[good] >> size).astype(np.int64)] = True
                    self.tables_of[z, r, t] = keys[good], item[good], offset[good], np.packbits(seen)

    @classmethod
    def of(cls, fields: dict) -> ItemIndex:
        """An index again from its fields, which are what is broadcast."""
        out = cls.__new__(cls)
        out.__dict__.update(fields)
        return out

    def hits(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Items with the texts and places, maybe beyond the text's ends, where shared keys put their first words."""
        if not len(words) or not self.stretches:
            return
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        padded = np.concatenate([words, np.zeros(self.stretches[-1], np.uint64)])
        seen = {key: np.unpackbits(bits).view(bool) for key, (_, _, _, bits) in self.tables_of.items()}
        found = [np.zeros((3, 0), np.int64)]
        # a piece of the words stays in the processor's cache for all walks
        for lo in range(0, len(words), PIECE):
            starts = np.arange(min(PIECE, len(words) - lo))
            piece = padded[lo : lo + len(starts) + self.stretches[-1]]
            for r in range(self.walks):
                for z, t, keys, _ in lsh_keys(piece, starts, self.stretches, r, self.tables, self.bits):
                    known, item, offset, _ = self.tables_of[z, r, t]
                    may = seen[z, r, t]
                    at = np.flatnonzero(may[(keys >> np.uint64(65 - len(may).bit_length())).view(np.int64)])
                    low, high = np.searchsorted(known, keys[at], "left"), np.searchsorted(known, keys[at], "right")
                    times = high - low
                    hit = np.repeat(low, times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                    at = np.repeat(at, times) + lo
                    found.append(np.stack([item[hit], doc[at], at - offset[hit]]))
        rows = np.concatenate(found, axis=1)
        rows = rows[:, np.lexsort(rows[::-1])]
        rows = rows[:, np.concatenate([[True], (np.diff(rows, axis=1) != 0).any(axis=0)])] if rows.shape[1] else rows
        cuts = np.flatnonzero(np.diff(rows[0])) + 1
        for part in np.split(rows, cuts, axis=1):
            if part.shape[1]:
                yield int(part[0, 0]), part[1], part[2]

    def windows(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Rows (item, start) of the windows, within texts, around the places that shared keys name."""
        found = []
        for i, doc, start in self.hits(words, first):
            k = self.edits[i]
            s = (start[:, None] + np.arange(-k, k + 1)).ravel()
            d = np.repeat(doc, 2 * k + 1)
            good = (s >= first[d]) & (s + len(self.words[i]) <= first[d + 1])
            s = np.unique(s[good])
            found.append(np.stack([np.full(len(s), i), s]))
        rows = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return np.unique(rows, axis=1)

    def matches(self, words: np.ndarray, first: np.ndarray, free_ends: bool = False) -> list[tuple[int, int, int, int]]:
        """(text, item, distance, first word) of the closest window, or run, of each text and item in reach."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for i, text, distance, start in self.runs(words, first) if free_ends else self.sized(words, first):
            close = np.flatnonzero(distance <= self.limits[i])
            for x, t, d, s in zip(np.broadcast_to(i, len(text))[close].tolist(), text[close].tolist(), distance[close].tolist(), start[close].tolist(), strict=True):
                best[t, x] = min(best.get((t, x), (d, s)), (d, s))
        return [(t, i, d, s) for (t, i), (d, s) in sorted(best.items())]

    def sized(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """An item, and texts, distances and first words of candidate windows of its size."""
        rows = self.windows(words, first)
        for i in np.unique(rows[0]).tolist():
            item, starts = self.words[i], rows[1][rows[0] == i]
            for at in range(0, len(starts), 4096):
                s = starts[at : at + 4096]
                window = words[s[:, None] + np.arange(len(item))]
                text = np.searchsorted(first, s, "right") - 1
                yield i, text, edit_distances(np.broadcast_to(item, window.shape), window), s - first[text]

    def runs(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Items, texts, distances and first words of the closest runs around candidate hits."""
        found = [np.zeros((3, 0), np.int64)]
        for i, doc, start in self.hits(words, first):
            # places within k words of each other are verified together
            group = self.edits[i] + 1
            found.append(np.unique(np.stack([np.full(len(doc), i), doc, (start - first[doc]) // group * group]), axis=1))
        rows = np.concatenate(found, axis=1)
        rows = rows[:, np.argsort(-self.sizes[rows[0]], kind="stable")]
        at = 0
        while at < rows.shape[1]:
            n = int(self.sizes[rows[0, at]])
            k = int(self.limits[rows[0, at]])
            width = n + 3 * k
            i, d, s = rows[:, at : at + max(1, (1 << 19) // width)]
            at += len(i)
            own = np.arange(n)
            items = self.flat[np.minimum(self.begins[i][:, None] + own, len(self.flat) - 1)]
            s = s + first[d] - self.limits[i]
            place = s[:, None] + np.arange(width)
            inside = (place >= first[d][:, None]) & (place < first[d + 1][:, None]) & (np.arange(width) < (self.sizes[i] + 3 * self.limits[i])[:, None])
            # beyond a text's ends stands a word of no item
            region = np.where(inside, words[np.clip(place, 0, len(words) - 1)], np.uint64(0))
            distance, begin = closest_runs(items, self.sizes[i], region)
            yield i, d, distance, np.maximum(s + begin - first[d], 0)


def item_blocks(items: DataFrame, block: int, block_bytes: int, item_col: str, text_col: str) -> Iterator[tuple[list, pa.Array]]:
    """Ids and texts of the items, at most `block` at a time and of `block_bytes` bytes, unless one is longer."""
    held: list = []
    size = 0
    for r in items.select(F.col(item_col).cast("long").alias("id"), F.col(text_col).alias("text")).toLocalIterator():
        if held and (len(held) == block or size + len(r.text or "") > block_bytes):
            yield [x.id for x in held], pa.array([x.text for x in held], pa.string())
            held, size = [], 0
        held.append(r)
        size += len(r.text or "")
    yield [x.id for x in held], pa.array([x.text for x in held], pa.string())


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, walks: int = 8, tables: int = 1, bits: int = 7, block: int = 5000, block_bytes: int = 8 << 20, free_ends: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each text and item that it holds: the distance and the first word of the closest window, or run."""
    spark, out = docs.sparkSession, None
    for ids, column in item_blocks(benchmark, block, block_bytes, "item_id", "text"):
        index = spark.sparkContext.broadcast(vars(ItemIndex(ids, column, similarity, walks, tables, bits)))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for b in slices(whole, "text", 1 << 20):
                    x = ItemIndex.of(index.value)
                    found, doc = x.matches(*lower_words(b.column("text")), free_ends), b.column("doc_id").to_pylist()
                    rows = [(doc[t], x.ids[i], d, len(x.words[i]), s) for t, i, d, s in found]
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], [c.split()[0] for c in MATCHES.split(", ")])

        part = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, MATCHES)
        out = part if out is None else out.union(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, walks: int = 8, tables: int = 1, bits: int = 7, block: int = 5000, block_bytes: int = 8 << 20, free_ends: bool = False, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns kept, whose text holds no item."""
    for ids, column in item_blocks(benchmark, block, block_bytes, "item_id", "text"):
        index = docs.sparkSession.sparkContext.broadcast(vars(ItemIndex(ids, column, similarity, walks, tables, bits)))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for b in slices(whole, text_col, 1 << 20):
                    clean = np.ones(b.num_rows, bool)
                    clean[[t for t, *_ in ItemIndex.of(index.value).matches(*lower_words(b.column(text_col)), free_ends)]] = False
                    yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
