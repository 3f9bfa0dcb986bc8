"""Repeated windows of tokens over a whole corpus: what the two exact deduplicators share.

1. Every text is cut into segments (see anchors.py), rows of hashes and places only.
2. Segments whose anchor occurs once repeat nothing. The others are aggregated to distinct segments.
3. A segment that occurs twice repeats with all its windows. If an anchor has several distinct segments, their windows
   are compared token by token: one occurrence of each is fetched from its text, and groups of equal anchors are dealt
   to tasks, which sort them (`compare`). A group of more than `crowd` distinct segments is not gathered: its windows, or blocks of up to `block`
   of them and windows of those blocks that may share some, are counted over all tasks, a 64-bit digest for each.
4. The places of repeated windows are gathered by text and applied to it.

Texts are shuffled once, by id: all joins with them stand in one plan, with the same columns, and read the same exchange. Nothing is collected, and
only the keys of hot segments and windows are broadcast, of which there cannot be many (`join_hot`). Hot anchors are combined before each shuffle, and the joins on them
are ones whose large sides Spark can split.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import segments
from .common import SPACES, digests, flat_bytes, slices, small_batches, word_hashes, word_spans, written

#: place packs where the first window starts, and, in SHAPE_BITS each, how many windows there are and where the anchor is in the first.
SEGMENTS = "id long, place long, anchor long, segment long"
FETCHED = "id long, lo long, windows int, lead int, anchor long, segment long, copies long, tokens binary"
SHAPE_BITS = 12
SHAPE = (1 << SHAPE_BITS) - 1
#: A fetched word keeps this much of its hash: it is compared with words of the same group only.
WORD_BYTES = 6
PLACES = "id long, lo long, hi long"
CHUNK = 1 << 20


@dataclass(frozen=True)
class Kind:
    """What repeats: windows of `length` tokens, anchored by `k` of them; a window starting at the smallest place is kept, or none is."""

    words: bool
    length: int
    k: int
    keep_first: bool
    crowd: int = 2000
    block: int = 1


def token_values(column: pa.Array, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bytes, or 64-bit hashes of words, of all texts and the texts' offsets."""
    data, offsets = flat_bytes(column)
    if not words:
        return data, offsets
    starts, ends, first = word_spans(data, offsets, SPACES)
    return word_hashes(data, starts, ends), first


def all_segments(values: np.ndarray, offsets: np.ndarray, kind: Kind) -> Iterator[tuple[np.ndarray, ...]]:
    """segments() of texts, long ones a chunk at a time: their windows are dealt to chunks, which overlap by a window."""
    if len(values) <= 2 * CHUNK:
        yield segments(values, offsets, kind.length, kind.k)
        return
    for d in range(len(offsets) - 1):
        for at in range(int(offsets[d]), int(offsets[d + 1]), CHUNK):
            part = values[at : min(int(offsets[d + 1]), at + CHUNK + kind.length - 1)]
            found = segments(part, np.array([0, len(part)]), kind.length, kind.k)
            yield (found[0] + d, found[1] + at - int(offsets[d]), *found[2:])


def segment_rows(docs: DataFrame, kind: Kind) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", CHUNK):
                ids = b.column("id").to_numpy(zero_copy_only=False)
                for doc, lo, windows, lead, anchor, segment in all_segments(*token_values(b.column("text"), kind.words), kind):
                    place = (lo << SHAPE_BITS | windows) << SHAPE_BITS | lead
                    columns = [ids[doc], place, anchor.view(np.int64), segment.view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], [x.split()[0] for x in SEGMENTS.split(", ")])

    return docs.select("id", "text").mapInArrow(run, SEGMENTS)


def fetch(joined: DataFrame, kind: Kind) -> DataFrame:
    """A row with its tokens for each segment that a text is asked for in its column `asked`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FETCHED.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for whole in batches:
            for b in slices(whole, "text", CHUNK):
                values, offsets = token_values(b.column("text"), kind.words)
                out: list[tuple] = []
                for i, (x, asked) in enumerate(zip(b.column("id").to_pylist(), b.column("asked").to_pylist(), strict=True)):
                    for a in asked:
                        lo, windows, lead = a["place"] >> 2 * SHAPE_BITS, a["place"] >> SHAPE_BITS & SHAPE, a["place"] & SHAPE
                        tokens = values[int(offsets[i]) + lo :][: windows + kind.length - 1]
                        if kind.words:
                            tokens = tokens.view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES]
                        out.append((x, lo, windows, lead, a["anchor"], a["segment"], a["copies"], tokens.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    # with doc_id, so that the texts that are shuffled have the same columns as those that places are joined to
    return joined.select("id", "doc_id", "text", "asked").mapInArrow(run, FETCHED)


Compare = Callable[["Group"], np.ndarray]


@dataclass
class Group:
    """Fetched segments: their fields, tokens one after another at offsets, and where each window starts there."""

    id: np.ndarray
    lo: np.ndarray
    windows: np.ndarray
    lead: np.ndarray
    anchor: np.ndarray
    copies: np.ndarray
    tokens: np.ndarray
    offsets: np.ndarray

    def starts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segment, window's number in it, window's place in tokens) of every window."""
        seg = np.repeat(np.arange(len(self.windows)), self.windows)
        number = np.arange(len(seg)) - np.repeat(np.cumsum(self.windows) - self.windows, self.windows)
        return seg, number, self.offsets[seg] + number


def group_of(b: pa.RecordBatch, kind: Kind) -> Group:
    data, offsets = flat_bytes(b.column("tokens"))
    size = WORD_BYTES if kind.words else 1
    take = lambda n: b.column(n).to_numpy(zero_copy_only=False)
    tokens = data
    if kind.words:
        tokens = np.zeros((len(data) // WORD_BYTES, 8), np.uint8)
        tokens[:, :WORD_BYTES] = data.reshape(-1, WORD_BYTES)
        tokens = tokens.view(np.uint64).ravel()
    return Group(*(take(n) for n in ("id", "lo", "windows", "lead", "anchor", "copies")), tokens, offsets // size)


def place_rows(group: Group, kind: Kind, repeated: np.ndarray) -> pa.RecordBatch:
    """Places of the windows marked in `repeated`, runs of them joined."""
    seg, number, _ = group.starts()
    at = np.flatnonzero(repeated)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (seg[at[1:]] != seg[at[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1 if len(at) else first
    a, z = at[first], at[last]
    lo = group.lo[seg[a]] + number[a]
    hi = group.lo[seg[a]] + number[z] + kind.length
    return pa.RecordBatch.from_arrays([pa.array(group.id[seg[a]]), pa.array(lo), pa.array(hi)], ["id", "lo", "hi"])


def compared(fetched: DataFrame, kind: Kind, compare: Compare, bucket_bytes: int = 5 << 18) -> DataFrame:
    """Places of repeated windows. Tasks get whole groups of equal anchors, in order, and hand them to `compare` a bucket of groups at a time."""

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.column("tokens").nbytes
            while size > bucket_bytes:
                table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                anchor = table.column("anchor").to_numpy()
                ends = np.append(np.flatnonzero(np.diff(anchor)) + 1, len(anchor))
                sizes = np.cumsum(np.diff(flat_bytes(table.column("tokens"))[1]))
                # whole groups; the last may go on in the next batch
                k = int(np.searchsorted(sizes[ends - 1], bucket_bytes, "right"))
                if len(ends) < 2:
                    break
                cut = int(ends[min(max(k, 1), len(ends) - 1) - 1])
                yield table.slice(0, cut)
                held = [table.slice(cut)]
                size = int(sizes[-1] - sizes[cut - 1])
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in buckets(batches):
            group = group_of(b, kind)
            yield place_rows(group, kind, compare(group))

    return fetched.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, PLACES)


def join_hot(rows: DataFrame, keys: DataFrame, on: list[str], count: str, total: int, most: int = 10_000) -> DataFrame:
    """rows joined to keys, which have how many of the rows each has in `count`, `total` or fewer together. Keys with a `most`th of the total or more, which cannot be over `most` of them, are broadcast, so that a hot key's rows are joined where they are."""
    hot = F.col(count) * most >= total
    first = F.broadcast(keys.filter(hot))
    return rows.join(first, on).unionByName(rows.join(F.broadcast(keys.filter(hot).select(*on)), on, "left_anti").join(keys.filter(~hot), on))


def counted(fetched: DataFrame, kind: Kind, total: int) -> DataFrame:
    """Places of repeated windows of crowded groups, which have `total` windows: a row for each window, equal ones found by aggregation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "tokens", CHUNK):
                group = group_of(b, kind)
                seg, number, at = group.starts()
                window = digests(group.tokens, at, at + kind.length)
                columns = (group.id[seg], group.lo[seg] + number, group.anchor[seg], (group.lead[seg] - number).astype(np.int32), window.view(np.int64), group.copies[seg])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["id", "lo", "anchor", "lead", "window", "copies"])

    rows = fetched.mapInArrow(run, "id long, lo long, anchor long, lead int, window long, copies long")
    same = ["anchor", "lead", "window"]
    # not written: that would take another shuffle of all texts
    many = rows.groupBy(*same).agg(F.sum("copies").alias("total"), F.count(F.lit(1)).alias("rows"), F.min(F.struct("id", "lo")).alias("first")).filter("total > 1")
    hit = join_hot(rows, many, same, "rows", total)
    hit = hit.filter("struct(id, lo) > first" if kind.keep_first else "true")
    return hit.select("id", "lo", (F.col("lo") + kind.length).alias("hi"))


BLOCKS = "id long, lo long, anchor long, block int, lead int, whole long, core long, windows array<long>, copies long"


def block_rows(group: Group, length: int, size: int) -> pa.RecordBatch:
    """Runs of windows of which the anchor is equally far, divided by `size`: digests of each run's tokens, of the tokens that all windows of a full run share, and of each window.

    The shared tokens lie in every window of such a run, so runs that segments' ends cut have them too."""
    seg, number, at = group.starts()
    lead = group.lead[seg] - number
    block = lead // size
    first = np.flatnonzero((np.diff(block, prepend=-1) != 0) | (np.diff(seg, prepend=-1) != 0))
    ends = np.append(first[1:], len(seg))
    own, begin = seg[first], at[first]
    core = begin + lead[first] - block[first] * size
    window = digests(group.tokens, at, at + length)
    whole = digests(group.tokens, begin, begin + ends - first + length - 1)
    shared = digests(group.tokens, core, core + length - size + 1)
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(seg)), pa.int32()), pa.array(window.view(np.int64)))
    columns = [group.id[own], group.lo[own] + number[first], group.anchor[own], block[first].astype(np.int32), lead[first].astype(np.int32), whole.view(np.int64), shared.view(np.int64)]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), lists, pa.array(group.copies[own])], [x.split()[0] for x in BLOCKS.split(", ")])


def counted_in_blocks(fetched: DataFrame, kind: Kind, total: int) -> DataFrame:
    """Places of repeated windows of crowded groups, which have `total` windows, found by aggregation.

    Equal windows have equally distant anchors, and so stand in blocks (see block_rows) of one number that share the block's common tokens. A block that occurs
    twice repeats with all its windows. Of distinct blocks only those that share these tokens with another one are taken apart, to a row for each window."""
    size = max(1, min(kind.block, kind.length // 4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "tokens", CHUNK):
                yield block_rows(group_of(b, kind), kind.length, size)

    # nothing is written here: that would take another shuffle of all texts
    blocks = fetched.mapInArrow(run, BLOCKS)
    later = "struct(id, lo) > struct(first.id, first.lo)" if kind.keep_first else "true"
    key = ["anchor", "block", "lead", "whole", "n"]
    blocks = blocks.withColumn("n", F.size("windows"))
    first = F.min(F.struct("id", "lo", "core", "windows")).alias("first")
    # this filter, which all pass, has all uses read the same columns, and so the same exchange
    distinct = blocks.groupBy(*key).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"), first).filter("copies >= rows and first is not null")
    hit = join_hot(blocks.select("id", "lo", *key), distinct.filter("rows > 1").select(*key, "rows", "first"), key, "rows", total)
    hit = hit.filter(later).select("id", "lo", (F.col("lo") + F.col("n") + kind.length - 1).alias("hi"))

    same = ["anchor", "block", "core"]
    distinct = distinct.select("anchor", "block", F.col("first.core").alias("core"), "lead", "copies", "first")
    shared = distinct.groupBy(*same).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    opened = join_hot(distinct, shared, same, "rows", total).select("first.id", "first.lo", "anchor", "lead", "copies", F.posexplode("first.windows").alias("number", "window"))
    opened = opened.select("id", (F.col("lo") + F.col("number")).alias("lo"), "anchor", (F.col("lead") - F.col("number")).alias("lead"), "window", "copies")
    same = ["anchor", "lead", "window"]
    many = opened.groupBy(*same).agg(F.sum("copies").alias("total"), F.count(F.lit(1)).alias("rows"), F.min(F.struct("id", "lo")).alias("first")).filter("total > 1")
    hit_windows = join_hot(opened, many, same, "rows", total).filter(later)
    return hit.union(hit_windows.select("id", "lo", (F.col("lo") + kind.length).alias("hi")))


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, doc_id and text. id is doc_id where that is unique and never null; else a new number in the order of doc_id, nulls last, so that every row is a document of its own."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if rows.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1).count():
        last = F.col("doc_id").asc_nulls_last()
        rows = written(rows.repartitionByRange(last).sortWithinPartitions(last).withColumn("id", F.monotonically_increasing_id()), "identified")
        return rows.select("id", "doc_id", "text")
    return rows.select(F.col("doc_id").alias("id"), "doc_id", "text")


def repeated_places(docs: DataFrame, kind: Kind, compare: Compare) -> DataFrame:
    """docs (id, doc_id, text) with `places`, a list of the (lo, hi) that windows to remove cover, in tokens, or null."""
    small_batches(docs.sparkSession)
    if kind.length > SHAPE:
        raise ValueError(f"windows of at most {SHAPE} tokens")
    found = segment_rows(docs, kind)
    # written, so that the join's sides are shuffles that Spark can split where an anchor is hot
    again = written(found.groupBy("anchor").count().filter("count > 1").select(F.col("anchor").alias("again")), "again")
    live = written(found.join(again, F.col("anchor") == F.col("again"), "left_semi"), "segments")
    key = ["anchor", "segment"]
    distinct = written(live.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("id", "place")).alias("at")), "distinct")

    copied = distinct.filter("copies > 1").select(*key, "copies", F.col("at.id").alias("first_id"), F.col("at.place").alias("first_place"))
    whole = join_hot(live, copied, key, "copies", copied.agg(F.sum("copies")).first()[0] or 0)
    if kind.keep_first:
        whole = whole.filter("id != first_id or place != first_place")
    lo, windows = F.shiftright("place", 2 * SHAPE_BITS), F.shiftright("place", SHAPE_BITS).bitwiseAND(F.lit(SHAPE))
    whole = whole.select("id", lo.alias("lo"), (lo + windows + kind.length - 1).alias("hi"))

    # written, as `again` is
    in_group = F.shiftright("at.place", SHAPE_BITS).bitwiseAND(F.lit(SHAPE))
    groups = written(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("size"), F.sum(in_group).alias("windows")).filter("size > 1").select(F.col("anchor").alias("mixed"), (F.col("size") > kind.crowd).alias("crowded"), "windows"), "mixed")
    chosen = distinct.join(groups, F.col("anchor") == F.col("mixed")).select("at.*", *key, "copies", "crowded")
    # never null, and said so: else an inner join's texts are filtered, and not the same exchange as an outer join's
    texts = docs.select(F.coalesce("id", F.lit(0)).alias("id"), "doc_id", "text")

    def fetched(crowded: bool) -> DataFrame:
        asked = chosen.filter(F.col("crowded") if crowded else ~F.col("crowded")).groupBy(F.col("id").alias("asked_id")).agg(F.collect_list(F.struct("place", *key, "copies")).alias("asked"))
        return fetch(texts.join(asked, F.col("id") == F.col("asked_id")), kind)

    places = whole.union(compared(fetched(False), kind, compare))
    if total := groups.filter("crowded").agg(F.sum("windows")).first()[0]:
        places = places.union((counted_in_blocks if kind.block > 1 else counted)(fetched(True), kind, total))
    places = places.groupBy(F.col("id").alias("place_id")).agg(F.collect_list(F.struct("lo", "hi")).alias("places"))
    return texts.join(places, F.col("id") == F.col("place_id"), "left").select("id", "doc_id", "text", "places")


def covered(n: int, places: list[dict] | None) -> np.ndarray:
    """Which of n tokens the places cover."""
    depth = np.zeros(n + 1, np.int32)
    if places:
        np.add.at(depth, [p["lo"] for p in places], 1)
        np.add.at(depth, [p["hi"] for p in places], -1)
    return np.cumsum(depth[:n]) > 0
