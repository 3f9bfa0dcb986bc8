"""Size-aware Jaccard join of word n-gram sets: subsets for light sets, inverted lists for heavy ones.

Two sets link if 100 * intersection >= percent * union. Equal sets are one set from the start.

Light sets list all their subsets of the sizes that an intersection with a similar set can have. Sets that share a
subset of size o link if their sizes sum to at most o + 100 * o / percent, so in a group with an equal subset all that
link at all link to the smallest: one aggregation gives all links.

Heavy sets: in a common order of n-grams, rare ones first, similar sets share one of their first
n - ceil(percent * n / 100) + 1 n-grams; those prefixes are the inverted lists, and lists of one set fall away at once. Lists are scanned
with parity bitmaps: the bits in which two bitmaps differ are at most the n-grams in which the sets differ, so pairs beyond
the limit are out, and none is lost. What is left is joined to coarse groups. Large ones, in which long texts meet that the lists' bitmaps are too
narrow for, are parted by bitmaps of as many bits as a set has n-grams. Then the groups' sets are fetched and compared exactly.

Lists and groups of more than `block` members, or of more n-grams than fit, are compared in rounds (`star_links`), so that no set
is copied to all pairs of blocks: first within each block, then the clusters' smallest members, and then, only where a
list or group is still in several clusters, every member outside the largest one with all others. Members that are connected are never
compared, so a group of near copies, however large, costs about one comparison a member.

The boundary is the size up to which subsets cost less (`boundary`); sets near it take both ways. How often n-grams
occur is counted over all documents in a table of fixed size, which only decides the order, never a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.functions.names import unused

from .common import SPACES, flat_bytes, gram_hashes, mix, seeded, slices, small_batches, word_hashes, word_spans, written
from .components import components, labels
from .repeats import identified

BITS = 1024
CELLS = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SALT = seeded("set", 2)


def most_missing(n: int, percent: int) -> int:
    """How many of its n n-grams a set can have that a similar one lacks."""
    return n - -(-percent * n // 100)


def boundary(percent: int, entry_cost: float = 12, most: int = 40) -> int:
    """The largest size up to which a set's subsets, a row each, are fewer than its prefix n-grams times what an entry of an inverted list costs, scanned and checked, in rows."""
    size = 0
    while size < most:
        k = most_missing(size + 1, percent)
        if sum(comb(size + 1, i) for i in range(k + 1)) > (k + 1) * entry_cost:
            break
        size += 1
    return size


def ngram_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct n-grams of words, sorted, one text after another, and the texts' offsets."""
    data, offsets = flat_bytes(column)
    data = _LOWER[data]
    starts, ends, first = word_spans(data, offsets, SPACES)
    words = word_hashes(data, starts, ends)
    counts = np.diff(first)
    grams = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(counts)), grams)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(grams) - grams, grams) + first[doc]
    found = np.zeros(len(doc), np.uint64)
    size = np.minimum(n, counts)[doc]
    # a text of fewer words is one shorter n-gram
    for k in np.unique(size).tolist():
        own = size == k
        found[own] = gram_hashes(words, k)[at[own]]
    order = np.lexsort((found, doc))
    found, doc = found[order], doc[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
    return found[keep], np.concatenate([[0], np.cumsum(np.bincount(doc[keep], minlength=len(counts)))])


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def bitmaps(grams: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of BITS / 8 bytes: the parity of how many n-grams fall on each bit."""
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    bit = (mix(grams ^ _SALT[0]) >> np.uint64(40)).astype(np.int64) % BITS
    parity = np.bincount(doc * BITS + bit, minlength=n * BITS).astype(np.uint8) & 1
    return np.packbits(parity.reshape(n, BITS), axis=1)


def summaries(docs: DataFrame, n: int, most: int) -> DataFrame:
    """A row for each document: its set's size, digests and bitmap, and the set itself if it has at most `most` n-grams; and, with null ids, each task's part of the table of counts."""
    schema = "id long, size long, d1 long, d2 long, bitmap binary, grams binary, cell int, counts binary"
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int32)
        row = lambda *x: pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(x, kinds, strict=True)], [s.split()[0] for s in schema.split(", ")])
        for whole in batches:
            for b in slices(whole, "text", 1 << 20):
                grams, offsets = ngram_sets(b.column("text"), n)
                counts += np.bincount((grams & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS).astype(np.int32)
                sizes = np.diff(offsets)
                d1, d2 = (mix(sums(mix(grams ^ s), offsets) + sizes.astype(np.uint64)).view(np.int64) for s in _SALT)
                maps = [x.tobytes() for x in bitmaps(grams, offsets)]
                none = [None] * b.num_rows
                few = [grams[x:y].tobytes() if 0 < y - x <= most else None for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield row(b.column("id"), sizes, d1, d2, maps, few, none, none)
        part = 1 << 16
        k = CELLS // part
        if counts.any():
            yield row(*[[None] * k] * 6, list(range(k)), [counts[i * part : (i + 1) * part].tobytes() for i in range(k)])

    return docs.select("id", "text").mapInArrow(run, schema)


def rarity(rows: DataFrame) -> np.ndarray:
    """A class of 0 to 255 for each cell, about logarithmic in how many documents' n-grams fall on it."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for cell, raw in zip(b.column("cell").to_pylist(), b.column("counts").to_pylist(), strict=True):
                x = np.frombuffer(raw, np.int64 if len(raw) == 8 << 16 else np.int32)
                total[cell] = total.get(cell, 0) + x.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["cell", "counts"])

    schema = "cell int, counts binary"
    parts = rows.filter("cell is not null").select("cell", "counts").mapInArrow(add, schema)
    found = parts.repartition(16, "cell").mapInArrow(add, schema).collect()  # 16 rows of fixed size
    table = np.zeros(CELLS, np.int64)
    for r in found:
        table[r.cell << 16 : (r.cell + 1) << 16] = np.frombuffer(r.counts, np.int64)
    return np.minimum(255, 8 * np.log2(table + 1)).astype(np.uint8)


def prefixes(docs: DataFrame, n: int, percent: int, least: int, classes) -> DataFrame:
    """(token, d1, size) for each n-gram in the prefix of each set of at least `least` n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = classes.value
        for whole in batches:
            for b in slices(whole, "text", 1 << 20):
                grams, offsets = ngram_sets(b.column("text"), n)
                sizes = np.diff(offsets)
                d1 = mix(sums(mix(grams ^ _SALT[0]), offsets) + sizes.astype(np.uint64)).view(np.int64)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                order = np.lexsort((grams, table[(grams & np.uint64(CELLS - 1)).astype(np.int64)], doc))
                place = np.arange(len(doc)) - offsets[doc]
                length = np.where(sizes >= least, sizes - -(-percent * sizes // 100) + 1, 0)
                take = place < length[doc]
                yield pa.RecordBatch.from_arrays([pa.array(grams[order[take]].view(np.int64)), pa.array(d1[doc[take]])], ["token", "d1"])

    return docs.select("id", "text").mapInArrow(run, "token long, d1 long")


def subsets(sets: DataFrame, percent: int) -> DataFrame:
    """(subset, common, size, rep) for each subset, of each size that an intersection can have, of the sets (rep, grams)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[np.ndarray] = []
            for rep, raw in zip(b.column("rep").to_pylist(), b.column("grams").to_pylist(), strict=True):
                own = mix(np.frombuffer(raw, np.uint64) ^ _SALT[1])
                size, total = len(own), own.sum(dtype=np.uint64)
                for k in range(most_missing(size, percent) + 1):
                    gone = own[np.array(list(combinations(range(size), k)), np.int64).reshape(-1, k)].sum(axis=1, dtype=np.uint64) if k else np.zeros(1, np.uint64)
                    m = len(gone)
                    out.append(np.stack([mix(total - gone).view(np.int64), np.full(m, size - k), np.full(m, size), np.full(m, rep)]))
            cells = np.concatenate(out, axis=1) if out else np.zeros((4, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], ["subset", "common", "size", "rep"])

    return sets.select("rep", "grams").mapInArrow(run, "subset long, common long, size long, rep long")


def star_links(rows: DataFrame, totals: DataFrame, grp: str, parts: str, compare, name: str) -> DataFrame:
    """Links that join what `compare` finds similar among the rows (grp, rep, ...) of each group, whole.

    `parts`: SQL for the number of blocks that a group is dealt to, of its sizes, which `totals` has too, a row for each group. compare(df) links the rows of each (grp, pair), those with
    unequal `cluster` alone, stars of each connected part. Of groups in several blocks the second round joins the clusters'
    smallest members; the third copies the members outside each group's largest cluster to all of its blocks, if any are left."""
    n = F.greatest(F.lit(1), F.ceil(F.expr(parts)).cast("int"))
    rows = rows.withColumn("blocks", n)
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    links = written(compare(rows.withColumn("pair", own).withColumn("cluster", F.col("rep"))), f"{name}-1")
    if not totals.filter(f"{parts} > 1").limit(1).count():
        return links
    split = rows.filter("blocks > 1")

    def clustered(links: DataFrame, step: int) -> DataFrame:
        found = components(links, f"{name}-clusters-{step}")
        return split.join(found, F.col("rep") == F.col("node"), "left").withColumn("cluster", F.coalesce("component", "rep")).drop("node", "component")

    now = clustered(links, 1)
    # one row stands for each cluster in its group
    roots = now.groupBy(grp, "cluster").agg(F.min("rep").alias("root")).select(F.col(grp).alias("of_grp"), "root")
    roots = now.join(roots, (F.col(grp) == F.col("of_grp")) & (F.col("rep") == F.col("root"))).drop("of_grp", "root")
    many = roots.groupBy(F.col(grp).alias("of_grp")).agg(F.count(F.lit(1)).alias("roots"))
    roots = roots.join(many.filter("roots > 1"), F.col(grp) == F.col("of_grp"))
    dealt = F.ceil(F.col("blocks") * F.col("roots") / F.col("members")).cast("int")
    roots = roots.withColumn("pair", F.pmod(F.xxhash64("rep"), F.greatest(F.lit(1), dealt)).cast("int")).drop("of_grp", "roots")
    links = links.union(written(compare(roots), f"{name}-2"))

    now = clustered(links, 2)
    sizes = now.groupBy(F.col(grp).alias("of_grp"), F.col("cluster").alias("of_cluster")).agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("of_grp").agg(F.max_by("of_cluster", F.struct("n", "of_cluster")).alias("largest"), F.count(F.lit(1)).alias("clusters")).filter("clusters > 1")
    rest = now.join(largest, F.col(grp) == F.col("of_grp"))
    everywhere = F.sequence(F.lit(0), F.col("blocks") - 1)
    rest = rest.withColumn("pair", F.explode(F.when(F.col("cluster") == F.col("largest"), F.array(own)).otherwise(everywhere)))
    return links.union(written(compare(rest.drop("of_grp", "largest", "clusters")), f"{name}-3"))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], rows: int = 1 << 15) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of a sorted partition in batches that hold whole groups, each row with its group's number."""
    held: list[pa.RecordBatch] = []

    def numbers(b: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(b.num_rows, bool)
        for k in keys:
            x = b.column(k).to_numpy(zero_copy_only=False)
            new[1:] |= x[1:] != x[:-1]
        return np.cumsum(new)

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) < rows:
            continue
        b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        group = numbers(b)
        cut = int(np.searchsorted(group, group[-1]))
        if cut:
            yield b.slice(0, cut), group[:cut]
        held = [b.slice(cut)]
    if held and sum(x.num_rows for x in held):
        b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        yield b, numbers(b)


def scan_lists(entries: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between sets of one list that their sizes and bitmaps allow, a star for each connected part of a list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, group in whole_groups(batches, ("token", "pair")):
            rep, size, cluster = (b.column(c).to_numpy() for c in ("rep", "size", "cluster"))
            maps = np.frombuffer(flat_bytes(b.column("bitmap"))[0].tobytes(), np.uint64).reshape(-1, BITS // 64)
            nodes, place = np.unique(cluster, return_inverse=True)
            low, lag, at = np.arange(len(nodes)), 1, np.arange(len(rep))
            waiting: list[np.ndarray] = []
            while len(at := at[at + lag < len(rep)]):
                at = at[group[at] == group[at + lag]]
                x, y = size[at], size[at + lag]
                near = at[(100 * np.minimum(x, y) >= percent * np.maximum(x, y)) & (low[place[at]] != low[place[at + lag]])]
                x, y = size[near], size[near + lag]
                near = near[may_link(np.bitwise_count(maps[near] ^ maps[near + lag]).sum(axis=1, dtype=np.int64), x + y, percent)]
                waiting.append(np.stack([place[near], place[near + lag]]))
                lag += 1
                # pairs that are connected already need not be looked at
                if sum(w.shape[1] for w in waiting) > 1 << 12:
                    low = labels(len(nodes), *low[np.concatenate(waiting, axis=1)])[low]
                    waiting = []
            if waiting:
                low = labels(len(nodes), *low[np.concatenate(waiting, axis=1)])[low]
            out = np.flatnonzero(low != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[out]), pa.array(nodes[low[out]])], ["a", "b"])

    return entries.select("token", "pair", "rep", "size", "cluster", "bitmap").repartition("token", "pair").sortWithinPartitions("token", "pair", "size").mapInArrow(run, "a long, b long")


def may_link(apart: np.ndarray, both: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of `both` n-grams together can link whose parity bitmaps differ in `apart` bits: the union is at most 100 / (100 + percent) of them, and what differs (100 - percent) hundredths of it."""
    return apart * (100 + percent) <= (100 - percent) * both


def wide_map(grams: np.ndarray) -> np.ndarray:
    """A parity bitmap of at least as many bits as there are n-grams, a power of two; half of one is its halves' difference."""
    bits = 1 << max(10, len(grams).bit_length())
    bit = (mix(grams ^ _SALT[0]) >> np.uint64(20)).astype(np.int64) & (bits - 1)
    return np.packbits(np.bincount(bit, minlength=bits).astype(np.uint8) & 1).view(np.uint64)


def folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    while len(bitmap) > words:
        bitmap = bitmap[: len(bitmap) // 2] ^ bitmap[len(bitmap) // 2 :]
    return bitmap


def group_links(cluster: list[int], size: list[int], maps: list[np.ndarray], percent: int, similar=None, chunk: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """(cluster, smallest cluster that it joins) for the clusters of a group that links join: pairs whose wide bitmaps allow it and that are similar(i, j), if that is given.

    Members that are connected already are not compared."""
    names, low = np.unique(np.array(cluster, np.int64), return_inverse=True)
    if len(names) < 2:
        return
    order = np.argsort(size, kind="stable")
    size, maps, low = np.array(size)[order], [maps[i] for i in order], low[order]
    own = low.copy()
    words = np.array([len(m) for m in maps])
    for level in np.unique(words).tolist():
        # sets are in the order of size, so what may link to these is at this level or beyond, and not much larger
        first, last = np.searchsorted(words, level, "left"), np.searchsorted(words, level, "right")
        end = int(np.searchsorted(size, size[last - 1] * 100 // percent, "right"))
        flat = np.stack([folded(m, level) for m in maps[first:end]])
        for i in range(first, last):
            later = np.flatnonzero(low[i + 1 : end] != low[i]) + i + 1
            later = later[percent * size[later] <= 100 * size[i]]
            rows = max(1, chunk // (8 * level))
            for at in range(0, len(later), rows):
                js = later[at : at + rows]
                apart = np.bitwise_count(flat[js - first] ^ flat[i - first]).sum(axis=1, dtype=np.int64)
                js = js[may_link(apart, size[js] + size[i], percent)]
                if similar is None:
                    both = np.unique(np.append(low[js], low[i]))
                    low[np.isin(low, both)] = both[0]
                    continue
                for j in js:
                    if low[i] != low[j] and similar(order[i], order[j]):
                        a, z = sorted((low[i], low[j]))
                        low[low == z] = a
    joined = np.unique(np.stack([own, low]), axis=1)
    yield from ((int(names[a]), int(names[b])) for a, b in joined.T if a != b)


def similar_sets(sets: list[np.ndarray], percent: int):
    """Whether the sorted sets i and j link."""

    def similar(i: int, j: int) -> bool:
        x, y = (sets[i], sets[j]) if len(sets[i]) <= len(sets[j]) else (sets[j], sets[i])
        both = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))
        return 100 * both >= percent * (len(x) + len(y) - both)

    return similar


def member_links(members: DataFrame, percent: int, exact: bool) -> DataFrame:
    """Links (a, b) between clusters of the members (grp, pair, cluster, size, payload) of a group, a star for each connected part. Payloads are sets, if exact, or their wide bitmaps."""

    def links(cluster: list, size: list, payload: list) -> list[tuple[int, int]]:
        if not exact:
            return list(group_links(cluster, size, payload, percent))
        return list(group_links(cluster, size, [wide_map(x) for x in payload], percent, similar_sets(payload, percent)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        held: tuple[list, list, list] = ([], [], [])
        now = None
        for b in batches:
            columns = (b.column(c).to_pylist() for c in ("grp", "pair", "cluster", "size"))
            for grp, pair, c, n, raw in zip(*columns, b.column("payload"), strict=True):
                if (grp, pair) != now:
                    out += links(*held)
                    now, held = (grp, pair), ([], [], [])
                for to, value in zip(held, (c, n, np.frombuffer(raw.as_py(), np.uint64)), strict=True):
                    to.append(value)
        out += links(*held)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    return members.select("grp", "pair", "cluster", "size", "payload").repartition("grp", "pair").sortWithinPartitions("grp", "pair").mapInArrow(run, "a long, b long")


def with_sets(rows: DataFrame, n: int, whole: bool) -> DataFrame:
    """rows (text, and others) with `size` and `payload`, the hashes of the text's set or its wide bitmap, for the text."""
    rest = [f for f in rows.schema.fields if f.name != "text"]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rest), "size long, payload binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", 1 << 20):
                grams, offsets = ngram_sets(b.column("text"), n)
                sets = [grams[x:y] for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
                payload = [(x if whole else wide_map(x)).tobytes() for x in sets]
                names = [f.name for f in rest]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(np.diff(offsets)), pa.array(payload, pa.binary())], [*names, "size", "payload"])

    return rows.mapInArrow(run, schema)


#: Rows of four numbers that are broadcast at most.
BROADCAST_ROWS = 100_000
#: n-grams of one block of a group: what a task holds at once, 8 bytes each.
BLOCK_GRAMS = 4 << 20


def jaccard_groups(docs: DataFrame, n: int = 5, percent: int = 80, block: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles (its set's size) and component_id (the smallest doc_id that links reach) of each row.

    Defined results: null, empty and blank texts have no set and link with nothing; a text of fewer than n words is one n-gram;
    rows with equal or null ids are documents of their own; other columns are not carried."""
    texts = identified(docs, id_col, text_col)
    ids = texts.select("id", "doc_id")
    named = group_rows(texts, n, percent, block).join(ids.select(F.col("id").alias("top"), F.col("doc_id").alias("component_id")), "top")
    return named.join(ids, "id").select("doc_id", "n_shingles", "component_id")


def keep_one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, block: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns kept, without those that similar sets link to a row with a smaller id.

    Of rows with equal ids, or without one, each is a document of its own; all rows without words stay."""
    row, gone = unused(docs.columns, "row", "gone")
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if plain.groupBy("id").count().filter("count > 1 or id is null").limit(1).count():
        # numbers in the order of ids tell such rows apart
        last = F.col(id_col).asc_nulls_last()
        docs = written(docs.repartitionByRange(last).sortWithinPartitions(last).withColumn(row, F.monotonically_increasing_id()), "identified")
        plain = docs.select(F.col(row).alias("id"), F.col(text_col).alias("text"))
    else:
        docs = docs.withColumn(row, F.col(id_col).cast("long"))
    rows = group_rows(plain, n, percent, block)
    return docs.join(rows.filter("top < id").select(F.col("id").alias(gone)), F.col(row) == F.col(gone), "left_anti").drop(row)


def group_rows(texts: DataFrame, n: int, percent: int, block: int) -> DataFrame:
    """id, n_shingles and top (the smallest id that links reach) of texts (id, text) with unique ids."""
    spark = small_batches(texts.sparkSession)
    light = boundary(percent)
    # sets of up to the largest size similar to a light one take the light way, sets of the smallest similar size or more the heavy one
    most, least = 100 * light // percent, -(-percent * (light + 1) // 100)
    rows = written(summaries(texts, n, most), "summaries")
    classes = spark.sparkContext.broadcast(rarity(rows))
    sets = rows.filter("id is not null").drop("cell", "counts")
    reps = written(sets.filter("size > 0").groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.first("size").alias("size"), F.first("bitmap").alias("bitmap"), F.first("grams").alias("grams")), "sets")

    parts = written(subsets(reps.filter("grams is not null"), percent), "subsets")
    smallest = parts.groupBy("subset", "common").agg(F.min(F.struct("size", "rep")).alias("low"), F.max("rep").alias("high"), F.min("rep").alias("one")).filter("high != one").drop("high", "one")
    linked = parts.join(smallest, ["subset", "common"]).filter(f"rep != low.rep and {percent} * (size + low.size - common) <= 100 * common").select(F.col("rep").alias("a"), F.col("low.rep").alias("b"))
    linked = written(linked, "light")

    entries = written(prefixes(texts, n, percent, least, classes), "prefixes")
    shared = written(entries.groupBy("token").agg(F.min("d1").alias("x"), F.max("d1").alias("y")).filter("x != y").select(F.col("token").alias("live")), "tokens")
    live = written(entries.join(shared, F.col("token") == F.col("live"), "left_semi").distinct(), "entries")
    counts = live.groupBy(F.col("token").alias("counted")).agg(F.count(F.lit(1)).alias("members"))
    lists = live.join(reps.drop("grams"), "d1").join(counts, F.col("token") == F.col("counted")).select("token", "rep", "size", "bitmap", "members")
    near = components(star_links(lists, counts, "token", f"members / {block << 3}", lambda df: scan_lists(df, percent), "lists"), "near")

    def grouped(found: DataFrame, name: str) -> DataFrame:
        """(rep, grp, members, total) of each node; the last two are of its group."""
        sized = found.join(reps.select("rep", "size"), F.col("node") == F.col("rep")).drop("rep")
        counts = sized.groupBy(F.col("component").alias("counted")).agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("total"))
        return written(sized.join(counts, F.col("component") == F.col("counted")).select(F.col("node").alias("rep"), F.col("component").alias("grp"), "members", "total"), name)

    def compared(df: DataFrame, exact: bool) -> DataFrame:
        wanted = written(df.select("rep", "grp", "pair", "cluster"), "wanted")
        if wanted.count() <= BROADCAST_ROWS:  # few numbers: the texts need no shuffle
            wanted = F.broadcast(wanted)
        members = texts.select("id", "text").join(wanted, F.col("id") == F.col("rep")).select("grp", "cluster", "pair", "text")
        return member_links(with_sets(members, n, exact), percent, exact)

    groups = grouped(near, "groups")
    parts = f"greatest(members / {block}, total / {BLOCK_GRAMS})"
    large = groups.filter(f"{parts} > 1")
    if large.limit(1).count():
        # bitmaps as wide as the sets are large, a sixty-fourth of them, part such groups before any set is copied
        fine = star_links(large, large, "grp", f"greatest(members / {block << 3}, total / {BLOCK_GRAMS << 4})", lambda df: compared(df, False), "maps")
        groups = groups.filter(f"NOT {parts} > 1").unionByName(grouped(components(fine, "fine"), "parted"))
    links = star_links(groups, groups, "grp", parts, lambda df: compared(df, True), "groups")
    found = components(links.union(linked), "linked")

    return sets.join(reps.select("d1", "d2", "rep"), ["d1", "d2"], "left").join(found, F.col("rep") == F.col("node"), "left").select("id", F.col("size").alias("n_shingles"), F.coalesce("component", "rep", "id").alias("top"))
