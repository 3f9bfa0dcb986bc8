"""Jaccard join, suffix and substring deduplication against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from rowmill.llm import anchors, common, components, jaccard_join, registry, repeats, substring_dedup, suffix_dedup


def frame(spark, rows):
    """documents with clashing extra columns."""
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, segment string, id int").repartition(3)


def words(text):
    return (text or "").encode().split()


# anchors


def test_equal_windows_have_equal_anchors():
    rnd = random.Random(1)
    part = bytes(rnd.choice(b"abcd ") for _ in range(300))
    docs = [bytes(rnd.choice(b"abcd ") for _ in range(rnd.randrange(200))) + part + bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(200))) for _ in range(6)]
    values, offsets = common.flat_bytes(pa.array([d.decode() for d in docs]))
    seen = {}
    covered = collections.Counter()
    for d, lo, n, lead, anchor, _ in zip(*anchors.segments(values, offsets, 100, 8), strict=True):
        covered[int(d)] += int(n)
        for w in range(n):
            window = docs[d][lo + w : lo + w + 100]
            assert len(window) == 100
            assert seen.setdefault(window, (anchor, lead - w)) == (anchor, lead - w)
    assert all(covered[i] == max(0, len(d) - 99) for i, d in enumerate(docs))


def test_long_texts_are_cut_into_chunks(monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 64)
    rnd = np.random.default_rng(0)
    values, offsets = rnd.integers(0, 3, 1000).astype(np.uint8), np.array([0, 10, 700, 1000])
    kind = repeats.Kind(words=False, length=20, k=5, keep_first=False)
    starts = sorted((int(d), int(lo) + w) for found in repeats.all_segments(values, offsets, kind) for d, lo, n in zip(*found[:3], strict=True) for w in range(n))
    assert starts == [(d, s) for d in range(3) for s in range(offsets[d + 1] - offsets[d] - 19)]


# suffix deduplication


def brute_bytes(rows, length):
    starts = collections.Counter(t[p : p + length] for t in rows for p in range(len(t) - length + 1))
    out = []
    for t in rows:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if starts[t[p : p + length]] > 1:
                gone[p : p + length] = True
        out.append(gone)
    return out


def corpus(rnd, n, alphabet="abé \n"):
    parts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(10, 120))) for _ in range(8)]
    out = []
    for _ in range(n):
        t = "".join(rnd.choice(parts) if rnd.random() < 0.5 else "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(40))) for _ in range(rnd.randrange(7)))
        out.append(t)
    return [*out, "", None, "a" * 300, "same " * 60, out[0], out[0], "ab" * 200]


@pytest.mark.parametrize("length,crowd", [(40, 2000), (40, 2), (7, 2000), (64, 2000)])
def test_suffix_dedup(spark, monkeypatch, length, crowd):
    kind = repeats.Kind
    monkeypatch.setattr(suffix_dedup, "Kind", lambda **k: kind(**k, crowd=crowd))
    rows = list(enumerate(corpus(random.Random(length), 40)))
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(frame(spark, rows), length).collect()}
    raw = [(t or "").encode() for _, t in rows]
    for (i, _), t, gone in zip(rows, raw, brute_bytes(raw, length), strict=True):
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(t), gone.sum(), spans, hashlib.sha256(kept).hexdigest())


def test_suffix_query_removes_400_bytes_but_not_399(spark, tmp_path):
    """Both passages have 57 words; one more byte that repeats decides."""
    short, long = ("".join(f"{c}{i:05d} " for i in range(57)) for c in "st")
    rows = list(enumerate([f"a{short}b", f"c{short}d", f"e{long}fg", f"h{long}fi", "k " * 150]))
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in registry.queries()["op7_suffix_dedup"](spark, str(tmp_path)).collect()}
    assert got == {0: (0, 0), 1: (0, 0), 2: (400, 1), 3: (400, 1), 4: (0, 0)}


def test_suffix_ranks_are_lexicographic():
    rnd = np.random.default_rng(3)
    data = np.concatenate([rnd.integers(97, 99, 700), np.zeros(400, int)]).astype(np.uint8)
    starts = np.arange(0, 600)
    same = suffix_dedup.equal_windows(data, starts, 60)
    raw = data.tobytes()
    for r in range(suffix_dedup.V):
        own = [s for s in starts if s % suffix_dedup.V == r]
        for a in own:
            for b in own:
                assert (same[a] == same[b]) == (raw[a : a + 60] == raw[b : b + 60])
    order, rank = suffix_dedup.ranks(np.array([3, 1, 3, 2]), np.array([1, 9, 0, 5]))
    assert order.tolist() == [1, 3, 2, 0] and rank.tolist() == [4, 1, 3, 2]
    big = np.arange(5)[::-1] + (1 << 50)
    assert suffix_dedup.ranks(big, np.arange(5))[0].tolist() == [4, 3, 2, 1, 0]


def test_difference_cover():
    cover = set(suffix_dedup.COVER.tolist())
    assert all(any((c + d) % suffix_dedup.V in cover for c in cover) for d in range(suffix_dedup.V))


# substring deduplication


def brute_words(rows, length):
    seen, out = set(), {}
    for n, (i, t) in sorted(enumerate(rows), key=lambda x: (x[1][0] is None, x[1][0] or 0, x[0])):
        w = words(t)
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - length + 1):
            k = tuple(w[p : p + length])
            if k in seen:
                gone[p : p + length] = True
            seen.add(k)
        out[n] = (i, len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return [out[n] for n in range(len(rows))]


@pytest.mark.parametrize("length,crowd", [(6, 2000), (6, 2), (3, 2000), (20, 2000)])
def test_substring_dedup(spark, monkeypatch, length, crowd):
    kind = repeats.Kind
    monkeypatch.setattr(substring_dedup, "Kind", lambda **k: kind(**k, crowd=crowd))
    rnd = random.Random(length)
    rows = [(i, None if t is None else " ".join(t)) for i, t in enumerate(corpus(rnd, 60, "abcdef"))]
    rows += [(900, "a\x1cb\xa0c " * 30), (901, "\x0b\x0ca b\t" * 30)]
    got = {r.doc_id: tuple(r) for r in substring_dedup.substring_dedup(frame(spark, rows), length).collect()}
    want = brute_words(rows, length)
    assert got == {r[0]: r for r in want}


def test_dedup_of_repeated_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text), (1, text), (None, text), (0, "short")]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_removed) for r in substring_dedup.substring_dedup(frame(spark, rows), 20).collect())
    assert got == [(-1, 50), (0, 0), (1, 0), (1, 50)]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_removed) for r in suffix_dedup.suffix_dedup(frame(spark, rows), 100).collect())
    assert got == [(-1, len(text)), (0, 0), (1, len(text)), (1, len(text))]


@pytest.mark.parametrize("op,length,given", [("suffix_dedup", 40, True), ("substring_dedup", 6, True), ("substring_dedup", 6, False)])
def test_texts_are_shuffled_once(spark, monkeypatch, op, length, given):
    kind, names, written = repeats.Kind, [], repeats.written
    module = {"suffix_dedup": suffix_dedup, "substring_dedup": substring_dedup}[op]
    monkeypatch.setattr(module, "Kind", lambda **k: kind(**k, crowd=2))
    monkeypatch.setattr(repeats, "written", lambda df, name: names.append(name) or written(df, name))
    rows = [(i, t and " ".join(t)) for i, t in enumerate(corpus(random.Random(5), 60, "abcdef"))]
    rows += [] if given else [(None, "a b c"), (1, "d e f")]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = getattr(module, op)(frame(spark, rows), length)
        assert sum(r.n_removed for r in found.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plan = str(found._jdf.queryExecution().executedPlan()).split("Initial Plan")[0]
    # both kinds of groups are there, no table is written of what fetched texts give, and later joins read the first's exchange
    assert set(names) <= {"identified", "again", "segments", "distinct", "mixed"}
    assert len(re.findall(r"coalesce\(text#\d+, \) AS text#|FileScan parquet \[doc_id#\w+,text#\w+,id#", plan)) == 1, plan
    assert len(re.findall(r"ReusedExchange \[id#\w+, doc_id#\w+, text#", plan)) >= 2, plan


def test_few_windows_of_crowded_groups_are_joined(spark, monkeypatch):
    kind, join_hot, joined = repeats.Kind, repeats.join_hot, []
    monkeypatch.setattr(suffix_dedup, "Kind", lambda **k: kind(**k, crowd=2))
    monkeypatch.setattr(repeats, "join_hot", lambda rows, keys, on, *a: joined.append((on, rows)) or join_hot(rows, keys, on, *a))
    rnd = random.Random(4)
    text = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    line, passage = text(50), text(120)
    rows = list(enumerate([text(200) + line + text(200) for _ in range(60)] + [text(100) + passage + text(100) for _ in range(20)]))
    got = {r.doc_id: r.n_removed for r in suffix_dedup.suffix_dedup(frame(spark, rows), 100).collect()}
    assert got == {i: int(x.sum()) for (i, _), x in zip(rows, brute_bytes([t.encode() for _, t in rows], 100), strict=True)}
    # all windows around the line and the passage have anchors that repeat; only those that may repeat are joined, a row for each
    some = sum(rows.count() for on, rows in joined if "window" in on)
    assert 0 < some < 20 * 16 * 4 and sum(rows.count() for on, rows in joined if "whole" in on) < 1500


@pytest.mark.parametrize("words,length", [(False, 100), (True, 20), (True, 3)])
def test_blocks_share_their_windows_tokens(words, length):
    rnd = np.random.default_rng(length)
    size, windows, lead = max(1, min(16, length // 4)), 17, 40
    part = rnd.integers(0, 9, length + 30)
    whole = [np.concatenate([rnd.integers(10, 99, a), part, rnd.integers(10, 99, 60)])[: windows + length - 1] for a in (0, 3, 9)]
    tokens = np.concatenate(whole).astype(np.uint64 if words else np.uint8)
    n = np.full(3, windows)
    # each segment's anchor stands at the same place of the common part
    group = repeats.Group(np.arange(3), np.full(3, 5), n, lead + np.array([0, 3, 9]), np.full(3, 7), np.ones(3, int), tokens, np.arange(4) * (windows + length - 1))
    blocks = repeats.block_rows(group, length, size).to_pylist()
    assert sum(len(b["windows"]) for b in blocks) == 3 * windows and all(len(b["windows"]) <= size for b in blocks)
    seen = collections.defaultdict(set)
    for b in blocks:
        assert all((b["lead"] - i) // size == b["block"] for i in range(len(b["windows"])))
        for i, w in enumerate(b["windows"]):
            seen[b["lead"] - i, w].add((b["block"], b["core"]))
    assert all(len(x) == 1 for x in seen.values()) and len(seen) < 3 * windows


@pytest.mark.parametrize("op", [suffix_dedup.suffix_dedup, substring_dedup.substring_dedup])
def test_dedup_of_nothing(spark, op):
    assert op(frame(spark, [(1, "x")]).filter("false")).count() == 0


@pytest.mark.parametrize("room", [1, 3, 1000])
def test_prefix_groups_and_subtrees(room):
    rnd = np.random.default_rng(room)
    tokens, starts = rnd.integers(0, 2, 400).astype(np.int32), np.arange(380)
    seen, node = [], {}
    for members, shared in substring_dedup.prefix_groups(tokens, starts, 8, room):
        assert len({tuple(tokens[s : s + shared]) for s in members}) == 1
        assert len(members) <= room or shared == 8
        order, common_ = substring_dedup.subtree(tokens, starts[members], 8, shared)
        leaves = [tuple(tokens[s : s + 8]) for s in starts[members][order]]
        assert leaves == sorted(leaves)
        for a, b, n in zip(leaves, leaves[1:], common_[1:], strict=False):
            assert n == next((i for i in range(8) if a[i] != b[i]), 8)
        for leaf, d in zip(leaves, substring_dedup.deep_nodes(common_, 8), strict=True):
            assert node.setdefault(leaf, (len(seen), d)) == (len(seen), d)
        seen.append(members)
    assert sorted(np.concatenate(seen)) == starts.tolist()


# Jaccard join


def brute_groups(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = [bytes(b + 32 if 65 <= b <= 90 else b for b in x) for x in words(t)]
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


def near_copies(rnd):
    vocabulary, rows = [f"w{i}" for i in range(40)], []
    for _ in range(40):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([1, 2, 3, 5, 9, 11, 12, 15, 20, 22, 23, 25, 30, 60, 120]))]
        for _ in range(rnd.randrange(1, 9)):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
                k = rnd.randrange(len(w))
                if rnd.random() < 0.5:
                    w[k] = rnd.choice(vocabulary).upper()
                elif len(w) > 1 and rnd.random() < 0.5:
                    del w[k]
                else:
                    w.insert(k, rnd.choice(vocabulary))
            rows.append(" ".join(w))
    rows += ["", None, " \n", "é", "É"]
    rnd.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("n,percent,block", [(3, 90, 2048), (1, 90, 2048), (2, 80, 2048), (1, 70, 3)])
def test_jaccard_groups(spark, n, percent, block):
    rows = near_copies(random.Random(n * percent))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_groups(frame(spark, rows), n, percent, block).collect()}
    assert got == brute_groups(rows, n, percent)


def test_keep_one_of_each(spark):
    rows = near_copies(random.Random(9))
    docs = frame(spark, rows)
    kept = jaccard_join.keep_one_of_each(docs, 2, 80)
    want = brute_groups(rows, 2, 80)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, top) in want.items() if i == top)


def test_groups_of_repeated_and_null_ids(spark):
    rows = [(2, "a b c d"), (2, "a b c d"), (None, "a b c d"), (7, "x"), (None, None)]
    got = sorted(jaccard_join.jaccard_groups(frame(spark, rows)).collect(), key=str)
    assert sorted((r.n_shingles, r.component_id) for r in got if r.component_id is not None) == [(1, 2), (1, 2), (1, 2), (1, 7)]
    assert len(got) == 5
    assert jaccard_join.keep_one_of_each(frame(spark, rows)).count() == 3
    assert jaccard_join.jaccard_groups(frame(spark, rows).filter("false")).count() == 0
    assert jaccard_join.keep_one_of_each(frame(spark, rows).filter("false")).count() == 0


def test_boundary_follows_cost():
    assert jaccard_join.boundary(90) == 19 and jaccard_join.boundary(90, entry_cost=1) == 9
    assert jaccard_join.boundary(90, entry_cost=1000) > 19


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 400)] + [(rnd.randrange(1000, 1400), rnd.randrange(1000, 1400)) for _ in range(220)] + [(5000, i) for i in range(5001, 5300)]
    rnd.shuffle(edges)
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == {x: top(x) for a, b in edges if a != b for x in (a, b)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# texts that sums of powers cannot tell apart


def thue_morse(order, letters="ab"):
    """A word and its complement: their hashes by powers of any base are equal modulo 2**64 if they are long enough."""
    bits = [bin(i).count("1") & 1 for i in range(1 << order)]
    return "".join(letters[x] for x in bits), "".join(letters[1 - x] for x in bits)


@pytest.mark.parametrize("order", [10, 11, 12])
def test_no_word_stands_for_another(spark, order):
    a, b = thue_morse(order)
    x, y = (common.prefix_hash(np.frombuffer(t.encode(), np.uint8))[-1] for t in (a, b))
    assert x == y
    column = pa.array([a, b])
    (x, y), _ = repeats.token_values(column, True)
    assert x != y
    if order > 10:
        return
    got = jaccard_join.jaccard_groups(frame(spark, [(1, a), (2, b), (3, a + " "), (4, None)]), 3, 90).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 1, 4: 4}
    rest = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{rest} {a}"), (2, f"{rest} {b}"), (3, f"{rest} {b} more")]
    got = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(frame(spark, rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 20}


def test_no_segment_stands_for_another(spark):
    a, b = thue_morse(11)
    rows = [(1, a), (2, b), (3, a[:500] + "c" + b[500:])]
    gone = {i: mask for (i, _), mask in zip(rows, brute_bytes([t.encode() for _, t in rows], 400), strict=True)}
    for r in suffix_dedup.suffix_dedup(frame(spark, rows)).collect():
        data = np.frombuffer(dict(rows)[r.doc_id].encode(), np.uint8)
        assert r.n_removed == gone[r.doc_id].sum()
        assert r.kept_sha256 == hashlib.sha256(data[~gone[r.doc_id]].tobytes()).hexdigest()


def test_word_hashes():
    rnd = random.Random(3)
    found = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 90))) for _ in range(4000)] + ["a" * i for i in range(1, 200)]
    values, _ = repeats.token_values(pa.array([" ".join(found)]), True)
    assert len(set(values.tolist())) == len(set(found))
    alone = np.concatenate([repeats.token_values(pa.array([w]), True)[0] for w in found[:300]])
    assert alone.tolist() == values[:300].tolist()


def test_prefixes_split_every_bucket():
    """A bucket as tasks get it holds many times a subtree's suffixes, and prefixes of several words part them."""
    import inspect

    bucket = inspect.signature(repeats.compared).parameters["bucket_bytes"].default // repeats.WORD_BYTES
    assert bucket > 20 * substring_dedup.ROOM
    rnd = np.random.default_rng(0)
    tokens = rnd.zipf(1.3, bucket).astype(np.int64) % 5000
    groups = list(substring_dedup.prefix_groups(tokens, np.arange(bucket - 20), 20, substring_dedup.ROOM))
    assert len(groups) > 20 and max(shared for _, shared in groups) >= 2
    assert sorted(np.concatenate([m for m, _ in groups]).tolist()) == list(range(bucket - 20))
    assert all(len(m) <= substring_dedup.ROOM or shared == 20 for m, shared in groups)


def test_wide_bitmaps_lose_no_link():
    rnd = random.Random(7)
    sets = []
    for _ in range(30):
        base = sorted(rnd.sample(range(1 << 60), rnd.choice([40, 700, 3000])))
        for _ in range(6):
            keep = [x for x in base if rnd.random() > rnd.choice([0.02, 0.06, 0.12])] + rnd.sample(range(1 << 60), rnd.choice([0, len(base) // 30]))
            sets.append(np.array(sorted(keep), np.uint64))
    rnd.shuffle(sets)
    for percent in (80, 90):
        up = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    up = [min(up[i], up[j]) if x in (up[i], up[j]) else x for x in up]
        names, size, maps = list(range(len(sets))), [len(x) for x in sets], [jaccard_join.wide_map(x) for x in sets]
        exact = dict(jaccard_join.group_links(names, size, maps, percent, jaccard_join.similar_sets(sets, percent)))
        # clusters are named by a member; what is compared is which ones are together
        got = [exact.get(i, i) for i in names]
        pairs = lambda label: {(i, j) for i in names for j in names if label[i] == label[j]}
        assert pairs(got) == pairs(up)
        loose = dict(jaccard_join.group_links(names, size, maps, percent))
        assert pairs(up) <= pairs([loose.get(i, i) for i in names])


def test_kept_columns_may_have_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c", 1, 2, 3), (2, "a b c", 4, 5, 6), (2, "x", 7, 8, 9)], "doc_id long, text string, row int, gone int, _row int")
    kept = jaccard_join.keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == [(1, "a b c", 1, 2, 3), (2, "x", 7, 8, 9)]
