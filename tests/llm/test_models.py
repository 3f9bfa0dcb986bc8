"""Toxicity, decontamination and the pipeline."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from rowmill.llm import common, decontamination, registry, toxicity

SF = "/root/testdata/sf0.01"


# toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    rnd, rows, labels = random.Random(1), [], []
    plain, bad = [f"word{i}" for i in range(300)], ["vilest", "hateful", "scummy"]
    for i in range(1200):
        w = [rnd.choice(plain) for _ in range(rnd.randrange(5, 80))]
        toxic = rnd.random() < 0.15
        if toxic:
            for _ in range(3):
                w[rnd.randrange(len(w))] = rnd.choice(bad)
        rows.append((i, " ".join(w), "x", 7.0))
        if rnd.random() < 0.7:
            labels.append((i, int(toxic)))
    rows += [(None, "hateful scummy vilest hateful scummy", "x", 7.0), (1200, None, "x", 7.0), (1201, "", "x", 7.0), (0, rows[0][1], "x", 7.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string, score double").repartition(3)
    return docs, spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int"), dict(labels)


def test_held_out_labels(labelled, spark):
    docs, labels, truth = labelled
    got = toxicity.toxicity_scores(docs, labels).collect()
    assert len(got) == 1204
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [(by[i].predicted, y) for i, y in truth.items() if by[i].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert by[None].predicted == 1 and by[1200].score == by[1201].score and by[1200].predicted == 0
    # labels of held-out rows change nothing
    flipped = labels.filter(toxicity.fold("doc_id") != 2)
    again = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, flipped).collect()}
    assert all(abs(again[i] - by[i].score) < 1e-6 for i in by)


def test_rejection_keeps_columns(labelled):
    docs, labels, truth = labelled
    kept = toxicity.reject_toxic(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert len([i for i, y in truth.items() if not y and i not in ids]) < 0.03 * len(truth)


def test_scores_without_training_data(labelled):
    docs, labels, _ = labelled
    for some in (labels.filter("false"), labels.filter("toxic = 0")):
        assert {r.score for r in toxicity.toxicity_scores(docs, some).collect()} == {0.0}
    assert toxicity.toxicity_scores(docs.filter("false"), labels).count() == 0


def test_features_are_distinct_grams_of_one_text():
    column = pa.array(["aaaaaaaaaa", None, "abcdef", "ABCDEF", "abc", "xabcdefgx"])
    cells, offsets = toxicity.features(column)
    own = [set(cells[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert [len(x) for x in own] == [2, 1, 2, 2, 1, 5]
    assert own[2] == own[3] and own[2] <= own[5] and own[1] == {0}


def test_corrected_risk_needs_no_negatives():
    rnd = random.Random(3)
    word = lambda bad: " ".join(rnd.choice(["hateful", "vilest"]) if bad and k < 2 else f"w{rnd.randrange(200)}" for k in range(20))
    positive, mixed = [word(True) for _ in range(100)], [word(k % 10 == 0) for k in range(1000)]
    role = np.array([toxicity.POSITIVE] * 100 + [toxicity.UNLABELLED] * 1000)
    w, bias = toxicity.train(pa.array(positive + mixed), role, 0.1)
    z = np.concatenate([toxicity.forward(c, o, w) for _, c, o in toxicity.feature_slices(pa.array(mixed))]) + bias
    bad = np.arange(1000) % 10 == 0
    assert z[bad].min() > z[~bad].max() and (z[~bad] < 0).all()


# decontamination


def risk(texts, role, prior, w, bias):
    """The non-negative risk of a classifier, by its definition."""
    z = np.concatenate([toxicity.forward(c, o, w) for _, c, o in toxicity.feature_slices(pa.array(texts))]) + bias
    positive = role == toxicity.POSITIVE
    as_positive, as_negative = np.logaddexp(0, -z), np.logaddexp(0, z)
    return prior * as_positive[positive].mean() + max(0, as_negative[~positive].mean() - prior * as_negative[positive].mean())


def test_training_lowers_the_risk_of_its_start():
    rnd = random.Random(4)
    vocabulary = [f"word{i}" for i in range(300)]
    make = lambda bad: " ".join([*rnd.choices(vocabulary, k=30), *(rnd.choices(["vile", "nasty"], k=2) if bad else [])])
    texts = [make(True) for _ in range(100)] + [make(rnd.random() < 0.1) for _ in range(1000)]
    role = np.array([toxicity.POSITIVE] * 100 + [toxicity.UNLABELLED] * 1000)
    start = toxicity.train(pa.array(texts), role, 0.1, steps=1, rate=0.0)
    end = toxicity.train(pa.array(texts), role, 0.1)
    assert risk(texts, role, 0.1, *end) < 0.8 * risk(texts, role, 0.1, *start)


def test_samples_come_from_the_documents_that_there_are(spark):
    docs = spark.createDataFrame([(i, "x" * (i % 7)) for i in range(400)] + [(5, "again"), (None, "x"), (399, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(5000)], "doc_id long, toxic int")
    sample, prior = toxicity.samples(docs, labels, 2, (20, 40, 30), 1 << 20, "doc_id", "text")
    rows = sample.collect()
    counts = {}
    for r in rows:
        counts[r.model, r.role] = counts.get((r.model, r.role), 0) + 1
        assert 0 <= r.key < 400 and zlib.crc32(str(r.key).encode()) % 4 != 2
        assert r.role != toxicity.POSITIVE or r.toxic == 1
    assert counts == {(m, role): n for m in (0, 1) for role, n in ((toxicity.POSITIVE, 20), (toxicity.UNLABELLED, 40), (toxicity.CALIBRATION, 30))}
    assert 0.15 < prior < 0.25
    # a bound on bytes ends each sample
    few = toxicity.samples(docs, labels, 1, (20, 40, 30), 10, "doc_id", "text")[0].collect()
    assert 0 < len(few) < 30


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def test_edit_distances():
    rnd = np.random.default_rng(0)
    a, b = rnd.integers(0, 4, (200, 9)), rnd.integers(0, 4, (200, 9))
    assert decontamination.edit_distances(a, b).tolist() == [levenshtein(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def test_embedding_maps_edits_to_differences():
    rnd, near, far = np.random.default_rng(1), [], []
    for _ in range(50):
        x = rnd.integers(1, 1 << 60, 40).astype(np.uint64)
        y = np.delete(np.insert(x, 7, 5), 30)
        z = rnd.integers(1, 1 << 60, 40).astype(np.uint64)
        e = decontamination.embed(np.stack([x, y, z]), 0)
        near.append((e[0] != e[1]).mean())
        far.append((e[0] != e[2]).mean())
    # both end in the same padding
    assert np.median(near) < 0.4 < 0.6 < np.median(far)


def edited(rnd, n, evenly):
    """An item and a passage with just as many edits as are allowed."""
    item = [rnd.getrandbits(40) for _ in range(n)]
    w, k = list(item), n // 5
    for e in range(k):
        i, kind = rnd.randrange(len(w)), rnd.random()
        if evenly:
            w[min(n - 1, (e + 1) * n // (k + 1))] = rnd.getrandbits(40)
        elif kind < 0.5:
            w[i] = rnd.getrandbits(40)
        elif kind < 0.75 and len(w) > 1:
            del w[i]
        else:
            w.insert(i, rnd.getrandbits(40))
    return item, w


@pytest.mark.parametrize("n", [5, 9, 14, 20, 38, 59])
@pytest.mark.parametrize("evenly", [False, True])
def test_keys_alone_find_candidates(n, evenly):
    rnd = random.Random(n)
    pairs = [edited(rnd, n, evenly) for _ in range(200)]
    column = lambda rows: pa.array([" ".join(f"w{x}" for x in w) for w in rows])
    index = decontamination.ItemIndex(list(range(200)), column([a for a, _ in pairs]), 0.8, 8, 1, 7)
    words, first = decontamination.lower_words(column([b for _, b in pairs]))
    found = {(i, d) for i, doc, _ in index.hits(words, first) for d in doc.tolist()}
    assert sum((i, i) in found for i in range(200)) >= 198
    # and almost nothing else: walks may go on into the next text, which is found out when a place is verified
    assert all(0 <= i - d <= 1 for i, d in found)
    none = decontamination.ItemIndex([0], column([pairs[0][0]]), 0.8, 0, 1, 7)
    assert none.matches(*decontamination.lower_words(column([pairs[0][0]])), True) == []


def test_contaminated_equals_brute_force(spark):
    rnd, vocabulary = random.Random(2), [f"w{i}" for i in range(3000)]
    make = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(i, make(rnd.choice([1, 3, 5, 8, 14, 20, 35, 56]))) for i in range(40)]
    docs = []
    for i in range(300):
        t = make(rnd.randrange(0, 150))
        if rnd.random() < 0.8:
            w = list(rnd.choice(items)[1])
            for _ in range(rnd.randrange(0, int(0.25 * len(w)) + 1)):
                k, kind = rnd.randrange(len(w)), rnd.random()
                if kind < 0.6:
                    w[k] = rnd.choice(vocabulary)
                elif kind < 0.8 and len(w) > 1:
                    del w[k]
                else:
                    w.insert(k, rnd.choice(vocabulary))
            k = rnd.randrange(len(t) + 1)
            t[k:k] = w
        docs.append((i, t))
    want = {}
    for d, t in docs:
        for i, w in items:
            n, k = len(w), int(0.2 * len(w) + 1e-9)
            if len(t) >= n:
                windows = np.lib.stride_tricks.sliding_window_view(np.array([int(x[1:]) for x in t]), n)
                best = decontamination.edit_distances(np.broadcast_to([int(x[1:]) for x in w], windows.shape), windows).min()
                if best <= k:
                    want[d, i] = int(best)
    rows = [(d, " ".join(t).upper(), "x") for d, t in docs] + [(None, " ".join(items[7][1]), "x"), (400, None, "x"), (401, " ", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([*((i, ", ".join(w)) for i, w in items), (98, None), (99, "...")], "item_id long, text string")
    found = decontamination.contaminated(frame, bench, block=17).collect()
    got = {(r.doc_id, r.item_id): r.distance for r in found if r.doc_id is not None}
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want)
    assert all(want[k] <= v for k, v in got.items()) and any(r.doc_id is None and r.item_id == 7 for r in found)
    kept = decontamination.drop_contaminated(frame, bench, block=17)
    assert kept.columns == frame.columns
    hit = {d for d, _ in got}
    assert sorted(r.doc_id for r in kept.collect()) == sorted([d for d, _ in docs if d not in hit] + [400, 401])
    assert decontamination.contaminated(frame, bench.filter("false")).count() == 0
    assert decontamination.contaminated(frame.filter("false"), bench).count() == 0


def closest_run(item, text):
    """Smallest distance, and its first start, of the item to the runs of n - k to n + k words of a text."""
    n, k = len(item), int(0.2 * len(item) + 1e-9)
    padded = np.array([*text, *[-1] * (n + k)])
    runs = np.lib.stride_tricks.sliding_window_view(padded, n + k)[: len(text)]
    row = np.tile(np.arange(n + k + 1), (len(runs), 1))
    for i, x in enumerate(item):
        new = [row[:, 0] + 1]
        for j in range(n + k):
            new.append(np.minimum(np.minimum(row[:, j + 1], new[j]) + 1, row[:, j] + (runs[:, j] != x)))
        row = np.stack(new, axis=1)
    sized = [(int(row[s, m]), s) for s in range(len(runs)) for m in range(n - k, n + k + 1) if s + m <= len(text)]
    return min(sized, default=(n, 0))


def test_free_ends_find_runs_of_any_size(spark):
    rnd = random.Random(5)
    make = lambda n: [rnd.randrange(3000) for _ in range(n)]
    items = [(i, make(n)) for i, n in enumerate([1, 4, 5, 9, 14, 20, 38, 38, 59])]
    w = items[6][1]
    # a text of one word less than its item, and passages with words left out or put in
    docs = [w[:9] + w[10:], make(20) + w[:10] + w[14:] + make(20), w[7:], make(9) + w[:31], w[:20] + make(7) + w[20:], w[:15] + make(8) + w[15:], w[8:]]
    for _ in range(150):
        w = list(rnd.choice(items)[1])
        for _ in range(rnd.randrange(int(0.25 * len(w)) + 1)):
            k = rnd.randrange(len(w))
            w[k : k + rnd.choice([0, 1, 1])] = make(rnd.choice([0, 1]))
        docs.append(make(rnd.choice([0, 0, 5, 40])) + w + make(rnd.choice([0, 0, 5, 40])))
    want = {}
    for d, t in enumerate(docs):
        for i, w in items:
            distance, start = closest_run(w, t)
            if distance <= int(0.2 * len(w) + 1e-9):
                want[d, i] = (distance, start)
    assert all((d, 6) in want for d in range(5)) and (5, 6) not in want and (6, 6) not in want
    frame = spark.createDataFrame([(d, " ".join(f"w{x}" for x in t)) for d, t in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(f"W{x}" for x in w)) for i, w in items], "item_id long, text string")
    found = decontamination.contaminated(frame, bench, free_ends=True).collect()
    assert {(r.doc_id, r.item_id): (r.distance, r.start) for r in found} == want
    kept = decontamination.drop_contaminated(frame, bench, free_ends=True).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(range(len(docs))) - {d for d, _ in want})


def test_query_and_pipeline_search_free_ends(spark, tmp_path):
    item = [f"w{i}" for i in range(38)]
    spark.createDataFrame([(1, " ".join(item[:9] + item[10:])), (2, "another text")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(5, " ".join(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [(r.doc_id, r.item_id, r.distance) for r in registry.queries()["op9_decontamination"](spark, str(tmp_path)).collect()] == [(1, 5, 1)]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [r.doc_id for r in dict(corpus_pipeline.STAGES)["decontamination"](spark, docs, str(tmp_path)).collect()] == [2]


# pipeline


def test_stages(spark):
    docs = common.table(spark, SF, "documents")
    columns, n = docs.columns, docs.count()
    counts = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, SF), name)
        assert docs.columns == columns
        counts[name] = docs.count()
    assert n > counts["toxicity"] > 0.8 * n
    assert counts["toxicity"] > counts["jaccard_join"] > counts["decontamination"] == counts["secret_scan"]
    assert docs.filter("text like '%AKIA%' or text rlike 'password=[0-9a-f]{8}'").count() == 0
    assert docs.filter("text like '%[SECRET]%'").count() > 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_registered_queries():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11))
