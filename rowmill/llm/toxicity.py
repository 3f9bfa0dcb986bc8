"""Toxicity scores learnt from positive and unlabelled texts, with a non-negative risk estimator.

Features are the distinct 6-grams of a text's lower-cased bytes, hashed to DIM cells and weighted by how much
likelier they are in positive than in other texts, where the other texts' rates are the unlabelled ones less the positives'
share at the class prior; those whose rates differ by chance weigh nothing. Each classifier is linear and minimises pi * R+(positive) + max(0, R-(unlabelled) - pi * R-(positive)) by Adam:
where the corrected risk of the negatives falls below zero, the step goes back up it. Weights are averaged over the second
half of the steps, and a logistic curve fitted to labelled rows that it has not seen turns them into probabilities.
The score is the mean over the classifiers, each trained in a task of its own.

Training takes bounded samples: `positives` and `unlabelled` texts for each classifier and `calibration` labelled rows, in the order of
a hash of their ids over all documents, each sample up to the row that brings it to `sample_bytes`. The prior is counted over
all labels of documents that may be learnt from.
Labels of held-out rows (crc32 of the id, as text, modulo 4 is 2) are never read. Scores use the text alone.

Defined results: null and empty texts score like a text without features; without any positive text to learn from, or any
that is not toxic, all scores are the prior; of several labels of one id the largest counts; a row with a null id is scored
and not held out; repeated rows have equal scores; other columns are not carried, except by `reject_toxic`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import flat_bytes, prefix_hash, slices, span_hash, written

DIM_BITS, GRAM = 19, 6
DIM = 1 << DIM_BITS
POSITIVE, UNLABELLED, CALIBRATION = 0, 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct cells of each text's byte 6-grams, one text after another, and the texts' offsets. Every text also has cell 0."""
    data, offsets = flat_bytes(column)
    n = len(offsets) - 1
    prefix, doc = prefix_hash(_LOWER[data]), np.repeat(np.arange(n), np.diff(offsets))
    at = np.arange(max(0, len(data) - GRAM + 1))
    at = at[at + GRAM <= offsets[1:][doc[: len(at)]]]
    cell = (span_hash(prefix, at, at + GRAM) >> np.uint64(64 - DIM_BITS)).astype(np.int64)
    keys = np.sort(np.concatenate([doc[at] << DIM_BITS | cell, np.arange(n) << DIM_BITS]))
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    return keys & (DIM - 1), np.searchsorted(keys, np.arange(n + 1) << DIM_BITS)


def forward(cells: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sums of each text's weights over the square root of how many there are."""
    if len(offsets) < 2:
        return np.zeros((0, *weights.shape[1:]))
    scale = 1 / np.sqrt(np.diff(offsets))
    return np.add.reduceat(weights[cells], offsets[:-1], axis=0) * (scale if weights.ndim == 1 else scale[:, None])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def feature_slices(column: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """features() of many texts, a slice at a time, so that memory holds those of one slice."""
    at = 0
    for b in slices(pa.RecordBatch.from_arrays([column], ["text"]), "text", 1 << 20):
        yield slice(at, at + b.num_rows), *features(b.column("text"))
        at += b.num_rows


def ratios(in_p: np.ndarray, in_u: np.ndarray, n_p: int, n_u: int, prior: float, smooth: float = 8, least: float = 6, few: int = 64) -> np.ndarray:
    """Log ratio of each cell's rates in positive and in other texts; 0 where they differ by less than `least` standard errors, but for the `few` that differ most."""
    others = np.maximum(in_u - prior * in_p, 0) / (1 - prior)
    spread = np.sqrt((others + in_p * n_p / n_u + 0.5 / n_u) * (1 - np.minimum(others, 0.99)) / n_p + 1e-12)
    z = np.abs(in_p - others) / spread
    z[0] = 0
    bound = min(least, np.sort(z)[-few])
    return np.where((z >= bound) & (z > 0), np.log((1000 * in_p + smooth) / (1000 * others + smooth)), 0)


def train(texts: pa.Array, role: np.ndarray, prior: float, steps: int = 60, rate: float = 0.03) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk; role is POSITIVE or UNLABELLED for each text."""
    p = role == POSITIVE
    n_p, n_u = int(p.sum()), int((~p).sum())
    seen = np.zeros((2, DIM))
    for part, cells, offsets in feature_slices(texts):
        positive = np.repeat(p[part], np.diff(offsets))
        seen += [np.bincount(cells[keep], minlength=DIM) for keep in (positive, ~positive)]
    ratio = ratios(seen[0] / n_p, seen[1] / n_u, n_p, n_u, prior)
    # only the cells that weigh something are kept
    sizes, live_cells, live_rows = np.zeros(len(p), np.int64), [], []
    for part, cells, offsets in feature_slices(texts):
        sizes[part] = np.diff(offsets)
        live = ratio[cells] != 0
        live_cells.append(cells[live])
        live_rows.append(np.repeat(np.arange(part.start, part.stop), sizes[part])[live])
    cells, row = np.concatenate(live_cells), np.concatenate(live_rows)
    w, mean, var, total, kept = np.ones(DIM), np.zeros(DIM), np.zeros(DIM), np.zeros(DIM), 0
    bias, bias_total, scale = np.log(prior / (1 - prior)), 0.0, 1 / np.sqrt(sizes)
    for t in range(1, steps + 1):
        z = np.bincount(row, weights=(w * ratio)[cells], minlength=len(sizes)) * scale + bias
        s = sigmoid(z)
        # of the logistic loss: as negatives, less the share of the positives
        loss = np.logaddexp(0, z)
        negatives = loss[~p].mean() - prior * loss[p].mean()
        g = np.where(p, -prior * s / n_p, s / n_u)
        g = np.where(p, prior * (s - 1) / n_p, 0) + g if negatives >= 0 else -g
        grad = ratio * np.bincount(cells, weights=(g * scale)[row], minlength=DIM) + 1e-6 * (w - 1)
        mean, var = 0.9 * mean + 0.1 * grad, 0.99 * var + 0.01 * grad**2
        w = w - rate * (mean / (1 - 0.9**t)) / (np.sqrt(var / (1 - 0.99**t)) + 1e-8)
        bias -= 0.2 * g.sum()
        if 2 * t > steps:
            total, bias_total, kept = total + w, bias_total + bias, kept + 1
    return total / kept * ratio, bias_total / kept


def calibrate(z: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """a and b of the probability sigmoid(a * z + b), by Newton's method; few rows pull a little towards the prior's curve."""
    middle, spread = z.mean(), z.std() + 1e-9
    x = np.stack([(z - middle) / spread, np.ones_like(z)])
    start = theta = np.array([1.0, np.log(prior / (1 - prior))])
    for _ in range(50):
        q = sigmoid(theta @ x)
        grad = x @ (q - y) + 0.5 * (theta - start)
        theta = theta - np.linalg.solve((x * (q * (1 - q))) @ x.T + 0.5 * np.eye(2), grad)
    return theta[0] / spread, theta[1] - theta[0] * middle / spread


def fold(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4, F.lit(0))


def samples(docs: DataFrame, labels: DataFrame, models: int, sizes: tuple[int, int, int], sample_bytes: int, id_col: str, text_col: str) -> tuple[DataFrame | None, float]:
    """(model, role, toxic, text) of the rows that each classifier learns from, and the class prior. Two passes over ids, one over texts."""
    learn = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select(F.col("doc_id").cast("long").alias("labelled"), F.col("toxic").cast("int").alias("toxic"))
    learn = learn.filter(fold("labelled") != 2).groupBy("labelled").agg(F.max("toxic").alias("toxic"))
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("key is not null")
    ids = rows.groupBy("key").agg(F.max(F.octet_length("text")).alias("bytes"))
    ids = ids.join(learn, F.col("key") == F.col("labelled"), "left").select("key", "bytes", "toxic", fold("key").alias("fold")).filter("fold != 2")
    ids = written(ids, "sampled")
    seen = {r.fold: r for r in ids.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count("toxic").alias("known"), F.sum((F.col("toxic") == 1).cast("int")).alias("p")).collect()}  # three rows
    known, p = sum(r.known for r in seen.values()), sum(r.p or 0 for r in seen.values())
    prior = p / known if known else 0.0
    if not 0 < prior < 1:
        return None, prior
    picks = []
    for m in range(models):
        # each learns from two of the folds that may be learnt from, and its curve is fitted to the third
        third = (0, 1, 3)[m % 3]
        own = [f for f in (0, 1, 3) if f != third]
        for role, folds, of, count in ((POSITIVE, own, F.col("toxic") == 1, "p"), (UNLABELLED, own, F.lit(True), "n"), (CALIBRATION, [third], F.col("toxic").isNotNull(), "known")):
            there = sum(getattr(seen[f], count) or 0 for f in folds if f in seen)
            # the smallest hashes: more than enough lie below the bound
            bound = (sizes[role] + 6 * sizes[role] ** 0.5 + 30) / max(1, there)
            place = F.shiftrightunsigned(F.xxhash64("key", F.lit(m * 3 + role)), 11) / 2.0**53
            picks.append(F.when(of & F.col("fold").isin(folds) & (place < bound), F.struct(F.lit(m).alias("model"), F.lit(role).alias("role"), F.lit(sizes[role]).alias("most"), place.alias("place"))))
    chosen = ids.select("key", "bytes", "toxic", F.explode(F.filter(F.array(*picks), lambda x: x.isNotNull())).alias("pick")).select("key", "bytes", "toxic", "pick.*")
    order = Window.partitionBy("model", "role").orderBy("place", "key")
    chosen = chosen.withColumn("nth", F.row_number().over(order)).withColumn("before", F.sum("bytes").over(order) - F.col("bytes"))
    chosen = chosen.filter((F.col("nth") <= F.col("most")) & (F.col("before") < sample_bytes)).select(F.col("key").alias("chosen"), "model", "role", "toxic")
    # at most models * the sum of the sizes rows
    found = rows.join(F.broadcast(chosen), F.col("key") == F.col("chosen"))
    return found.groupBy("model", "role", "key", "toxic").agg(F.max("text").alias("text")), prior


def classifiers(docs: DataFrame, labels: DataFrame, models: int, positives: int, unlabelled: int, calibration: int, sample_bytes: int, id_col: str, text_col: str) -> tuple[list, float]:
    """(weights, bias) of each classifier, its curve included, and the class prior."""
    sample, prior = samples(docs, labels, models, (positives, unlabelled, calibration), sample_bytes, id_col, text_col)
    if sample is None:
        return [], prior

    def fit(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().to_batches()[0] if group.num_rows else None
        schema = pa.schema([("model", pa.int32()), ("weights", pa.binary()), ("bias", pa.float64())])
        role = group.column("role").to_numpy()
        use = lambda keep: group.column("text").filter(pa.array(keep))
        fitted, held = role != CALIBRATION, role == CALIBRATION
        if not ((role == POSITIVE).any() and (role == UNLABELLED).any()):
            return schema.empty_table()
        w, bias = train(use(fitted), role[fitted], prior)
        a, b = 1.0, 0.0
        y = group.column("toxic").to_numpy(zero_copy_only=False)[held].astype(float)
        if len(set(y)) == 2:
            z = np.concatenate([forward(cells, offsets, w) for _, cells, offsets in feature_slices(use(held))])
            a, b = calibrate(z + bias, y, prior)
        return pa.Table.from_arrays([pa.array([group.column("model")[0].as_py()], pa.int32()), pa.array([(a * w).astype(np.float32).tobytes()], pa.binary()), pa.array([a * bias + b])], schema=schema)

    fitted = sample.groupBy("model").applyInArrow(fit, "model int, weights binary, bias double").collect()  # `models` rows of a fixed size
    return [(np.frombuffer(r.weights, np.float32), r.bias) for r in sorted(fitted, key=lambda r: r.model)], prior


def toxicity_scores(docs: DataFrame, labels: DataFrame, models: int = 6, positives: int = 2000, unlabelled: int = 4000, calibration: int = 2000, sample_bytes: int = 32 << 20, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted (score >= threshold) of each row."""
    scorer = score_batches(docs, labels, models, positives, unlabelled, calibration, sample_bytes, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, score in scorer(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(id_col) == 2).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def score_batches(docs, labels, models, positives, unlabelled, calibration, sample_bytes, id_col, text_col):
    """Trains, and returns a function from batches to parts of them with scores."""
    fitted, prior = classifiers(docs, labels, models, positives, unlabelled, calibration, sample_bytes, id_col, text_col)
    weights = np.stack([w for w, _ in fitted], axis=1) if fitted else None
    bias = np.array([b for _, b in fitted])
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def scored(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        w = shared.value
        for whole in batches:
            for b in slices(whole, text, 1 << 20):
                yield b, np.full(b.num_rows, prior) if w is None else sigmoid(forward(*features(b.column(text)), w).astype(float) + bias).mean(axis=1)

    return scored


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, models: int = 6, positives: int = 2000, unlabelled: int = 4000, calibration: int = 2000, sample_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns kept, whose text scores less than the threshold."""
    scorer = score_batches(docs, labels, models, positives, unlabelled, calibration, sample_bytes, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, score in scorer(batches, text_col):
            yield b.filter(pa.array(score < threshold))

    return docs.mapInArrow(run, docs.schema)
