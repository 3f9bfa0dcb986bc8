"""Mixture-controlled packing of documents into sequences, by deficit round-robin over source queues.

The tokens of each source form a queue. In each window, about a run of sequences, every queue is credited its quantum,
the window's tokens times its target share, and sends the whole tokens it has credit for. The rest, its deficit, is
carried to the next window. Credits have a closed form, so where a token goes follows from its place in its queue
alone: with share p, a queue has sent floor(r * window * p) tokens after r windows.
A queue is the concatenation of the tasks' parts, so deficits carry over partitions as over windows. When a
queue runs out, the shares of the others are scaled up, and a new phase begins.

Documents are encoded once, into a shared table with their place in the task's part of the queue; only the
totals of (queue, task) are summed up, and only the totals of queues go to the driver: at most `max_queues` numbers,
as more sources than that share queues by hash. The places where tasks' parts of queues begin are broadcast if they
are counted to be at most `broadcast_rows`, and joined by a shuffle otherwise.

Defined results: a null text is empty and yields the end token alone; a null source is a queue of its own; repeated rows are
packed once each; null ids pass through; an empty table gives no pieces; very long documents are cut; other columns are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, texts, written
from .token_words import shared_encoder

ENCODED = "doc_id long, queue string, part int, place long, doc_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string"


class Mixture:
    """Where queues' tokens go. totals: tokens of each queue; weights: target shares, those of the totals if None.

    A phase is (first position, queues, their shares' numerators and common denominator, tokens that each had sent
    before, credit in tokens): until a queue runs out, credit grows by a window at a time."""

    def __init__(self, totals: dict[str, int], window: int, weights: dict[str, float] | None = None):
        self.window, self.phases, self._marks = window, [], {}
        left = {q: totals[q] for q in sorted(totals) if totals[q]}
        share = {q: Fraction(weights.get(q, 0) if weights else n) for q, n in left.items()}
        sent, at = dict.fromkeys(left, 0), 0
        while left:
            live = [q for q in left if share[q] > 0] or list(left)
            parts = [share[q] or Fraction(1) for q in live]
            scale = lcm(*(x.denominator for x in parts))
            parts = [int(x * scale) for x in parts]
            whole = sum(parts)
            credit = min(-(-left[q] * whole // n) for q, n in zip(live, parts, strict=True))
            self.phases.append((at, live, parts, whole, dict(sent), credit))
            for q, n in zip(live, parts, strict=True):
                gone = n * credit // whole
                sent[q] += gone
                left[q] -= gone
                at += gone
            left = {q: n for q, n in left.items() if n}
        self.total = at

    def marks(self, phase: int, window: int) -> tuple[list[int], list[int]]:
        """Of each queue, the tokens sent before this window of the phase, and the position of the first in it."""
        if (phase, window) not in self._marks:
            if len(self._marks) > 256:
                self._marks.clear()
            at, _, parts, whole, _, credit = self.phases[phase]
            a, b = min(credit, window * self.window), min(credit, (window + 1) * self.window)
            start = [n * a // whole for n in parts]
            position, p = [], at + sum(start)
            for n, x in zip(parts, start, strict=True):
                position.append(p)
                p += n * b // whole - x
            self._marks[phase, window] = start, position
        return self._marks[phase, window]

    def locate(self, queue: str, first: int, count: int) -> list[tuple[int, int, int]]:
        """(token of the queue, position, tokens) of the runs that hold the queue's tokens first .. first + count."""
        out, end = [], first + count
        for phase, (_, live, parts, whole, before, credit) in enumerate(self.phases):
            if first == end:
                break
            if queue not in live:
                continue
            i = live.index(queue)
            if first >= before[queue] + parts[i] * credit // whole:
                continue
            r = max(0, (first - before[queue]) * whole // (parts[i] * self.window) - 1)
            while first < end and r * self.window < credit:
                start, position = self.marks(phase, r)
                stop = before[queue] + parts[i] * min(credit, (r + 1) * self.window) // whole
                if stop > first:
                    take = min(end, stop) - first
                    out.append((first, position[i] + first - before[queue] - start[i], take))
                    first += take
                r += 1
        return out


def encode(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str, source_col: str, queues: int | None) -> DataFrame:
    """Each row's ids and the end id, in 2 or 4 bytes each, its queue and its place in the task's part of that queue."""
    queue = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    if queues:
        queue = F.concat(F.lit("#"), F.pmod(F.xxhash64(queue), F.lit(queues)).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, filled = shared_encoder(tokenizer), TaskContext.get().partitionId(), {}
        for whole in batches:
            for b in slices(whole, "text"):
                names, place, sizes, ids = b.column("queue").to_pylist(), [], [], []
                for q, x in zip(names, encoder.ids(texts(b.column("text"))), strict=True):
                    place.append(filled.get(q, 0))
                    sizes.append(len(x) + 1)
                    filled[q] = place[-1] + sizes[-1]
                    ids.append(np.append(x, np.uint32(end_id)).astype(np.uint16 if x.max(initial=end_id) < 1 << 16 else np.uint32).tobytes())
                n = b.num_rows
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("queue"), pa.array([part] * n, pa.int32()), pa.array(place, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())], [x.split()[0] for x in ENCODED.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), queue.alias("queue"), F.col(text_col).alias("text")).mapInArrow(run, ENCODED)


def pack(docs: DataFrame, tokenizer: str, sequence: int = 2048, end_id: int = 1, window_sequences: int = 32, weights: dict[str, float] | None = None, max_queues: int = 4096, broadcast_rows: int = 100_000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row for each piece: its document, where it starts there, its length and checksum, and its sequence and offset."""
    many = docs.select(source_col).distinct().limit(max_queues + 1).count() > max_queues
    if many and weights:
        raise ValueError("target shares need at most max_queues sources")
    rows = written(encode(docs, tokenizer, end_id, id_col, text_col, source_col, max_queues if many else None), "encoded")
    parts = written(rows.groupBy("queue", "part").agg(F.sum("doc_tokens").alias("tokens")), "parts")
    before = parts.select("queue", F.col("part").alias("of_part"), (F.sum("tokens").over(Window.partitionBy("queue").orderBy("part")) - F.col("tokens")).alias("before"))
    totals = {r.queue: r.tokens for r in parts.groupBy("queue").agg(F.sum("tokens").alias("tokens")).collect()}  # at most max_queues rows
    mixture = Mixture(totals, sequence * window_sequences, weights)
    before = before.withColumnRenamed("queue", "of_queue")
    if before.count() <= broadcast_rows:
        before = F.broadcast(before)
    placed = rows.join(before, (F.col("queue") == F.col("of_queue")) & (F.col("part") == F.col("of_part")))
    placed = placed.select("doc_id", "queue", (F.col("place") + F.col("before")).alias("first"), "doc_tokens", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "ids"):
                out: list[tuple] = []
                for doc, queue, first, n, raw in zip(*(b.column(c).to_pylist() for c in b.schema.names), strict=True):
                    ids = np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32)
                    for a, position, size in mixture.locate(queue, first, n):
                        while size:
                            take = min(size, sequence - position % sequence)
                            start = a - first
                            piece = ids[start : start + take].astype("<u4").tobytes()
                            out.append((doc, start, take, zlib.crc32(piece), n, position // sequence, position % sequence, queue))
                            a, position, size = a + take, position + take, size - take
                kinds = [pa.int64()] * 7 + [pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], [x.split()[0] for x in PIECES.split(", ")])

    return placed.mapInArrow(run, PIECES)
