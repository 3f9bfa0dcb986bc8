"""What the operators share: reading tables, scratch tables, Arrow batches, hashing.

Text is handled in slices of a few MB, so that numpy's temporaries stay
bounded whatever the batch size; nulls in a text column count as empty texts.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import sys
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.sources.shared import shared_folder

SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the cluster names."""
    return f"{shared_folder(spark)}/rowmill-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once into a shared Parquet table and read again: a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, most: int = 8 << 20) -> SparkSession:
    """Bounds the bytes of an Arrow batch that goes to Python, for rows that may be large; a session that bounds them lower stays as it is."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > most:
        spark.conf.set(name, str(most))
    return spark


def process_store() -> dict:
    """A dictionary that lives as long as this Python worker, which Spark reuses for later tasks."""
    return sys.modules.setdefault("_rowmill_process", types.ModuleType("_rowmill_process")).__dict__


def release() -> None:
    """Gives back, when this worker has come to another stage, what tasks of earlier ones have left in its store and its heap."""
    store, context = process_store(), TaskContext.get()
    if context is None or store.get("stage") == context.stageId():
        return
    store.pop("kept", None)
    store["stage"] = context.stageId()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """batch in runs of rows whose texts hold about `limit` bytes together; a longer text comes alone."""
    release()
    n, at = batch.num_rows, 0
    if not n:
        return
    ends = np.cumsum(lengths(batch.column(column)))
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each value, 0 for nulls."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, one after another, and the n + 1 offsets of its values; nulls are empty."""
    sizes = lengths(column)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    if column.null_count:
        column = column.fill_null("")
    buffers, kind = column.buffers(), np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if buffers[2] is None or not offsets[-1]:
        return np.zeros(0, np.uint8), offsets
    start = int(np.frombuffer(buffers[1], kind)[column.offset])
    return np.frombuffer(buffers[2], np.uint8)[start : start + int(offsets[-1])], offsets


def texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit (splitmix64's finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(label: str, n: int) -> np.ndarray:
    """n fixed pseudo-random uint64 values for a label, the same on every machine."""
    seed = np.uint64(int.from_bytes(hashlib.sha256(label.encode()).digest()[:8], "little"))
    return mix(seed + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_BYTE = seeded("byte", 256)
_BASE = seeded("base", 1)[0] | np.uint64(5)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _POWERS[size] = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64), dtype=np.uint64)]) for b in (_BASE, inverse))
    return _POWERS[size]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """H with H[i] the hash sum of values[:i]; values are uint64, or bytes, which a table spreads.

    Such sums collide for some long sequences, whatever the base: they choose places to look at, and never decide that sequences are equal."""
    if values.dtype == np.uint8:
        values = _BYTE[values]
    up, _ = _powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], dtype=np.uint64, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end], alike wherever the same values stand."""
    _, down = _powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_GOLD = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
LONG_WORD = 64


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run data[start:end] of at least one byte: eight bytes at a time through a mixing chain, long runs by XXH3."""
    sizes = ends - starts
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    loads = np.ndarray((len(data) + 1,), np.uint64, padded, 0, (1,))
    out = mix(sizes.astype(np.uint64) * _GOLD + _BASE)
    live, at = np.flatnonzero(sizes <= LONG_WORD), 0
    while len(live):
        left = np.minimum(sizes[live] - at, 8)
        out[live] = mix(out[live] ^ (loads[starts[live] + at] & _MASKS[left]))
        at += 8
        live = live[sizes[live] > at]
    if len(long := np.flatnonzero(sizes > LONG_WORD)):
        out[long] = digests(data, starts[long], ends[long])
    return out


def digests(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XXH3 of the bytes of each values[start:end]."""
    raw, size, digest = memoryview(np.ascontiguousarray(values)).cast("B"), values.itemsize, xxhash.xxh3_64_intdigest
    return np.array([digest(raw[a:b]) for a, b in zip((starts * size).tolist(), (ends * size).tolist(), strict=True)], np.uint64)


_FACTORS = seeded("factors", 64) | np.uint64(1)


def gram_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n of the values, which are hashes themselves: a sum with a factor of its own for each place, mixed."""
    m = max(0, len(values) - n + 1)
    total = np.full(m, np.uint64(n) * _GOLD, np.uint64)
    for j in range(n):
        total += values[j : j + m] * _FACTORS[j]
    return mix(total)


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that no separator (a table of 256 booleans) breaks, within texts; and each text's first word, n + 1 of them."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~separator[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = word[edges]
    last[edges - 1] = word[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


SPACES = np.zeros(256, bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True


def null_safe(a: DataFrame, b: DataFrame, *names: str):
    """a's and b's columns of these names are equal, nulls included."""
    on = F.lit(True)
    for x in names:
        on = on & a[x].eqNullSafe(b[x])
    return on
