"""Media columns: bytes stored losslessly as PNG images in a binary column, and cosine-transform hashes of what is read back.

`encode_png` lays a text's UTF-8 bytes, padded with spaces to whole rows, out as 8-bit grey samples and
writes signature, IHDR, IDAT chunks and IEND. `read_png` is a reader of its own: it tests every
chunk's CRC-32 and the zlib stream's checksum and undoes the five row filters with numpy.
`png_features` reads the binary column and hashes the low frequencies of each image.

Defined results: a null or empty text is one row of spaces; equal texts give equal images and hashes;
ties at the median count as 0 bits; null ids pass through; other columns are not carried.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 192
GRID, LOW = 32, 8
_ANGLE = np.pi * (2 * np.arange(GRID)[None, :] + 1) * np.arange(LOW)[:, None] / (2 * GRID)
_COSINE = np.cos(_ANGLE) * np.sqrt(np.where(np.arange(LOW)[:, None] == 0, 1 / GRID, 2 / GRID))

ENCODED = "doc_id long, n_bytes long, media binary"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, phash binary"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def write_png(payload: bytes, width: int = WIDTH, level: int = 4, chunk: int = 1 << 16) -> bytes:
    """payload, a positive multiple of width, as a grey PNG. A row is filtered by Up or Sub where that makes most of it zero, else kept."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0], lines[:, 1:] = 0, rows
    same = np.count_nonzero(rows[:, 1:] == rows[:, :-1], axis=1) * 2 > width
    above = np.zeros(len(rows), bool)
    above[1:] = np.count_nonzero(rows[1:] == rows[:-1], axis=1) * 2 > width
    if (k := np.flatnonzero(above)).size:
        lines[k, 0], lines[k, 1:] = 2, rows[k] - rows[k - 1]
    if (k := np.flatnonzero(same & ~above)).size:
        lines[k, 0], lines[k, 2:] = 1, rows[k, 1:] - rows[k, :-1]
    packed = zlib.compress(lines.tobytes(), level)
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + b"".join(_chunk(b"IDAT", packed[i : i + chunk]) for i in range(0, len(packed), chunk)) + _chunk(b"IEND", b"")


def _undo_diagonals(kinds: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray:
    """Undoes all filters along diagonals: a pixel needs those to its left, above and between, which lie on the two diagonals before."""
    n, pixels = len(rows), rows.shape[1] // step
    done = np.zeros((n + 1, pixels + 1, step), np.int16)  # the row above and the pixel to the left of the image are zero
    done[1:, 1:] = rows.reshape(n, pixels, step)
    for t in range(n + pixels - 1):
        r = np.arange(max(0, t - pixels + 1), min(n, t + 1))
        x = t - r
        left, up, corner = done[r + 1, x], done[r, x + 1], done[r, x]
        to_left, to_up, to_corner = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        nearest = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
        guess = np.choose(kinds[r][:, None], [np.zeros_like(left), left, up, (left + up) // 2, nearest])
        done[r + 1, x + 1] = (done[r + 1, x + 1] + guess) & 255
    return done[1:, 1:].reshape(n, pixels * step).astype(np.uint8)


def unfilter(lines: np.ndarray, step: int = 1) -> np.ndarray:
    """Rows of samples from filtered rows, whose first byte names the filter; step is bytes a pixel. Runs of rows of one filter go at once, and diagonals do if a row looks both left and up."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown PNG row filter")
    if kinds.max(initial=0) > 2:
        return _undo_diagonals(kinds, out, step)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(kinds)) + 1, [len(kinds)]])
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        if kinds[a] == 1:
            for c in range(step):
                out[a:b, c::step] = np.cumsum(out[a:b, c::step], axis=1, dtype=np.uint8)
        elif kinds[a] == 2:
            if a:
                out[a] += out[a - 1]
            out[a:b] = np.cumsum(out[a:b], axis=0, dtype=np.uint8)
    return out


def read_png(media: bytes) -> np.ndarray:
    """Samples of an 8-bit, not interlaced PNG, rows by bytes; ValueError if a checksum or the structure is wrong."""
    if media[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, parts, ended = 8, None, [], False
    while at < len(media):
        if at + 8 > len(media):
            raise ValueError("a PNG chunk is cut")
        size, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + size]
        if at + 12 + size > len(media) or struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"PNG chunk {kind!r} is cut or its CRC is wrong")
        at += 12 + size
        if kind == b"IHDR" and size == 13:
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            ended = True
            break
    if head is None or not ended or head[2] != 8 or head[3] not in (0, 2, 4, 6) or head[6]:
        raise ValueError("no 8-bit, not interlaced PNG")
    step = {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    try:
        data = zlib.decompress(b"".join(parts))
    except zlib.error as e:
        raise ValueError(f"PNG data: {e}") from e
    if len(data) != head[1] * (1 + head[0] * step):
        raise ValueError("PNG data have a wrong size")
    return unfilter(np.frombuffer(data, np.uint8).reshape(head[1], -1), step)


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest cosine frequencies of the image, shrunk to 32 x 32 by means, lie above their median; the mean itself is left out."""
    grid = samples
    for axis in (0, 1):
        n = grid.shape[axis]
        cuts = np.arange(GRID) * n // GRID
        counts = np.maximum(1, np.diff(np.append(cuts, n)))
        grid = np.add.reduceat(grid, cuts, axis=axis, dtype=np.float64) / (counts[:, None] if axis == 0 else counts)
    low = np.round(_COSINE @ grid @ _COSINE.T, 6).ravel()
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes()


def encode_png(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes (of the text in UTF-8) and the binary column media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                raw = [(x or "").encode() for x in b.column("text").to_pylist()]
                media = [write_png(x + b" " * (-len(x) % width if x else width), width) for x in raw]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ENCODED)


def png_features(media: DataFrame) -> DataFrame:
    """Reads the binary column of encode_png and returns sizes, checksums and hashes of what it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "media"):
                rows = []
                for m in b.column("media").to_pylist():
                    samples = read_png(m)
                    payload, key = samples.tobytes(), cosine_hash(samples)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(m), hashlib.sha256(m).hexdigest(), key.hex(), key))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
                columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *columns], [x.split()[0] for x in FEATURES.split(", ")])

    return media.mapInArrow(run, FEATURES)
