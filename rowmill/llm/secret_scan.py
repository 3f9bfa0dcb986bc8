"""Secret scans: base patterns, and key material that is reported only after its structure has been read.

Base kinds: `assign`, `access` and `hex`, leftmost and non-overlapping per kind. Structural kinds: wherever a run of base64 (in
either alphabet, also wrapped over lines or with `\\n` written out) or of hexadecimal digits may begin a key, its headers are decoded and must parse
as a private key, either in nested tag-length-value form (`der`: RSA, DSA, a curve's, PKCS#8, plain or encrypted) or in the
length-prefixed form of OpenSSH (`openssh`). All lengths must fit one another and the run. Armoured keys (`pem`) must hold one of
these, or name their cipher and hold whole blocks of it. A token of three dotted parts (`jwt`) must have a header and
a claim set that are JSON objects, the header with an algorithm.

Only lengths and tags are decoded, as far as they fit, so the time is linear in the text.

Defined results: null and empty texts have no spans; spans are in code points, end exclusive, ordered by start and
then by kind as listed in KINDS; repeated rows give equal rows; null ids pass through; other columns are not carried.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts

KINDS = ("assign", "access", "hex", "pem", "der", "openssh", "jwt")
_RANK = {k: i for i, k in enumerate(KINDS)}


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" for c in word)


_ASSIGN = re.compile(f"(?:{'|'.join(map(_any_case, ('password', 'passwd', 'secret', 'token')))}|{_any_case('api')}_?{_any_case('key')})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----((?:[^-]|-(?!----))*+)-----END \1-----")
_END = r"(?:\r?\n|(?:\\r)?\\n)"
_B64 = re.compile(rf"[A-Za-z0-9+/_-]{{48,}}(?:{_END}[A-Za-z0-9+/_-]+)*={{0,2}}")
_LINE_END = re.compile(_END)
_HEXKEY = re.compile(r"[0-9A-Fa-f]{64,}")
#: What may begin a key: a sequence's tag and length, or the OpenSSH magic.
_MAGIC = b"openssh-key-v1\0"
_B64_START = re.compile(r"M(?=[A-P])|b3BlbnNzaC1rZXktdjE(?=[AB])")
_HEX_START = re.compile(r"30(?=[0-7][0-9a-fA-F]|8[1-4])|(?=6[fF]70656[eE]7373682[dD]6)")
_DOTTED = re.compile(r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_.-]++")

SPANS = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_structural long"


#: Bytes from a place on, as many as asked for or as there are.
Read = Callable[[int, int], bytes]


def der_header(read: Read, at: int) -> tuple[int, int, int] | None:
    """Tag, first byte and end of the value at a place; None if it has no definite length."""
    head = read(at, 6)
    if len(head) < 2:
        return None
    size, n = head[1], 0
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or len(head) < 2 + n:
            return None
        size = int.from_bytes(head[2 : 2 + n], "big")
    return head[0], at + 2 + n, at + 2 + n + size


def der_values(read: Read, at: int, end: int, depth: int = 8, left: list[int] | None = None) -> list[tuple[int, int, int, list]] | None:
    """(tag, first byte, end, inner values) of the values that fill at .. end exactly; None if a length does not fit, or if there are more than a key has."""
    out: list = []
    left = [256] if left is None else left
    while at < end:
        head = der_header(read, at)
        left[0] -= 1
        if head is None or head[2] > end or left[0] < 0:
            return None
        tag, body, at = head
        inner: list | None = []
        if tag & 0x20:
            inner = der_values(read, body, at, depth - 1, left) if depth else None
            if inner is None:
                return None
        out.append((tag, body, at, inner))
    return out


#: Object identifiers of password-based encryption: PKCS#5 and PKCS#12.
_PBE = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def der_key(read: Read, size: int) -> int | None:
    """The end of a private key at the beginning of `size` bytes: a sequence of RSA's nine or DSA's six integers, of a version, a named
    algorithm and octets, of a curve's version and scalar, or of a password-based cipher and octets."""
    top = der_header(read, 0)
    if top is None or top[0] != 0x30 or not 16 <= top[2] <= size:
        return None
    # what a key begins with, before anything else is decoded
    first = der_header(read, top[1])
    if first is None or first[0] not in (0x02, 0x30) or first[2] >= top[2] or (first[0] == 0x02 and first[2] - first[1] != 1):
        return None
    parts = der_values(read, top[1], top[2])
    if parts is None or len(parts) < 2:
        return None
    tags = [x[0] for x in parts]
    length = lambda x: x[2] - x[1]
    if tags[0] == 0x30:
        named = parts[0][3]
        cipher = bool(named) and named[0][0] == 0x06 and read(named[0][1], length(named[0])).startswith(_PBE)
        return top[2] if cipher and tags[1:] == [0x04] and length(parts[1]) >= 16 else None
    rsa, dsa = len(parts) >= 9 and tags[:9] == [0x02] * 9, tags == [0x02] * 6
    wrapped = tags[1:3] == [0x30, 0x04] and bool(parts[1][3]) and parts[1][3][0][0] == 0x06
    curve = tags[1] == 0x04 and read(parts[0][1], 1) == b"\x01" and 20 <= length(parts[1]) <= 72
    return top[2] if rsa or dsa or wrapped or curve else None


def openssh_key(read: Read, size: int) -> int | None:
    """The end of an OpenSSH key: the magic, then length-prefixed cipher, kdf, options, a count of keys and as many keys, and a private part."""
    at = len(_MAGIC)
    if read(0, at) != _MAGIC:
        return None

    def field() -> int | None:
        nonlocal at
        n = read(at, 4)
        at += 4 + int.from_bytes(n, "big")
        return at if len(n) == 4 and at <= size else None

    if any(field() is None for _ in range(3)):
        return None
    count = read(at, 4)
    at += 4
    if len(count) < 4 or not 1 <= int.from_bytes(count, "big") <= 64 or at > size:
        return None
    for _ in range(int.from_bytes(count, "big") + 1):
        before = at
        if field() is None or at == before + 4:
            return None
    return at


def key_at(read: Read, size: int) -> tuple[int, str] | None:
    """End and kind of the key that begins `size` bytes."""
    if end := der_key(read, size):
        return end, "der"
    return (end, "openssh") if (end := openssh_key(read, size)) else None


def hex_reader(run: str, start: int) -> Read:
    return lambda at, n: bytes.fromhex(run[start + 2 * at : start + 2 * (at + n)][: (len(run) - start - 2 * at) // 2 * 2])


def base64_reader(run: str, start: int) -> Read:
    def read(at: int, n: int) -> bytes:
        a = start + at // 3 * 4
        return (decode64(run[a : a + -(-(at % 3 + n) // 3) * 4]) or b"")[at % 3 : at % 3 + n]

    return read


def keys_in(run: str, starts: re.Pattern, reader: Callable[[str, int], Read], chars: Callable[[int], int], size: Callable[[int], int]) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of the keys in a run of digits; chars(bytes) of them hold so many bytes, and size(chars) the other way round."""
    at = 0
    while m := starts.search(run, at):
        at = m.start() + 1
        if found := key_at(reader(run, m.start()), size(len(run) - m.start())):
            at = m.start() + chars(found[0])
            yield m.start(), at, found[1]


def decode64(text: str) -> bytes | None:
    """Base64 in either alphabet, with or without padding; None if it is none."""
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_armoured_key(body: str) -> bool:
    """Whether what stands between a key's armour lines is a key, or is encrypted as its header lines say."""
    lines = [x.strip() for x in re.split(r"\n|\\n", body.replace("\\r", ""))]
    heads = [x for x in lines if ":" in x]
    data = decode64("".join("".join(x.split()) for x in lines if ":" not in x))
    if data is None:
        return False
    if any("ENCRYPTED" in x for x in heads) and any(x.startswith("DEK-Info:") for x in heads):
        return len(data) >= 16 and len(data) % 8 == 0
    found = key_at(lambda at, n: data[at : at + n], len(data))
    return found is not None and found[0] == len(data)


def _object(part: str) -> dict | None:
    try:
        value = json.loads(decode64(part) or b"")
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def find_secrets(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each secret, by start and kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    armoured = [m.span() for m in _PEM.finditer(text) if is_armoured_key(m[2])] if "PRIVATE KEY-----" in text else []
    found += [(*x, "pem") for x in armoured]
    for m in _B64.finditer(text):
        if any(a <= m.start() < b for a, b in armoured):
            continue
        # the run without its line ends: where each line ends in it, and how far it stands from there in the text
        pieces, ends, shifts, at = [], [0], [], 0
        whole = m[0]
        for e in [*_LINE_END.finditer(whole), None]:
            pieces.append(whole[at : e.start() if e else None])
            shifts.append(m.start() + at - ends[-1])
            ends.append(ends[-1] + len(pieces[-1]))
            at = e.end() if e else at
        run = "".join(pieces).rstrip("=")
        for a, b, kind in keys_in(run, _B64_START, base64_reader, lambda n: -(-4 * n // 3), lambda c: 3 * c // 4):
            a, b = (x + shifts[bisect_right(ends, x) - 1] for x in (a, b - 1))
            padding = re.match("=*", text[b + 1 : b + 3])[0]
            found.append((a, b + 1 + len(padding), kind))
    for m in _HEXKEY.finditer(text):
        found += [(m.start() + a, m.start() + b, kind) for a, b, kind in keys_in(m[0], _HEX_START, hex_reader, lambda n: 2 * n, lambda c: c // 2)]
    if "eyJ" in text:
        for m in _DOTTED.finditer(text):
            found += [(m.start() + a, m.start() + b, "jwt") for a, b in signed_tokens(m[0])]
    return sorted(found, key=lambda x: (x[0], _RANK[x[2]], x[1]))


def signed_tokens(run: str) -> Iterator[tuple[int, int]]:
    """Where in a run of dotted parts three of them are a token; a header begins at the first `eyJ` of its part."""
    parts = run.split(".")
    if len(parts) < 3:
        return
    starts = [0]
    for x in parts:
        starts.append(starts[-1] + len(x) + 1)
    i = 0
    while i + 2 < len(parts):
        skip = parts[i].find("eyJ")
        if skip >= 0 and parts[i + 1] and isinstance((_object(parts[i][skip:]) or {}).get("alg"), str) and _object(parts[i + 1]) is not None:
            yield starts[i] + skip, starts[i + 3] - 1
            i += 2
        i += 1


def redact(text: str, found: list[tuple[int, int, str]], mask: str = "[SECRET]") -> str:
    """text with each run of overlapping spans replaced by the mask."""
    out, at = [], 0
    for a, b, _ in found:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mask]
        at = b
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts per base kind, the digest of the base spans and all spans of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                rows = []
                for t in texts(b.column("text")):
                    found = find_secrets(t)
                    shown = [f"{k}:{a}:{e}" for a, e, k in found]
                    base = [s for s, (_, _, k) in zip(shown, found, strict=True) if k in KINDS[:3]]
                    count = [sum(x[2] == k for x in found) for k in KINDS[:3]]
                    rows.append((*count, hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(shown), len(found) - len(base)))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], [x.split()[0] for x in SPANS.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SPANS)


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mask: str = "[SECRET]") -> DataFrame:
    """docs, all columns kept, with every secret in the text masked and the length column, if there is one, brought up to date. A null text stays null."""
    counted = length_col is not None and length_col in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, text_col):
                old = b.column(text_col).to_pylist()
                new = [t if t is None or not (f := find_secrets(t)) else redact(t, f, mask) for t in old]
                columns = {n: b.column(n) for n in b.schema.names}
                columns[text_col] = pa.array(new, b.schema.field(text_col).type)
                if counted:
                    kept = b.column(length_col).to_pylist()
                    columns[length_col] = pa.array([len(n) if n != o else k for o, n, k in zip(old, new, kept, strict=True)], b.schema.field(length_col).type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
