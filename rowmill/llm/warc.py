"""WARC archives as a PySpark Python data source.

Writing: each record is a gzip member of its own whose extra field holds the member's compressed and plain sizes (the
`sl` subfield), so a reader can step over it. Tasks write files under names of their own, and the commit lists the
finished ones in a manifest; what lost or repeated tasks left is never read.

Reading: a path is an archive or a folder of them; without a manifest, as other tools leave it, all its `.warc` and `.warc.gz` files count. One
partition holds one or several whole files, by size. Predicates on the header columns are pushed down; a record's headers are
read first, and the rest only if the record passes and payloads are asked for: it is stepped over in plain files and in members that carry
their sizes, and inflated without being kept in other gzip files, whose members may hold one record or many.

All record types are returned. The payload of an HTTP response is what follows its HTTP headers, that of other records their whole
block, and a revisit has none. Records that this module wrote are checked against their digests. A missing header is null.

Option `payload` (true): whether payloads are returned. Paths are anything that pyarrow's filesystems open.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from .common import scratch, slices

NAME = "rowmill_warc"
SCHEMA = "record_id string, record_type string, target_uri string, warc_date string, payload_digest string, refers_to string, payload_length long, payload binary"
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "payload_length": "X-Payload-Length"}
FIELDS = [x.split()[0] for x in SCHEMA.split(", ")]
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(plain: bytes, level: int = 3) -> bytes:
    """plain as a gzip member with its sizes in the extra field."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(plain) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(plain) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


def record(headers: dict[str, str | None], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {' '.join(v.split())}" for k, v in headers.items() if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    """Names in lower case."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


class Stream:
    """Gzip members one after another from a file that can seek."""

    def __init__(self, file, size: int, chunk: int = 1 << 16):
        self.file, self.size, self.chunk, self.at = file, size, chunk, 0

    def records(self) -> Iterator[tuple[dict[str, str], Record]]:
        while self.at < self.size:
            rec = Record(self)
            yield rec.head, rec
            self.at = rec.end()


class Record:
    """A record whose headers have been read; `block` inflates the rest, `end` is where the next member begins."""

    def __init__(self, stream: Stream):
        self.stream, self.start = stream, stream.at
        self.inflate, self.plain, self.read = zlib.decompressobj(31), b"", 0
        first = self._more(min(stream.chunk, 2048))
        self.skip = 0
        if len(first) > 24 and first[3] & 4 and first[12:14] == b"sl":
            self.skip = struct.unpack_from("<I", first, 16)[0]
        while (cut := self.plain.find(b"\r\n\r\n")) < 0:
            if not self._more(stream.chunk):
                raise ValueError("a WARC record has no end of headers")
        self.head, self.body = parse_head(self.plain[:cut]), cut + 4

    def _more(self, n: int) -> bytes:
        if self.inflate.eof:
            return b""
        self.stream.file.seek(self.start + self.read)
        raw = self.stream.file.read(min(n, self.stream.size - self.start - self.read))
        self.read += len(raw)
        if raw:
            self.plain += self.inflate.decompress(raw)
        return raw

    def block(self) -> bytes:
        size, parts = int(self.head["content-length"]), [self.plain]
        have = len(self.plain)
        while have < self.body + size:
            self.plain = b""
            if not self._more(self.stream.chunk):
                raise ValueError("a WARC record is cut")
            parts.append(self.plain)
            have += len(self.plain)
        self.plain = b"".join(parts)
        return self.plain[self.body : self.body + size]

    def end(self) -> int:
        if self.skip:
            return self.start + self.skip
        while not self.inflate.eof:
            self.plain = b""
            if not self._more(self.stream.chunk):
                raise ValueError("a gzip member is cut")
        return self.start + self.read - len(self.inflate.unused_data)


class Flow:
    """An archive's plain bytes, forwards only: those of the file, or of its gzip members one after another."""

    def __init__(self, file, chunk: int = 1 << 16):
        self.file, self.chunk, self.held = file, chunk, b""
        file.seek(0)
        self.packed = file.read(2) == b"\x1f\x8b"
        file.seek(0)
        self.inflate, self.raw = zlib.decompressobj(31), b""

    def more(self) -> bytes:
        """The next bytes; none at the end."""
        if not self.packed:
            return self.file.read(self.chunk)
        while True:
            if not self.raw and not (raw := self.file.read(self.chunk)):
                return b""
            elif not self.raw:
                self.raw = raw
            plain = self.inflate.decompress(self.raw)
            self.raw = self.inflate.unused_data
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
                # what may fill the file's end is no member
                self.raw = self.raw.lstrip(b"\0")
            if plain:
                return plain

    def head(self) -> bytes | None:
        """The next record's headers, or None."""
        while (cut := self.held.find(b"\r\n\r\n", 0 if self.held[:1] not in b"\r\n" else len(self.held))) < 0:
            self.held = self.held.lstrip(b"\r\n")
            if self.held.find(b"\r\n\r\n") >= 0:
                continue
            if not (plain := self.more()):
                if self.held:
                    raise ValueError("a WARC record has no end of headers")
                return None
            self.held += plain
        out, self.held = self.held[:cut], self.held[cut + 4 :]
        return out

    def take(self, n: int, keep: bool = True) -> bytes:
        """The next n bytes; none of them if they need not be kept."""
        parts, have = [], 0
        while have < n:
            if not self.held:
                if not keep and not self.packed:
                    self.file.seek(n - have, 1)
                    return b""
                if not (plain := self.more()):
                    raise ValueError("a WARC record is cut")
                self.held = plain
            part, self.held = self.held[: n - have], self.held[n - have :]
            have += len(part)
            if keep:
                parts.append(part)
        return b"".join(parts)

    def records(self) -> Iterator[tuple[dict[str, str], Block]]:
        while (raw := self.head()) is not None:
            head = parse_head(raw)
            rest = Block(self, int(head.get("content-length", 0)))
            yield head, rest
            rest.end()


class Block:
    """What follows a record's headers."""

    def __init__(self, flow: Flow, size: int):
        self.flow, self.left = flow, size

    def block(self) -> bytes:
        n, self.left = self.left, 0
        return self.flow.take(n)

    def end(self) -> None:
        self.flow.take(self.left, keep=False)


def archive_records(file, size: int) -> Iterator[tuple[dict[str, str], Record | Block]]:
    """The records of an archive: with steps over members if they carry their sizes."""
    start = file.read(14)
    sized = len(start) == 14 and start[:2] == b"\x1f\x8b" and start[3] & 4 and start[12:14] == b"sl"
    return (Stream(file, size) if sized else Flow(file)).records()


def payload_of(head: dict[str, str], block: bytes) -> bytes | None:
    if head.get("warc-type") == "revisit":
        return None
    if head.get("warc-type") == "response" and head.get("content-type", "application/http").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


@dataclass
class Files(InputPartition):
    files: list


@dataclass
class Written(WriterCommitMessage):
    files: list


def archives(fs, root: str) -> list[tuple[str, int]]:
    """Paths and sizes of the archives at a path: the file, those of the manifest, or all that are named like archives."""
    if fs.get_file_info(root).type == pa.fs.FileType.File:
        return [(root, fs.get_file_info(root).size)]
    if fs.get_file_info(f"{root}/_manifest.json").type == pa.fs.FileType.File:
        with fs.open_input_stream(f"{root}/_manifest.json") as f:
            return [(f"{root}/{name}", size) for name, size in json.loads(f.read())]
    return [(x.path, x.size) for x in fs.get_file_info(pa.fs.FileSelector(root, recursive=True)) if x.type == pa.fs.FileType.File and x.path.endswith((".warc", ".warc.gz"))]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"], options.get("payload", "true").lower() != "false"
        self.together = int(options.get("partitionBytes", 64 << 20))
        self.wanted: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name not in HEADERS or name == "payload_length" or not isinstance(f, (EqualTo, In, IsNotNull, StringStartsWith)):
                yield f
            elif isinstance(f, StringStartsWith):
                self.wanted.append((name, "starts", f.value))
            elif isinstance(f, IsNotNull):
                self.wanted.append((name, "given", None))
            else:
                self.wanted.append((name, "in", tuple(f.value) if isinstance(f, In) else (f.value,)))

    def partitions(self) -> list[Files]:
        fs, root = pa.fs.FileSystem.from_uri(self.path)
        files = sorted(archives(fs, root), key=lambda x: (-x[1], x[0]))
        bins: list[tuple[int, list]] = []
        for name, size in files:
            if bins and bins[-1][0] + size <= self.together:
                bins[-1] = (bins[-1][0] + size, [*bins[-1][1], (name, size)])
            else:
                bins.append((size, [(name, size)]))
        return [Files(x) for _, x in bins] or [Files([])]

    def passes(self, head: dict[str, str]) -> bool:
        for name, how, value in self.wanted:
            x = head.get(HEADERS[name].lower())
            if x is None or how == "in" and x not in value or how == "starts" and not x.startswith(value):
                return False
        return True

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = pa.fs.FileSystem.from_uri(self.path)
        rows, held = [], 0
        for name, size in partition.files:
            with fs.open_input_file(name) as file:
                for head, rec in archive_records(file, size):
                    if not self.passes(head):
                        continue
                    own, payload = head.get("x-payload-length"), None
                    if self.payload and head.get("warc-type") != "revisit":
                        payload = payload_of(head, rec.block())
                        if own is not None and head["warc-type"] == "response" and head["warc-payload-digest"] != f"sha1:{digest32(payload)}":
                            raise ValueError(f"payload of {head['warc-record-id']} differs from its digest")
                    row = [head.get(h.lower()) for h in HEADERS.values()]
                    row[-1] = int(own) if own is not None else None if payload is None else len(payload)
                    rows.append((*row, payload))
                    held += len(payload or b"") + 200
                    if held > 4 << 20:
                        yield self.batch(rows)
                        rows, held = [], 0
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64() if n == "payload_length" else pa.binary() if n == "payload" else pa.string() for n in FIELDS]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], FIELDS)


class WarcWriter(DataSourceArrowWriter):
    """Rows of SCHEMA; a row's digest and length are computed if its payload is given, and else taken as they are."""

    def __init__(self, options: dict):
        self.path, self.rotate = options["path"], int(options.get("fileBytes", 256 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = pa.fs.FileSystem.from_uri(self.path)
        fs.create_dir(root)
        files, out, name, size = [], None, "", 0
        try:
            for row in (r for batch in iterator for part in slices(batch, "payload") for r in part.to_pylist()):
                if out is None:
                    name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                size += out.write(data := member(self.encode(row))) or len(data)
                if size >= self.rotate:
                    out.close()
                    files.append((name, size))
                    out = None
        finally:
            if out is not None:
                out.close()
                files.append((name, size))
        return Written(files)

    @staticmethod
    def encode(row: dict) -> bytes:
        payload, digest, length = row["payload"], row["payload_digest"], row["payload_length"]
        if payload is not None:
            digest, length = digest32(payload), len(payload)
        revisit = row["record_type"] == "revisit"
        headers = {h: row.get(n) for n, h in HEADERS.items()} | {
            "WARC-Payload-Digest": f"sha1:{digest}", "X-Payload-Length": str(length), "Content-Type": "application/http;msgtype=response",
            "WARC-Profile": PROFILE if revisit else None,
        }
        return record(headers, HTTP if revisit else HTTP + (payload or b""))

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = pa.fs.FileSystem.from_uri(self.path)
        fs.create_dir(root)
        with fs.open_output_stream(f"{root}/_manifest.json") as f:
            f.write(json.dumps([x for m in messages if m for x in m.files]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = pa.fs.FileSystem.from_uri(self.path)
        for m in messages:
            for name, _ in m.files if m else ():
                fs.delete_file(f"{root}/{name}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, sha1 and refers_to of the rows whose payload a row with a smaller page_id has too."""
    keys = pages.select("page_id", "sha1", "payload_length").filter(F.col("payload_length") >= min_bytes)
    first = keys.groupBy("sha1", "payload_length").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1 and refers_to is not null").drop("n")
    return keys.join(first, ["sha1", "payload_length"]).filter("page_id is null or page_id > refers_to").select(F.col("page_id").alias("copy_id"), F.col("sha1").alias("copy_sha1"), "refers_to").distinct()


def write_pages(pages: DataFrame, path: str, min_bytes: int = 0, id_col: str = "page_id", uri_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> None:
    """A response or revisit record for each row.

    Defined results: a null payload is an empty one; of equal payloads of at least min_bytes bytes the rows with the
    smallest id are responses (all of them, if that id is repeated), and null ids count as larger than any other;
    without any id, all are responses. Only digests, aggregated first, are grouped by payload; the payloads
    themselves are joined by (id, digest), so a payload with very many copies makes no large group."""
    register(pages.sparkSession)
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(uri_col).alias("target_uri"), html.alias("html")).withColumns({"sha1": F.unhex(F.sha1("html")), "payload_length": F.octet_length("html").cast("long")})
    copies = revisits(rows, min_bytes)
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    joined = rows.join(copies, F.col("page_id").eqNullSafe(F.col("copy_id")) & (F.col("sha1") == F.col("copy_sha1")), "left")
    again = F.col("refers_to").isNotNull()
    # a revisit keeps no payload, so its digest goes along; base 32 is made by the writer for payloads, and here from the digest
    records = joined.select(
        F.coalesce(urn(F.col("page_id")), F.lit("<urn:page:>")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), "target_uri", F.lit(date).alias("warc_date"),
        base32(F.col("sha1")).alias("payload_digest"), urn(F.col("refers_to")).alias("refers_to"), "payload_length", F.when(~again, F.encode("html", "UTF-8")).alias("payload"),
    )
    records.write.format(NAME).mode("append").save(path)


def base32(sha1):
    """Upper-case base 32 of 20 bytes: each 5 bytes are 8 digits of 5 bits."""
    digits, out = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), []
    for k in range(4):
        n = F.conv(F.hex(F.substring(sha1, 5 * k + 1, 5)), 16, 10).cast("long")
        out += [F.substring(digits, (F.shiftright(n, 35 - 5 * j).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for j in range(8)]
    return F.concat(*out)


def read_pages(spark, path: str, payload: bool = True) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of the archives' records."""
    register(spark)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    rows = spark.read.format(NAME).option("payload", str(payload).lower()).load(path)
    return rows.select(
        F.nullif(number("record_id"), F.lit("")).cast("long").alias("page_id"), F.coalesce(F.octet_length("payload").cast("long"), "payload_length").alias("payload_bytes"),
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type", F.nullif(number("refers_to"), F.lit("")).cast("long").alias("refers_to"),
    )


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the pages to archives at path (a new one if None) and returns what is read back."""
    path = path or scratch(pages.sparkSession, "warc")
    write_pages(pages, path)
    return read_pages(pages.sparkSession, path)
