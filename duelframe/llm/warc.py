"""Web archives: ARC files of both versions converted into equivalent WARC files.

ARC is the older format: a version block, then for each document one line of fields
set by that version and as many bytes as the line declares. The converter reads these
lines and lengths, never the content, to find the next record, and synthesises what
WARC asks for beyond them: record identifiers, timestamps, types, and digests, by which
equal payloads become ``revisit`` records of the first of them.

Archives are written by Spark's text source, one row for each archive of bounded size,
and read by its binary source; so any file system Spark reaches will do, and a lost
task is simply run again. Every archive is one gzip file.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from duelframe.layout import c
from duelframe.llm.texts import whole
from duelframe.session import discard, materialised

#: Fields of an ARC header line by version.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
#: Fixed values of WARC records.
WARC_VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payloads below this many bytes are stored each time.
MIN_REVISIT = 100
#: An archive is closed once it has this many bytes before compression.
ARCHIVE_BYTES = 32 << 20
#: Digests of more than one record in this many are so few that they are sent to every task.
HOT_SHARE = 1_000
#: Date of pages that come without one.
FETCHED = "20000101000000"

_KEY = "X-Record-Key"
_LENGTH = "X-Payload-Length"
_SENT_BYTES = 8 << 20


class Record(NamedTuple):
    """One document of an ARC file; ``status`` is null where the version has none."""

    offset: int
    version: int
    url: str
    ip: str
    date: str
    mime: str
    status: str | None
    block: bytes


# --------------------------------------------------------------------------- formats


def opened(content: bytes) -> BinaryIO:
    """Stream over an archive, compressed (as one gzip member or many) or not."""
    plain = io.BytesIO(content)
    return gzip.GzipFile(fileobj=plain) if content[:2] == b"\x1f\x8b" else plain  # type: ignore[return-value]


def _block(stream: BinaryIO, header: bytes, length: int) -> bytes:
    data = stream.read(length)
    if length < 0 or len(data) < length:
        raise ValueError(f"archive ends inside the record {header[:200]!r}")
    return data


def arc_records(stream: BinaryIO) -> Iterator[Record]:
    """Documents of an ARC stream by their declared lengths; version blocks set how the lines after them are read.

    An url may hold blanks: fields are taken from the end of the line.
    """
    version, at = None, 0
    while line := stream.readline():
        start, at = at, at + len(line)
        header = line.rstrip(b"\r\n")
        if not header:
            continue
        if header.startswith(b"filedesc:"):
            block = _block(stream, header, int(header.rsplit(b" ", 1)[1]))
            version = int(block.split(None, 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {version}")
        elif version is None:
            raise ValueError(f"no version block before the record {header[:200]!r}")
        else:
            names = ARC_FIELDS[version]
            values = header.decode("utf-8", "replace").rsplit(" ", len(names) - 1)
            if len(values) != len(names):
                raise ValueError(f"not a header line of ARC version {version}: {header[:200]!r}")
            field = dict(zip(names, values))
            block = _block(stream, header, int(field["Archive-length"]))
            yield Record(start, version, field["URL"], field["IP-address"], field["Archive-date"], field["Content-type"], field.get("Result-code"), block)
        at += len(block)


def version_block(version: int, name: str, date: str) -> bytes:
    """First record of an ARC file, closing line break included."""
    body = f"{version} 0 duelframe\n{' '.join(ARC_FIELDS[version])}\n"
    more = f" 200 - - 0 {name}" if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{more} {len(body)}\n{body}\n".encode()


def http_split(block: bytes) -> tuple[bytes, bytes]:
    """Head (closing blank line included) and payload of an HTTP response; anything else is payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    end = block.find(b"\r\n\r\n")
    return (block, b"") if end < 0 else (block[: end + 4], block[end + 4 :])


def warc_records(stream: BinaryIO) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, fields by lower-case name, block) of a WARC stream, by declared lengths."""
    at = 0
    while line := stream.readline():
        start, at = at, at + len(line)
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a WARC record: {line[:200]!r}")
        fields: dict[str, str] = {}
        while (field := stream.readline()).strip():
            at += len(field)
            name, _, value = field.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        at += len(field)
        block = _block(stream, line, int(fields["content-length"]))
        at += len(block)
        yield start, fields, block


def iso_date(date: str) -> str:
    """WARC's timestamp of an ARC date of 4 to 14 digits; missing places are the earliest."""
    full = date + "00000101000000"[len(date) :]
    return datetime.strptime(full[:14], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")


def record_id(key: int | None, archive: str, offset: int) -> str:
    """Identifier (UUID of version 8) that holds the key and, so that it is unique, a hash of the record's place."""
    place = int.from_bytes(hashlib.sha256(f"{offset}:{archive}".encode()).digest()[:8], "big") >> 7
    bits = ((key or 0) & (1 << 64) - 1) << 58 | (key is None) << 57 | place
    return f"urn:uuid:{uuid.UUID(int=(bits >> 74) << 80 | 8 << 76 | (bits >> 62 & 0xFFF) << 64 | 2 << 62 | bits & (1 << 62) - 1)}"


def key_of(identifier: str | None) -> int | None:
    """The key a ``record_id`` holds; null for other identifiers."""
    if identifier is None:
        return None
    number = uuid.UUID(identifier.strip("<>").removeprefix("urn:uuid:")).int
    if number >> 76 & 0xF != 8:
        return None
    bits = (number >> 80) << 74 | (number >> 64 & 0xFFF) << 62 | number & (1 << 62) - 1
    key = bits >> 58
    return None if bits >> 57 & 1 else key - (key >> 63 << 64)


def _warc(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [WARC_VERSION, *(f"{n}: {v}" for n, v in fields if v is not None), f"Content-Length: {len(block)}", "", ""]
    return b"".join(["\r\n".join(lines).encode(), block, b"\r\n\r\n"])


def _target(url: str | None) -> str:
    """An url as one field of a header line: white space and control characters are percent-encoded, none is ``-``."""
    if not url:
        return "-"
    return "".join("".join(f"%{b:02X}" for b in ch.encode()) if ch.isspace() or ord(ch) < 32 or 127 <= ord(ch) < 160 else ch for ch in url)


# --------------------------------------------------------------------------- archives as rows


def _archives(first: Callable[[str, int], bytes], suffix: str, size: int, rows: Iterator[Callable[[str, int, int], bytes]]) -> Iterator[pa.RecordBatch]:
    """Rows of one archive each. A record is made by (archive name, archive number, offset); a line break ends every row when it is written."""
    part = TaskContext.get().partitionId()
    number, held, length = 0, [], 0
    for make in rows:
        name = f"part-{part:06d}-{number:06d}.{suffix}"
        if not held:
            held = [first(name, number)]
            length = len(held[0])
        held.append(make(name, number, length))
        length += len(held[-1])
        if length >= size:
            yield _row(held)
            number, held, length = number + 1, [], 0
    if held:
        yield _row(held)


def _row(held: list[bytes]) -> pa.RecordBatch:
    data = b"".join(held)
    return pa.RecordBatch.from_arrays([pa.array([data[: len(data) - 1]], pa.binary()).cast(pa.string())], ["value"])


def _write(rows: DataFrame, path: str) -> None:
    fast = rows.write.mode("overwrite").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
    fast.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _sent(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of bounded size; the last column is the one that can be large."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 256 + len(row[-1] or b"")
        if size >= _SENT_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*held), schema)], schema=schema)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, BinaryIO]]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield path, opened(content.as_buffer().to_pybytes())


# --------------------------------------------------------------------------- ARC


def write_arc(
    pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", date: str = FETCHED, archive_bytes: int = ARCHIVE_BYTES
) -> None:
    """One document per row, an HTTP response with the payload in UTF-8; archives of a task alternate between the two versions.

    A null payload counts as empty; a null or empty url is written ``-``, in others white space
    and control characters are percent-encoded. Keys are whole numbers or null; repeated rows
    give repeated documents, and a payload beyond ``archive_bytes`` an archive of its own size.
    An empty table gives archives without documents. Other columns are not looked at.
    """
    rows = pages.select(c(key).cast("long").alias("k"), c(url).cast("string").alias("u"), whole(payload).cast("binary").alias("p"))

    def document(k: int | None, u: str | None, p: bytes) -> Callable[[str, int, int], bytes]:
        def make(name: str, number: int, offset: int) -> bytes:
            own = f"{_KEY}: {k}\r\n" if k is not None else ""
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(p)}\r\n\r\n".encode()
            more = f" 200 - - {offset} {name}" if number % 2 else ""
            return b"".join([f"{_target(u)} 0.0.0.0 {date} text/html{more} {len(head) + len(p)}\n".encode(), head, p, b"\n"])

        return make

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = (document(*[v.as_py() for v in row]) for batch in batches for row in zip(*batch.columns))
        return _archives(lambda name, number: version_block(1 + number % 2, name, date), "arc", archive_bytes, made)

    _write(rows.mapInArrow(run, "value string"), path)


_ARC_SCHEMA = "archive string, offset long, version int, url string, ip string, date string, mime string, status string, http boolean, key long, payload_bytes long, digest string, block binary"


def read_arc(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """One row per document of the ARC files below ``path``; ``block`` is null without ``blocks``.

    ``http`` tells whether it is an HTTP response. ``digest`` and ``payload_bytes`` are those of the payload: what follows the head of an HTTP
    response, or the whole block. A malformed header line or a truncated document is an error.
    """
    schema = _arrow(spark, _ARC_SCHEMA)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for archive, stream in _scanned(batches):
            for r in arc_records(stream):
                head, payload = http_split(r.block)
                digest = hashlib.sha256(payload).hexdigest()
                yield archive, r.offset, r.version, r.url, r.ip, r.date, r.mime, r.status, bool(head), _own_key(head), len(payload), digest, r.block if blocks else None

    return _files(spark, path).mapInArrow(lambda batches: _sent(rows(batches), schema), _ARC_SCHEMA)


def _own_key(head: bytes) -> int | None:
    at = head.find(f"\r\n{_KEY}: ".encode())
    return None if at < 0 else int(head[at + len(_KEY) + 4 : head.index(b"\r\n", at + 2)])


def _arrow(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


# --------------------------------------------------------------------------- conversion


def revisits(ledger: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """``archive, offset, first``: records whose payload another record stores, and that record.

    Of equal payloads of at least ``min_bytes`` the record with the least key stores it, null
    keys last and equal keys by place. A digest that more than one record in ``HOT_SHARE``
    has, of which there are fewer than that, is looked up in a broadcast table; the rest are joined.
    """
    able = ledger.where(F.col("payload_bytes") >= min_bytes).select("digest", _ranked().alias("own"))
    groups = able.groupBy("digest").agg(F.min("own").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = materialised(groups)
    total = able.count()
    hot = groups.where(F.col("n") * HOT_SHARE > total).select("digest", F.col("first").alias("hot"))
    rest = groups.where(F.col("n") * HOT_SHARE <= total).select("digest", "first")
    looked = able.join(F.broadcast(hot), "digest", "left")
    found = looked.where("hot IS NOT NULL").select("own", F.col("hot").alias("first"))
    joined = looked.where("hot IS NULL").select("digest", "own").join(rest, "digest").select("own", "first")
    later = materialised(found.unionByName(joined).where("own.archive <> first.archive OR own.offset <> first.offset"))
    discard(groups)
    return later.select("own.archive", "own.offset", "first")


def _ranked() -> Column:
    return F.struct(F.col("key").isNull().alias("nameless"), "key", "archive", "offset", "url", "date")


def arc_to_warc(spark: SparkSession, arcs: str, warcs: str, min_bytes: int = MIN_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write the documents of the ARC files below ``arcs`` as WARC files below ``warcs``.

    An HTTP response becomes a ``response``, or a ``revisit`` without payload where another record
    stores it; any other document a ``resource``. Dates, urls, addresses and content types are taken over.
    """
    ledger = materialised(read_arc(spark, arcs, blocks=False).drop("block"))
    again = revisits(ledger.where("http"), min_bytes)
    joined = read_arc(spark, arcs).join(again, ["archive", "offset"], "left")
    names = ("archive", "offset", "url", "ip", "date", "mime", "http", "key", "payload_bytes", "digest")
    first = [F.col("first")[n].alias(f"first_{n}") for n in ("archive", "offset", "key", "url", "date")]
    rows = joined.select(*names, *first, "block")

    def record(r: dict) -> bytes:
        block, http, repeat = r["block"], r["http"], r["first_archive"] is not None
        if repeat:
            block = http_split(block)[0]
        fields = [
            ("WARC-Type", "revisit" if repeat else "response" if http else "resource"),
            ("WARC-Record-ID", f"<{record_id(r['key'], r['archive'], r['offset'])}>"),
            ("WARC-Date", iso_date(r["date"])),
            ("WARC-Target-URI", r["url"]),
            ("WARC-IP-Address", r["ip"]),
            ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
            ("WARC-Payload-Digest", f"sha256:{r['digest']}"),
            (_LENGTH, str(r["payload_bytes"])),
            ("Content-Type", "application/http;msgtype=response" if http else r["mime"]),
        ]
        if repeat:
            fields += [
                ("WARC-Profile", REVISIT_PROFILE),
                ("WARC-Refers-To", f"<{record_id(r['first_key'], r['first_archive'], r['first_offset'])}>"),
                ("WARC-Refers-To-Target-URI", r["first_url"]),
                ("WARC-Refers-To-Date", iso_date(r["first_date"])),
            ]
        return _warc(fields, block)

    def info(name: str, number: int) -> bytes:
        about = b"software: duelframe\r\nformat: WARC File Format 1.1\r\ndescription: converted from ARC\r\n"
        date = iso_date(FETCHED)
        own = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{record_id(None, name, -1)}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
        return _warc(own, about)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (dict(zip(b.schema.names, (v.as_py() for v in row))) for b in batches for row in zip(*b.columns))
        return _archives(info, "warc", archive_bytes, ((lambda name, number, offset, r=r: record(r)) for r in found))

    _write(rows.mapInArrow(run, "value string"), warcs)
    discard(ledger, again)


# --------------------------------------------------------------------------- WARC

_WARC_SCHEMA = (
    "archive string, offset long, record_id string, record_type string, target_uri string, date string, content_type string, "
    "payload_bytes long, payload_digest string, refers_to string, key long, refers_to_key long, block binary"
)


def read_warc(spark: SparkSession, path: str, blocks: bool = False) -> DataFrame:
    """One row per record of the WARC files below ``path``, ``warcinfo`` included.

    ``payload_bytes`` and ``payload_digest`` (bare SHA-256) are computed from a stored payload, and
    a digest the record gives must agree; a revisit, which has no payload, gives its own. ``key`` and
    ``refers_to_key`` are read from identifiers made by ``record_id`` and else null.
    """
    schema = _arrow(spark, _WARC_SCHEMA)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for archive, stream in _scanned(batches):
            for offset, f, block in warc_records(stream):
                kind, given = f["warc-type"], f.get("warc-payload-digest", "").partition(":")
                if kind == "revisit":
                    size, digest = f.get(_LENGTH.lower()), given[2] if given[0] == "sha256" else None
                else:
                    payload = http_split(block)[1] if kind == "response" else block
                    size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    if given[0] == "sha256" and given[2] != digest:
                        raise ValueError(f"payload of {f['warc-record-id']} does not have its digest")
                own, other = f["warc-record-id"], f.get("warc-refers-to")
                yield (
                    archive, offset, own.strip("<>"), kind, f.get("warc-target-uri"), f.get("warc-date"), f.get("content-type"),
                    None if size is None else int(size), digest, None if other is None else other.strip("<>"), key_of(own), key_of(other), block if blocks else None,
                )

    return _files(spark, path).mapInArrow(lambda batches: _sent(rows(batches), schema), _WARC_SCHEMA)
