"""Archives against hand-written files, a dictionary of payloads, and the way back."""

import gzip
import hashlib
import io
import random

import pytest
from hypothesis import given, strategies as st

from duelframe.llm import warc
from duelframe.session import shared_folder

FAKE = b"\nhttp://fake/ 1.2.3.4 20200101000000 text/html 5\nWARC/1.1\r\n\r\nhello"


def http(payload, more=b""):
    return b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n" + more + b"\r\n" + payload


def arc(version, documents):
    """An archive put together by hand; documents are (url, date, mime, block)."""
    fields = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}[version]
    body = f"{version} 0 Someone\n{fields}\n".encode()
    more = b" 200 - - 0 x.arc" if version == 2 else b""
    out = b"filedesc://x.arc 0.0.0.0 19990101000000 text/plain" + more + b" %d\n" % len(body) + body + b"\n"
    for url, date, mime, block in documents:
        more = b" 404 abc - 77 x.arc" if version == 2 else b""
        out += b"%s 10.0.0.1 %s %s%s %d\n%s\n" % (url, date, mime, more, len(block), block)
    return out


@pytest.mark.parametrize("version", [1, 2])
def test_header_lines_of_either_version(version):
    documents = [
        (b"http://a.org/x y", b"20010203040506", b"text/html", http(FAKE)),
        (b"dns:a.org", b"2001", b"text/dns", b"20010101\na.org. 1 IN A 10.0.0.1\n"),
        (b"http://a.org/empty", b"200102", b"no-type", b""),
        (b"http://a.org/breaks", b"20010203", b"text/html", http(b"\n\n\n")),
    ]
    data = arc(version, documents)
    found = list(warc.arc_records(io.BytesIO(data)))
    assert [(r.url.encode(), r.date.encode(), r.mime.encode(), r.block) for r in found] == documents
    assert {(r.version, r.ip, r.status) for r in found} == {(version, "10.0.0.1", "404" if version == 2 else None)}
    assert all(data[r.offset :].startswith(r.url.encode()) for r in found)
    members = b"".join(gzip.compress(data[i : i + 100]) for i in range(0, len(data), 100))
    assert list(warc.arc_records(warc.opened(members))) == found
    both = data + arc(3 - version, documents)
    assert [r.version for r in warc.arc_records(io.BytesIO(both))] == [version] * 4 + [3 - version] * 4


def test_malformed_archives():
    good = arc(1, [(b"http://a/", b"2001", b"text/html", b"abcdef")])
    for bad, message in [
        (good[:-4], "ends inside"), (good.replace(b"text/html 6", b"6"), "header line"), (good[good.index(b"http://a/") :], "no version block"), (good.replace(b"1 0 Some", b"9 0 Some"), "unknown ARC version"),
    ]:
        with pytest.raises(ValueError, match=message):
            list(warc.arc_records(io.BytesIO(bad)))
    with pytest.raises(ValueError, match="not the start"):
        list(warc.warc_records(io.BytesIO(b"nonsense\r\n")))


def test_dates():
    assert warc.iso_date("20010203040506") == "2001-02-03T04:05:06Z"
    assert warc.iso_date("2001") == "2001-01-01T00:00:00Z" and warc.iso_date("200102030405") == "2001-02-03T04:05:00Z"


@given(st.none() | st.integers(-(2**63), 2**63 - 1), st.text(max_size=5), st.integers(0, 2**40))
def test_identifiers_hold_their_key(key, archive, offset):
    identifier = warc.record_id(key, archive, offset)
    assert warc.key_of(f"<{identifier}>") == key
    assert identifier[23] == "8" and identifier[28] in "89ab" and len(identifier) == 45
    assert warc.record_id(key, archive, offset + 1) != identifier


def test_foreign_identifiers():
    assert warc.key_of(None) is None and warc.key_of("<urn:uuid:92283950-ef2f-4d72-b224-f54c6ec90bb0>") is None


def test_conversion_of_foreign_files(spark, tmp_path):
    long = b"x" * 150
    first = arc(1, [(b"http://a/1", b"20010101", b"text/html", http(long)), (b"dns:a", b"20010102", b"text/dns", long), (b"http://a/2", b"20010103", b"text/html", http(FAKE * 3, b"Server: s\r\n"))])
    second = arc(2, [(b"http://b/1", b"20020101", b"text/html", http(long, b"Server: t\r\n")), (b"http://b/2", b"20020102", b"text/html", b"HTTP/1.1 204 none")])
    folder = tmp_path / "arcs"
    folder.mkdir()
    (folder / "a.arc").write_bytes(first)
    (folder / "b.arc.gz").write_bytes(gzip.compress(second))
    out = shared_folder(spark)
    warc.arc_to_warc(spark, str(folder), out)
    rows = {r["target_uri"]: r for r in warc.read_warc(spark, out, blocks=True).where("record_type <> 'warcinfo'").collect()}
    assert {u: (r["record_type"], r["date"], r["content_type"], r["block"]) for u, r in rows.items()} == {
        "http://a/1": ("response", "2001-01-01T00:00:00Z", "application/http;msgtype=response", bytearray(http(long))),
        "dns:a": ("resource", "2001-01-02T00:00:00Z", "text/dns", bytearray(long)),
        "http://a/2": ("response", "2001-01-03T00:00:00Z", "application/http;msgtype=response", bytearray(http(FAKE * 3, b"Server: s\r\n"))),
        "http://b/1": ("revisit", "2002-01-01T00:00:00Z", "application/http;msgtype=response", bytearray(http(b"", b"Server: t\r\n"))),
        "http://b/2": ("response", "2002-01-02T00:00:00Z", "application/http;msgtype=response", bytearray(b"HTTP/1.1 204 none")),
    }
    assert rows["http://b/1"]["refers_to"] == rows["http://a/1"]["record_id"]
    digest = hashlib.sha256(long).hexdigest()
    assert {rows[u]["payload_digest"] for u in ("http://a/1", "dns:a", "http://b/1")} == {digest}
    assert rows["http://b/1"]["payload_bytes"] == 150 and rows["http://b/2"]["payload_bytes"] == 0
    assert len({r["record_id"] for r in rows.values()}) == 5
    raw = gzip.decompress(b"".join(r["content"] for r in spark.read.format("binaryFile").load(out).orderBy("path").collect()))
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and raw.endswith(b"\r\n\r\n")


MESSY = [
    (1, None, None), (2, "", ""), (3, "http://a b\n/c d", "x" * 99), (4, "http://a/", "x" * 99), (5, None, "é" * 50), (6, "u", "é" * 50), (-7, "u", "é" * 50),
    (8, "http://a/", FAKE.decode() * 9), (8, "http://a/", FAKE.decode() * 9), (None, "http://n/", FAKE.decode() * 9), (None, "n", "only nameless" * 20), (None, "n", "only nameless" * 20),
    (2**63 - 1, "u", "long " * 300_000), (-(2**63), "u", "long " * 300_000), (9, "u", "\r\n\r\nHTTP/1.1 200 OK\r\n\r\n" * 10), (10, "-", "\x00\n" * 60),
]


def plain_version(rows):
    """Expected rows: of equal payloads of 100 bytes or more the least key is stored once, null keys last."""
    out, seen = [], {}
    for key, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (html or "").encode()
        digest = hashlib.sha256(data).hexdigest()
        again = len(data) >= 100 and digest in seen
        out.append((key, len(data), digest, "revisit" if again else "response", seen[digest] if again else None))
        seen.setdefault(digest, key)
    return sorted(out, key=str)


def read_back(spark, rows, parts, size=warc.ARCHIVE_BYTES):
    schema = "page_id long, url string, html string, archive string, key long, block string, offset string, first string"
    pages = spark.createDataFrame([(*r, "clash", 0, "clash", "clash", "clash") for r in rows], schema).repartition(parts)
    arcs, warcs = shared_folder(spark), shared_folder(spark)
    warc.write_arc(pages, arcs, archive_bytes=size)
    warc.arc_to_warc(spark, arcs, warcs, archive_bytes=size)
    return arcs, warc.read_warc(spark, warcs).where("record_type <> 'warcinfo'")


@pytest.mark.parametrize("parts,size", [(1, 1 << 25), (4, 500)])
def test_pages_there_and_back(spark, parts, size):
    arcs, found = read_back(spark, MESSY, parts, size)
    rows = [(r["key"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to_key"]) for r in found.collect()]
    assert sorted(rows, key=str) == plain_version(MESSY)
    documents = warc.read_arc(spark, arcs).collect()
    assert {r["version"] for r in documents} == ({1} if size > 500 else {1, 2})
    assert sorted(((r["key"], bytes(r["block"])[-r["payload_bytes"] :].decode() if r["payload_bytes"] else "") for r in documents), key=str) == sorted(((k, h or "") for k, _, h in MESSY), key=str)
    assert {r["url"] for r in documents if r["key"] == 3} == {"http://a%20b%0A/c%E2%80%A8d"}


def test_frequent_and_rare_copies(spark, monkeypatch):
    monkeypatch.setattr(warc, "HOT_SHARE", 4)
    rng = random.Random(2)
    rows = [(i, "u", "hot" * 50 if i % 3 == 0 else f"rare {rng.randrange(60)}" * 20) for i in range(200)]
    _, found = read_back(spark, rows, 5)
    assert sorted([(r["key"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to_key"]) for r in found.collect()], key=str) == plain_version(rows)


def test_empty_table(spark):
    arcs, found = read_back(spark, [], 1)
    assert found.collect() == [] and warc.read_arc(spark, arcs).collect() == []


def test_a_wrong_digest_is_an_error(spark, tmp_path):
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:92283950-ef2f-4d72-b224-f54c6ec90bb0>\r\nWARC-Payload-Digest: sha256:00\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(record)
    with pytest.raises(Exception, match="does not have its digest"):
        warc.read_warc(spark, str(tmp_path)).collect()
