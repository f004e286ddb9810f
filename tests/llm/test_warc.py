import base64
import gzip
import hashlib
import os
import random

import pytest
from corpus import SF

from check_oracle import compare, connect
from starmill.llm import warc
from starmill.llm.queries import ORACLES, QUERIES

SCHEMA = "page_id long, url string, html string"


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def expected(pages, min_bytes=0):
    rows = []
    data = {i: (p[0], (p[2] or "").encode()) for i, p in enumerate(pages)}
    for key, payload in data.values():
        same = [k for k, other in data.values() if other == payload and k is not None]
        count = sum(other == payload for _, other in data.values())
        owner = min(same, default=None)
        revisit = len(payload) >= min_bytes and count > 1 and owner is not None and key != owner
        rows.append((key, len(payload), digest(payload), "revisit" if revisit else "response",
                     owner if revisit else None))
    return sorted(rows, key=repr)


PAGES = [
    (5, "http://a/", "<p>same é\r\n\r\ntext</p>"), (2, "http://b/", "<p>same é\r\n\r\ntext</p>"),
    (9, None, None), (3, "x\r\ny", ""), (4, "http://c/", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\n"),
    (None, "http://n/", "<p>same é\r\n\r\ntext</p>"), (None, "http://m/", "alone"),
    (7, "http://l/", "ü€𝄞" * 5000), (8, "http://l/", "line\n" * 3000), (2, "http://b/", "other"),
    (6, "http://l/", "ü€𝄞" * 5000),
]


def test_round_trip_in_small_chunks(spark, tmp_path):
    frame = spark.createDataFrame(PAGES, SCHEMA).repartition(3)
    for chunk, least in ((64, 0), (1 << 20, 0), (1000, 10)):
        path = str(tmp_path / f"{chunk}-{least}")
        warc.write_archives(frame, path, chunk_bytes=chunk, min_bytes=least)
        rows = sorted((tuple(r) for r in warc.read_pages(spark, path).collect()), key=repr)
        assert rows == expected(PAGES, least)


def test_chunk_table(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(PAGES, SCHEMA), path, chunk_bytes=700)
    chunks = warc.read_chunks(spark, path, chunk_bytes=100).collect()
    by = {}
    for c in sorted(chunks, key=lambda c: (c.file, c.record, c.chunk)):
        assert c.size <= 100 and c.size == len(c.data)
        sofar = by.setdefault((c.file, c.record, c.record_id, c.type), b"")
        assert c.offset == len(sofar)
        by[c.file, c.record, c.record_id, c.type] = sofar = sofar + c.data
        assert c.digest == digest(sofar)  # carried from chunk to chunk
    payloads = {d for (_, _, _, kind), d in by.items() if kind == "response"}
    assert payloads == {(p[2] or "").encode() for p in PAGES}


def test_written_bytes_are_valid_records(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(PAGES, SCHEMA).coalesce(1), path, chunk_bytes=5000)
    raw = b"".join(
        gzip.open(f"{path}/{f}").read() for f in sorted(os.listdir(path)) if f.endswith(".gz")
    )
    at = count = 0
    while at < len(raw):
        assert raw.startswith(b"WARC/1.1\r\n", at)
        end = raw.index(b"\r\n\r\n", at)
        fields = dict(x.split(b": ", 1) for x in raw[at:end].split(b"\r\n")[1:])
        at = end + 4 + int(fields[b"Content-Length"])
        assert raw[at : at + 4] == b"\r\n\r\n"
        at += 4
        count += 1
    assert count > len(PAGES)


def test_foreign_archive(spark, tmp_path):
    """Several gzip members, plain payloads, a continuation without its origin."""
    def record(kind, identifier, body, more=b""):
        head = b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <%s>\r\n%sContent-Length: %d\r\n\r\n"
        return head % (kind, identifier, more, len(body)) + body + b"\r\n\r\n"

    members = [
        record(b"warcinfo", b"i", b"software: x\r\n"),
        record(b"resource", b"r", b"\n\nab\r\n"),
        record(b"continuation", b"c2", b"tail", b"WARC-Segment-Origin-ID: <gone>\r\n"
               b"WARC-Segment-Number: 2\r\n"),
    ]
    (tmp_path / "f.warc.gz").write_bytes(b"".join(gzip.compress(m) for m in members))
    rows = warc.records(warc.read_chunks(spark, str(tmp_path / "f.warc.gz"))).collect()
    assert {(r.record_type, r.payload_bytes, r.payload_digest) for r in rows} == {
        ("warcinfo", 13, digest(b"software: x\r\n")), ("resource", 6, digest(b"\n\nab\r\n")),
        ("continuation", 4, digest(b"tail"))}


def plain(kind, identifier, body, length=None):
    head = b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <%s>\r\nContent-Length: %s\r\n\r\n"
    return head % (kind, identifier, length or str(len(body)).encode()) + body + b"\r\n\r\n"


def found_records(df):
    rows = warc.records(df).collect()
    return {(r.record_id, r.payload_bytes, r.payload_digest, r.error) for r in rows}


@pytest.mark.parametrize("length", [b"ten", b"-5", b"", b"1e3", "٣".encode()])
def test_a_bad_length_is_an_error_of_that_record(spark, tmp_path, length):
    good = plain(b"resource", b"a", b"one\r\n"), plain(b"resource", b"c", b"three")
    bad = plain(b"resource", b"b", b"two\r\n\r\nContent-Length: 7\r\n", length or b" ")
    (tmp_path / "f.warc.gz").write_bytes(gzip.compress(good[0] + bad + good[1]))
    found = found_records(warc.read_chunks(spark, str(tmp_path / "f.warc.gz")))
    assert {f[:3] for f in found if f[3] is None} == {
        ("<a>", 5, digest(b"one\r\n")), ("<c>", 5, digest(b"three"))}
    (error,) = (f for f in found if f[3] is not None)
    assert error[0] == "<b>" and error[3].startswith("content length")


def test_records_that_are_cut_off(spark, tmp_path):
    whole = plain(b"resource", b"a", b"one") + plain(b"resource", b"b", b"x" * 9000)
    (tmp_path / "cut.warc.gz").write_bytes(gzip.compress(whole[:-5000]))
    (tmp_path / "head.warc.gz").write_bytes(gzip.compress(plain(b"resource", b"h", b"")[:40]))
    found = found_records(warc.read_chunks(spark, str(tmp_path), chunk_bytes=1000))
    assert ("<a>", 3, digest(b"one"), None) in found
    (cut,) = (f for f in found if f[0] == "<b>")
    assert 3000 < cut[1] < 9000 and cut[3] == "ends inside the record"
    assert any(f[3] == "ends in the headers" for f in found) and len(found) == 3


def test_damaged_gzip_files(spark, tmp_path):
    noise = bytes(random.Random(1).randbytes(300_000)).replace(b"\n", b"")
    packed = gzip.compress(plain(b"resource", b"a", b"one") + plain(b"resource", b"b", noise))
    (tmp_path / "f.warc.gz").write_bytes(packed[: len(packed) // 2])
    with pytest.raises(Exception, match="(?i)unexpected end|EOF|corrupt"):
        warc.read_chunks(spark, str(tmp_path)).collect()
    found = found_records(warc.read_chunks(spark, str(tmp_path), damaged=True))
    assert ("<a>", 3, digest(b"one"), None) in found or not found


@pytest.mark.parametrize("chunk_bytes", [7, 64, 1000])
def test_segments_shorter_than_the_http_header(spark, tmp_path, chunk_bytes):
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(PAGES, SCHEMA), path, chunk_bytes=chunk_bytes)
    found = {(r.page_id, r.payload_bytes, r.payload_digest) for r in warc.read_pages(spark, path).collect()}
    assert found == {(k, len((h or "").encode()), digest((h or "").encode())) for k, _, h in PAGES}


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame([], SCHEMA), path)
    assert warc.read_pages(spark, path).count() == 0


def test_oracle(spark):
    verdict, _ = compare(spark, connect(SF), SF, "op2", QUERIES["op2_warc"], ORACLES["op2_warc"])
    assert verdict.startswith("ok") and "TYPES" not in verdict, verdict
