"""WARC archives written and read as tables, oversized payloads in chunks.

Writing: every row becomes one record, ``response`` or ``revisit`` (of the record with the least
key among equal payloads of at least ``min_bytes``). A block of more than ``chunk_bytes`` is laid
out as the format's record segments: rows of record identifier and segment number, each a record
of its own. A segment is cut from the row's payload where it lies; the block as a whole is never
built. Spark's text writer writes the bytes, two line ends after each record, in gzip files.

Reading: lines stream through a small state machine per file, which yields the chunk table: record,
chunk number, place and size of the chunk, its bytes if wanted, and the payload's SHA-1 up to and
including the chunk (the digest is carried on, never computed anew). The last chunk's digest is
that of the whole payload. A gzip file is always read by one task from its start. What is held is
one chunk and one line (of an archive written here, a segment at most; a foreign payload without line
ends is one line).

Defined results: a null payload is empty; a null key gives a record without a number in its
identifier, which revisits like any other and is never revisited; rows that repeat the least key
are all responses; a null URL leaves out that header, line ends in it are percent-encoded;
extra columns are ignored; an empty table gives empty archives. A continuation whose first segment
is not before it in the same file is a record of type ``continuation``. A record whose length is no
number, and one that its file ends inside, is a record with an ``error`` and as much payload as there is;
reading goes on at the next record. Such records are no pages. A damaged gzip file ends the job,
as any failing read does, unless ``damaged`` says to read it up to there.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starmill.operators.lookup import lookup_join
from starmill.sources.workdir import materialize

CHUNK = 1 << 20
HTTP_HEADER_LIMIT = 1 << 16  # an HTTP header without an end within this many bytes is payload
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PAGE = "urn:starmill:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EOL = "\r\n"


def base32_of_hex(sha1: Column) -> Column:
    """Base32 of 40 hex digits: every 5 hex digits are 4 base32 characters."""
    parts = []
    for at in range(0, 40, 5):
        value = F.conv(F.substring(sha1, at + 1, 5), 16, 10).cast("long")
        for shift in (15, 10, 5, 0):
            digit = F.shiftright(value, shift).bitwiseAND(F.lit(31).cast("long"))
            parts.append(F.substr(F.lit(BASE32), digit.cast("int") + 1, F.lit(1)))
    return F.concat(*parts)


def _header(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(EOL)), F.lit(""))


def _angled(identifier: Column) -> Column:
    return F.concat(F.lit("<"), identifier, F.lit(">"))


def write_archives(
    df: DataFrame,
    path: str,
    key: str = "page_id",
    url: str = "url",
    payload: str = "html",
    min_bytes: int = 0,
    chunk_bytes: int = CHUNK,
    date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Write one record per row of ``df`` below ``path``."""
    rows = df.select(
        F.col(key).alias("key"),
        F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"),
    )
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    equal = rows.where(F.col("size") >= min_bytes).groupBy("sha1").agg(
        F.min("key").alias("owner"), F.count(F.lit(1)).alias("n")
    )
    equal = materialize(equal.where("n > 1 AND owner IS NOT NULL").select("sha1", "owner"), "equal")
    rows = lookup_join(rows, equal, ["sha1"], equal.count())
    revisit = F.col("owner").isNotNull() & ~F.col("key").eqNullSafe(F.col("owner"))
    revisit = revisit & (F.col("size") >= min_bytes)
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "),
        F.col("size").cast("string"), F.lit(EOL * 2),
    ).cast("binary")
    name = F.concat(
        F.lit(PAGE),
        F.coalesce(F.col("key").cast("string"), F.concat(F.lit("none:"), F.col("sha1"))),
    )
    rows = rows.select(
        name.alias("name"),
        F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A").alias("url"),
        revisit.alias("revisit"),
        F.when(revisit, F.concat(F.lit(PAGE), F.col("owner").cast("string"))).alias("refers"),
        base32_of_hex(F.col("sha1")).alias("digest"),
        http.alias("http"),
        F.when(revisit, F.lit(b"")).otherwise(F.col("payload")).alias("payload"),
    ).withColumn("whole", F.octet_length("http") + F.octet_length("payload"))
    last = F.greatest(F.lit(0), F.floor((F.col("whole") - 1) / chunk_bytes)).cast("int")
    rows = rows.withColumn("last", last).select("*", F.explode(F.sequence(F.lit(0), last)).alias("n"))
    first, split = F.col("n") == 0, F.col("last") > 0
    at = F.col("n") * chunk_bytes
    of_http = F.substring(F.col("http"), at + 1, F.lit(chunk_bytes))
    start = F.greatest(F.lit(0), at - F.octet_length("http"))
    of_payload = F.substring(F.col("payload"), start + 1, F.lit(chunk_bytes) - F.octet_length(of_http))
    part = F.concat(of_http, of_payload)
    segment = (F.col("n") + 1).cast("string")
    own = F.when(first, F.col("name")).otherwise(F.concat("name", F.lit(":segment:"), segment))
    kind = F.when(~first, "continuation").when(F.col("revisit"), "revisit").otherwise("response")
    head = F.concat(
        F.lit(f"WARC/1.1{EOL}"),
        _header("WARC-Type", kind),
        _header("WARC-Record-ID", _angled(own)),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", F.when(first, F.col("url"))),
        _header("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), "digest"))),
        _header("WARC-Profile", F.when(first & F.col("revisit"), F.lit(PROFILE))),
        _header("WARC-Refers-To", F.when(first, _angled(F.col("refers")))),
        _header("WARC-Segment-Number", F.when(split, segment)),
        _header("WARC-Segment-Origin-ID", F.when(~first, _angled(F.col("name")))),
        _header(
            "WARC-Segment-Total-Length",
            F.when(split & (F.col("n") == F.col("last")), F.col("whole").cast("string")),
        ),
        F.lit(f"Content-Type: application/http; msgtype=response{EOL}"),
        _header("Content-Length", F.octet_length(part).cast("string")),
        F.lit(EOL),
    )
    record = F.concat(head.cast("binary"), part).cast("string")
    rows.select(record.alias("value")).write.option("lineSep", EOL * 2).option(
        "compression", "gzip"
    ).text(path)


class Reader:
    """Lines of WARC files in, chunk rows out; holds at most one chunk of payload."""

    FIELDS = ("file", "record", "chunk", "offset", "size", "data", "digest", "record_id", "type",
              "refers_to", "declared", "error")

    def __init__(self, chunk_bytes: int, with_data: bool):
        self.chunk_bytes, self.with_data = chunk_bytes, with_data
        self.file, self.record = None, -1
        self.origin = None  # identifier of the record whose payload may go on
        self.rows: list[tuple] = []
        self.error = None
        self.lost = False  # after a bad length: look for the next record
        self.to_headers()

    def to_headers(self) -> None:
        self.headers: dict[str, str] = {}
        self.left = -1  # bytes of the block still to come; -1: in the headers

    def feed(self, file: str, line: bytes) -> None:
        if file != self.file:
            self.end_of_file()
            self.file, self.record = file, -1
        data = line + b"\n"
        if self.left >= 0:
            block, data = data[: self.left], data[self.left :]
            self.left -= len(block)
            self.take(block)
            if self.left:
                return
            self.end_of_block()
        self.header(data.strip(b"\r\n"))

    def header(self, line: bytes) -> None:
        if self.lost:
            if not line.startswith(b"WARC/"):
                return
            self.lost = False
        if line:
            name, colon, value = line.decode("utf-8", "replace").partition(":")
            self.headers[name.strip().lower() if colon else ""] = value.strip()
        elif self.headers:
            length = self.headers.get("content-length", "0")
            self.start_block()
            if not (length.isascii() and length.isdigit()):
                self.fail(f"content length {length[:40]!r}")
                self.lost = True
                return
            self.left = int(length)
            if not self.left:
                self.end_of_block()

    def fail(self, message: str) -> None:
        """The present record ends here, with an error."""
        if self.http:
            self.held, self.http = bytearray(self.http), None
        self.error = message
        self.emit()
        self.origin = None
        self.to_headers()

    def start_block(self) -> None:
        goes_on = self.headers.get("warc-segment-origin-id")
        self.finished = False
        if goes_on and goes_on == self.origin:
            return  # the record, its digest and its chunk numbers go on
        self.finish()
        self.record += 1
        self.origin = self.headers.get("warc-record-id")
        self.about = (
            self.origin, self.headers.get("warc-type"), self.headers.get("warc-refers-to"),
            self.headers.get("warc-payload-digest"),
        )
        http = "application/http" in self.headers.get("content-type", "") and not goes_on
        self.http = b"" if http else None
        self.sha1, self.offset, self.chunk, self.held = hashlib.sha1(), 0, 0, bytearray()
        self.error = None

    def take(self, data: bytes) -> None:
        if self.http is not None:  # still in the HTTP header
            self.http += data
            end = self.http.find(b"\r\n\r\n")
            if end < 0 and len(self.http) < HTTP_HEADER_LIMIT:
                return
            data, self.http = self.http[end + 4 if end >= 0 else 0 :], None
        for at in range(0, len(data), self.chunk_bytes):
            part = data[at : at + self.chunk_bytes]
            if self.held and len(self.held) + len(part) > self.chunk_bytes:
                self.emit()
            self.held += part

    def emit(self) -> None:
        self.sha1.update(self.held)
        digest = base64.b32encode(self.sha1.copy().digest()).decode()
        size = len(self.held)
        self.rows.append((
            self.file, self.record, self.chunk, self.offset, size,
            bytes(self.held) if self.with_data else None, digest, *self.about, self.error,
        ))
        self.offset += size
        self.chunk += 1
        self.held = bytearray()

    def end_of_block(self) -> None:
        more = "warc-segment-number" in self.headers and (
            "warc-segment-total-length" not in self.headers
        )
        self.finished = True
        if not more:
            self.finish()
            self.origin = None
        self.to_headers()

    def finish(self) -> None:
        """The last chunk of the present record, if there is one."""
        if self.origin is not None and self.http:
            self.held, self.http = bytearray(self.http), None  # no HTTP header after all
        if self.origin is not None and (self.held or not self.chunk):
            self.emit()

    def end_of_file(self) -> None:
        if self.headers and self.left < 0 and not self.lost:
            self.start_block()
            self.fail("ends in the headers")
        elif self.left > 0:
            self.fail("ends inside the record")
        self.lost = False
        self.finish()
        self.origin = None
        self.to_headers()


_SCHEMA = (
    "file string, record long, chunk long, offset long, size long, data binary, digest string, "
    "record_id string, type string, refers_to string, declared string, error string"
)
_ARROW = pa.schema([
    (name, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[kind])
    for name, kind in (field.split() for field in _SCHEMA.split(", "))
])
ROWS_AT_ONCE = 2000
BYTES_AT_ONCE = 16 << 20


def read_chunks(
    spark: SparkSession,
    path: str,
    chunk_bytes: int = CHUNK,
    with_data: bool = True,
    damaged: bool = False,
) -> DataFrame:
    """The chunk table of all gzip archives below ``path``; ``damaged``: files that cannot be unpacked
    to their end count up to there."""
    lines = spark.read.option("lineSep", "\n").option("ignoreCorruptFiles", damaged).text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(chunk_bytes, with_data)

        def out() -> pa.RecordBatch:
            columns = list(zip(*reader.rows))
            reader.rows = []
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW
            )

        waiting = 0
        for batch in batches:
            for file, line in zip(batch.column(0).to_pylist(), batch.column(1)):
                before = len(reader.rows)
                reader.feed(file, line.as_py())
                if with_data:
                    waiting += sum(r[4] for r in reader.rows[before:])
                if len(reader.rows) >= ROWS_AT_ONCE or waiting >= BYTES_AT_ONCE:
                    yield out()
                    waiting = 0
        reader.end_of_file()
        if reader.rows:
            yield out()

    return lines.mapInArrow(run, _SCHEMA)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record of a chunk table: identifier, type, payload size and digest."""
    return chunks.groupBy("file", "record").agg(
        F.first("record_id").alias("record_id"),
        F.first("type").alias("record_type"),
        F.first("refers_to").alias("refers_to"),
        F.first("declared").alias("declared"),
        F.sum("size").alias("payload_bytes"),
        F.max_by("digest", "chunk").alias("payload_digest"),
        F.max("error").alias("error"),
    )


def read_pages(spark: SparkSession, path: str, key_type: str = "long") -> DataFrame:
    """``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type`` and ``refers_to`` of all
    records; a revisit has the size and digest of the payload that it refers to."""
    stored = materialize(records(read_chunks(spark, path, with_data=False)), "records")
    stored = stored.where("error IS NULL")
    declared = F.regexp_replace("declared", "^sha1:", "")
    own = stored.where("record_type = 'response'").select(
        "record_id", "payload_bytes", "payload_digest", "record_type",
        F.lit(None).cast("string").alias("refers_to"),
    )
    again = stored.where("record_type = 'revisit'").select(
        "record_id", "record_type", "refers_to", declared.alias("payload_digest")
    )
    wanted = again.select("refers_to", "payload_digest").distinct()
    owners = own.select(F.col("record_id").alias("refers_to"), "payload_digest", "payload_bytes")
    owners = materialize(
        wanted.join(owners, ["refers_to", "payload_digest"]).distinct(), "revisited"
    )
    found = lookup_join(again, owners, ["refers_to", "payload_digest"], owners.count())

    def page(identifier: str) -> Column:
        number = F.regexp_extract(identifier, f"^<{PAGE}(.*)>$", 1)
        return number.try_cast(key_type)

    every = own.unionByName(found.select(*own.columns))
    return every.select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page("refers_to").alias("refers_to"),
    )
