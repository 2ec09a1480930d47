"""WARC archives as a table of chunks.

A record (header block and payload) is a byte stream; the archive keeps it as rows (record_id, chunk_no, data) with at most CHUNK bytes of payload. Each row carries
the SHA-1 of the payload up to its end, so a reader checks a record as it goes and never holds more than a chunk of it. The writer cuts a payload where
it is read, out of the batch that holds it, with running digests; from there on only chunks move, compressed one by one. Records of
one chunk are read where they lie; only the others are dealt out by record and put in order.

Of equal payloads of at least REVISIT bytes, that with the largest page_id is a response and the others are revisits of it, without payload;
smaller payloads are all responses. Equal means equal SHA-256 and length. Rows that share the largest page_id are all responses.
A revisit names the record that it refers to (WARC-Refers-To; of several with one page_id, that with the smallest record id) and its page.
A null page_id is below all others; a null html is an empty payload, a null url an empty target. Very long payloads are more chunks. Other columns are not read. An empty
table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import base

CHUNK, REVISIT = 64 << 10, 1000
RECORDS = "record_id string, page_id long, chunk_no int, last boolean, payload_sha1 binary, data binary"
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
TAIL = b"\r\n\r\n"
LOWEST = -(1 << 63)  # stands for a null page_id
_PIECES = "record_id string, page_id long, digest binary, sha1 binary, size long, url string, chunk_no int, last boolean, payload_sha1 binary, piece binary"


def pieces(payload: memoryview, size: int = CHUNK) -> Iterator[tuple[int, bool, bytes, memoryview]]:
    """(number, last, SHA-1 of the payload so far, bytes) of a payload; an empty one is one empty piece."""
    running, stops = hashlib.sha1(), range(0, max(len(payload), 1), size)
    for number, at in enumerate(stops):
        part = payload[at : at + size]
        running.update(part)
        yield number, number == len(stops) - 1, running.digest(), part


def _name(digest: bytes, page: int | None, serial: int) -> str:
    """The id of a record: of its content and page, and of its place, as rows may repeat."""
    from pyspark import TaskContext

    place = TaskContext.get().partitionId() if TaskContext.get() else 0
    return str(uuid.UUID(bytes=hashlib.sha256(digest + f"{page}:{place}:{serial}".encode()).digest()[:16]))


def _cut(batches: Iterator[pa.RecordBatch], page_id: str, url: str, html: str) -> Iterator[pa.RecordBatch]:
    """The pieces of all payloads. A payload is read twice where it lies, once for its digests and once to be cut, and is never copied whole."""
    serial, pack, rows, held = 0, zstandard.ZstdCompressor(level=1), [], 0
    for part in base.passes(batches, html):
        data, offs = base.text_bytes(part.column(html))
        whole = memoryview(data)
        for k, (page, target) in enumerate(zip(part.column(page_id).to_pylist(), part.column(url).to_pylist())):
            payload = whole[offs[k] : offs[k + 1]]
            digest, sha1 = hashlib.sha256(payload).digest(), hashlib.sha1(payload).digest()
            name = _name(digest, page, serial)
            serial += 1
            for number, last, running, piece in pieces(payload):
                rows.append((name, page, digest, sha1, len(payload), target, number, last, running, packed := pack.compress(piece)))
                held += len(packed) + 300
                if held > base.PASS_BYTES:
                    yield base.record(_PIECES, **dict(zip("abcdefghij", zip(*rows))))
                    rows, held = [], 0
    if rows:
        yield base.record(_PIECES, **dict(zip("abcdefghij", zip(*rows))))


def head(kind: str, record_id: str, page: int | None, url: str | None, size: int, sha1: bytes, refers: tuple[int, str] | None) -> bytes:
    target = "".join(c for c in url or "" if c not in "\r\n")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id}>", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Target-URI: {target}"]
    lines += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}", f"X-Payload-Length: {size}"]
    lines += [f"X-Page-Id: {page}"] * (page is not None)
    if refers:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{refers[1]}>", f"X-Refers-To-Page-Id: {refers[0]}"]
    length = len(HTTP) + (size if kind == "response" else 0)
    return ("\r\n".join([*lines, f"Content-Length: {length}"]) + "\r\n\r\n").encode() + HTTP


def _out(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of the archive in batches of a bounded size."""
    some, held = [], 0
    for row in rows:
        some.append(row)
        held += len(row[-1])
        if held > base.PASS_BYTES:
            yield base.record(RECORDS, **dict(zip("abcdef", zip(*some))))
            some, held = [], 0
    if some:
        yield base.record(RECORDS, **dict(zip("abcdef", zip(*some))))


def _lists(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


def _responses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()

    def rows() -> Iterator[tuple]:
        for name, page, sha1, size, url, number, last, running, piece in _lists(batches, "record_id", "page_id", "sha1", "size", "url", "chunk_no", "last", "payload_sha1", "piece"):
            lead = b"" if number else head("response", name, page, url, size, sha1, None)
            yield name, page, number, last, running, lead + unpack.decompress(piece) + (TAIL if last else b"")

    return _out(rows())


def _revisits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nothing = hashlib.sha1(b"").digest()

    def rows() -> Iterator[tuple]:
        for serial, (page, digest, sha1, size, url, latest, response) in enumerate(_lists(batches, "page_id", "digest", "sha1", "size", "url", "latest", "response")):
            name = _name(b"revisit" + digest, page, serial)
            yield name, page, 0, True, nothing, head("revisit", name, page, url, size, sha1, (latest, response)) + TAIL

    return _out(rows())


def write_archive(df: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """One record per row, into the chunk table at `path`: first the responses, then the revisits, which name records of the first."""
    spark = df.sparkSession
    base.prepare(spark)
    scratch = base.Scratch(spark, "warc-digests")
    write = lambda rows: rows.write.mode("append").option("compression", "zstd").parquet(path)
    text = F.coalesce(df[html], F.lit(""))
    known = df.select(df[page_id].alias("page_id"), df[url].alias("url"), F.unhex(F.sha2(text, 256)).alias("digest"), F.unhex(F.sha1(text)).alias("sha1"), F.octet_length(text).cast("long").alias("size"))
    known = scratch.keep(known.where(F.col("size") >= REVISIT).withColumn("id", F.coalesce("page_id", F.lit(LOWEST))).withColumn("row", F.monotonically_increasing_id()), "known")  # no payloads, and read three times
    latest = known.groupBy("digest", "size").agg(F.max("id").alias("latest"), F.min("id").alias("least"), F.min("sha1").alias("sha1"), F.count("*").alias("n")).where("least < latest")
    latest = scratch.keep(latest.drop("least"), "latest")
    keys = ["digest", "size"]
    # Revisits by page and digest, so that rows of one page with other payloads are told apart.
    again = base.join_back(known.drop("sha1"), latest.drop("sha1"), keys, "row").where("id < latest").select("id", "digest").distinct()

    cut = df.select(*[df[c].alias(c) for c in (page_id, url, html)]).mapInArrow(lambda b: _cut(b, page_id, url, html), _PIECES).withColumn("id", F.coalesce("page_id", F.lit(LOWEST)))
    write(cut.join(again, ["id", "digest"], "left_anti").mapInArrow(_responses, RECORDS))

    responses = spark.read.schema(RECORDS).parquet(path).where("last and page_id is not null").groupBy(F.col("page_id").alias("latest"), F.col("payload_sha1").alias("sha1")).agg(F.min("record_id").alias("response"))
    named = latest.join(responses, ["latest", "sha1"]).drop("sha1")
    write(base.join_back(known, named, keys, "row").where("id < latest").mapInArrow(_revisits, RECORDS))
    scratch.drop(known, latest)


def parse_head(data: bytes) -> tuple[dict[str, str], int]:
    """Header fields of a record, and where its block begins."""
    stop = data.index(b"\r\n\r\n") + 4
    lines = data[: stop - 4].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    return dict(line.split(": ", 1) for line in lines[1:] if ": " in line), stop


class Reader:
    """One record, chunk by chunk; its result is ready after the last."""

    def __init__(self, data: bytes):
        self.fields, at = parse_head(data)
        self.sha1, self.size, self.left = hashlib.sha1(), 0, int(self.fields["Content-Length"])
        http = data.index(b"\r\n\r\n", at) + 4
        self.left -= http - at
        self.next, self.whole = 0, False
        self.lead = http

    def feed(self, number: int, last: bool, sha1: bytes, data: bytes) -> None:
        if number != self.next:
            raise ValueError(f"chunk {number} where {self.next} is due")
        body = memoryview(data)[self.lead :]
        self.lead, self.next = 0, number + 1
        part = body[: self.left]
        self.left -= len(part)
        self.size += len(part)
        self.sha1.update(part)
        if self.sha1.digest() != sha1:
            raise ValueError("payload and digest differ")
        self.whole = last

    def result(self) -> tuple:
        f, kind = self.fields, self.fields["WARC-Type"]
        stated = base64.b32decode(f["WARC-Payload-Digest"].removeprefix("sha1:"))
        if not self.whole or self.left or kind == "response" and stated != self.sha1.digest():
            raise ValueError("record is not whole")
        page, refers = f.get("X-Page-Id"), f.get("X-Refers-To-Page-Id")
        return page and int(page), self.size if kind == "response" else int(f["X-Payload-Length"]), stated.hex(), kind, refers and int(refers)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader, name, rows = None, None, []
    for batch in batches:
        for record, number, last, sha1, data in zip(*(batch.column(c).to_pylist() for c in ("record_id", "chunk_no", "last", "payload_sha1", "data"))):
            if record != name:
                if reader:
                    raise ValueError(f"record {name} has no end")
                reader, name = Reader(data), record
            reader.feed(number, last, sha1, data)
            if last:
                rows.append(reader.result())
                reader = name = None
        if rows:
            yield base.record(SCHEMA, **dict(zip("abcde", zip(*rows))))
            rows = []
    if reader:
        raise ValueError(f"record {name} has no end")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of a chunk table (SCHEMA), each record checked against its digests."""
    base.prepare(spark)
    table = spark.read.schema(RECORDS).parquet(path)
    columns = ["record_id", "chunk_no", "last", "payload_sha1", "data"]
    alone = F.col("last") & (F.col("chunk_no") == 0)
    short = table.where(alone).select(columns).mapInArrow(_read, SCHEMA)
    long = table.where(~alone).select(columns).repartition("record_id").sortWithinPartitions("record_id", "chunk_no").mapInArrow(_read, SCHEMA)
    return short.union(long)


def archived(df: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write the rows as an archive in the shared folder, and read it back. The archive goes when the application ends."""
    path = base.Scratch(df.sparkSession, "warc").root
    write_archive(df, path, page_id, url, html)
    return read_archive(df.sparkSession, path)
