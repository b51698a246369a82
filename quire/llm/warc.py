"""WARC archives: a writer, a normaliser of monolithic gzip files, and a reader that goes by the index.

write() makes archives as many crawlers leave them: one gzip stream for a whole file. normalise() inflates
such a stream once, in small pieces, and rewrites every record as a gzip member of its own, with a sidecar index of
offsets and lengths (a JSON line for each record). read() deals the index into ranges of bytes, fetches
single members and checks their digests. No step holds a file in memory.

Files go to the shared folder through pyarrow's file systems (local, hdfs, s3, gs). A task writes under a
name of its own attempt, and only names that committed tasks return are used, so a lost executor or a
second attempt leaves at most an unused file.

Defined results
---------------
* A null html is an empty payload. Of equal payloads of at least SMALL bytes the smallest page_id's record is
  a response (every row with that id, if it is repeated); the others revisit it. Null ids are the largest;
  payloads that only null ids have are all responses. An empty table makes no record.
* Line breaks in a url are percent-encoded; a null url has no header.
* Only page_id, url and html are read; others may have any name.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import new_path, open_shared, settle, tune

SMALL = 100
DATE = "1970-01-01T00:00:00Z"
#: Uncompressed bytes after which a task starts another archive.
ROLL = 1 << 30
PIECE = 1 << 18
LEVEL = 4
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A header of our own: the page of the response that a revisit refers to.
REFERS_TO = "Quire-Refers-To-Page"
FILES = "path string, records long"
INDEX = "path string, offset long, length long, type string, id string"


# --- records ---


def record_id(page_id, digest: str, mark: str = "") -> str:
    """A record's id; records of one page and payload need a mark of their own."""
    return f"<urn:quire:page:{'null' if page_id is None else page_id}:{digest}{mark and ':' + mark}>"


def page_of(record: str | None) -> int | None:
    if not record:
        return None
    page = record.strip("<>").split(":")[3]
    return None if page == "null" else int(page)


def record(page_id, url: str | None, payload: bytes, digest: str, size: int, first: int | None, repeated: bool = False) -> bytes:
    """A response, or where first (the page of the response) is given a revisit, which has the payload's length but not the payload.

    repeated: pages with this payload stand more than once. Their records' ids are marked, so a revisit names the page it
    refers to, but no record's id.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    mark = uuid.uuid4().hex if repeated else ""
    lines = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest, mark)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if first is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"{REFERS_TO}: {first}"] + ([] if repeated else [f"WARC-Refers-To: {record_id(first, digest)}"])
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers_of(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


class Inflated:
    """The bytes of a gzip file of one or many members, inflated once and in pieces. What has been taken is dropped a piece at a time."""

    def __init__(self, raw):
        self.raw, self.engine, self.held, self.at, self.rest = raw, None, b"", 0, b""

    def more(self) -> bool:
        while True:
            data = self.rest or self.raw.read(PIECE)
            self.rest = b""
            if not data:
                return False
            if self.engine is None:
                self.engine = zlib.decompressobj(31)
            out = self.engine.decompress(data, PIECE)
            self.rest = self.engine.unconsumed_tail
            if self.engine.eof:
                self.rest, self.engine = self.engine.unused_data, None
            if out:
                self.held, self.at = self.held[self.at :] + out, 0
                return True

    def until(self, end: bytes) -> bytes | None:
        """Bytes up to and with end; None where the file is over."""
        seen = 0  # bytes after `at` in which end does not begin
        while (found := self.held.find(end, self.at + seen)) < 0:
            seen = max(0, len(self.held) - self.at - len(end) + 1)
            if not self.more():
                if self.held[self.at :].strip():
                    raise ValueError("the archive ends within a record's head")
                return None
        start, self.at = self.at, found + len(end)
        return self.held[start : self.at]

    def pieces(self, n: int) -> Iterator[bytes]:
        while n:
            if self.at == len(self.held) and not self.more():
                raise ValueError("the archive ends within a record")
            out = self.held[self.at : self.at + n]
            self.at += len(out)
            n -= len(out)
            yield out


# --- write ---


def roles(pages: DataFrame) -> DataFrame:
    """pages with payload_bytes, payload_digest, first_id (of the response that a revisit refers to) and repeated (some page with that payload stands twice)."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("payload_digest", F.sha2("html", 256)).withColumn("payload_bytes", F.octet_length("html").cast("long"))
    same = rows.groupBy("payload_digest", "page_id").agg(F.count("*").alias("n"), F.first("payload_bytes").alias("size"))
    groups = same.groupBy("payload_digest").agg(F.min(F.when(F.col("size") >= SMALL, F.col("page_id"))).alias("first_id"), F.sum("n").alias("n"), (F.max("n") > 1).alias("repeated")).filter("n > 1").drop("n")
    found = rows.join(settle(groups, "payloads"), "payload_digest", "left").withColumn("repeated", F.coalesce("repeated", F.lit(False)))
    return found.withColumn("first_id", F.when(F.col("page_id").eqNullSafe(F.col("first_id")), None).otherwise(F.col("first_id")))


def write(pages: DataFrame, folder: str) -> DataFrame:
    """path, records: the monolithic archives written for pages."""
    tune(pages.sparkSession)
    schema = pa.schema([("path", pa.string()), ("records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = engine = None
        path, size, records = "", 0, 0

        def close() -> pa.RecordBatch:
            out.write(engine.flush())
            out.close()
            return pa.RecordBatch.from_pylist([{"path": path, "records": records}], schema)

        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("page_id", "url", "payload_digest", "payload_bytes", "first_id", "repeated")]
            for page, url, digest, n, first, repeated, html in zip(*columns, b.column("html"), strict=True):
                if out is None:
                    path, size, records = f"{folder}/mono/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, engine = open_shared(path, "out"), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                data = record(page, url, b"" if first is not None else html.as_buffer().to_pybytes(), digest, n, first, repeated)
                out.write(engine.compress(data))
                size, records = size + len(data), records + 1
                if size >= ROLL:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return settle(roles(pages).mapInArrow(run, FILES), "archives")


# --- normalise ---


def rewrite(source, out, path: str) -> Iterator[dict]:
    """Every record of an open archive as a member of its own in out; yields its index entry."""
    stream, offset = Inflated(source), 0
    while (head := stream.until(b"\r\n\r\n")) is not None:
        head = head.lstrip(b"\r\n")
        if not head:
            continue
        named = headers_of(head)
        engine, start = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), offset
        offset += out.write(engine.compress(head))
        for piece in stream.pieces(int(named["content-length"])):
            offset += out.write(engine.compress(piece))
        offset += out.write(engine.compress(b"\r\n\r\n") + engine.flush())
        yield {"path": path, "offset": start, "length": offset - start, "type": named.get("warc-type"), "id": named.get("warc-record-id")}


class _Counted:
    """write() that tells how many bytes were written, whatever the file system's stream returns."""

    def __init__(self, out):
        self.out = out

    def write(self, data: bytes) -> int:
        if data:
            self.out.write(data)
        return len(data)


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """path, records: archives with a member for each record, each with its index at path + ".idx"."""
    schema = pa.schema([("path", pa.string()), ("records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for old in b.column("path").to_pylist():
                path, records = f"{folder}/members/{uuid.uuid4().hex}.warc.gz", 0
                with open_shared(old, "in") as source, open_shared(path, "out") as out, open_shared(path + ".idx", "out") as index:
                    for entry in rewrite(source, _Counted(out), path):
                        index.write(json.dumps(entry).encode() + b"\n")
                        records += 1
                yield pa.RecordBatch.from_pylist([{"path": path, "records": records}], schema)

    spread = files.select("path").repartition(max(1, files.count()))  # an archive is a task's work
    return settle(spread.mapInArrow(run, FILES), "members")


# --- read ---


def index(files: DataFrame) -> DataFrame:
    """The entries of all sidecars."""
    schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("id", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                with open_shared(path + ".idx", "in") as f:
                    rest = b""
                    while data := f.read(PIECE):
                        whole, _, rest = (rest + data).rpartition(b"\n")
                        if whole:
                            yield pa.RecordBatch.from_pylist([json.loads(x) for x in whole.split(b"\n")], schema)

    return files.select("path").mapInArrow(run, INDEX)


def fetch(f, offset: int, length: int) -> dict:
    """A record by its place: its headers, and size and digest of its payload. The payload is not held."""
    f.seek(offset)

    class Part:
        left = length

        def read(self, n: int) -> bytes:
            data = f.read(min(n, self.left))
            self.left -= len(data)
            return data

    stream = Inflated(Part())
    named = headers_of(stream.until(b"\r\n\r\n"))
    http = stream.until(b"\r\n\r\n")
    size, sha = 0, hashlib.sha256()
    for piece in stream.pieces(int(named["content-length"]) - len(http)):
        size += len(piece)
        sha.update(piece)
    told = named["warc-payload-digest"].partition(":")[2]
    response = named["warc-type"] == "response"
    if response and told != sha.hexdigest():
        raise ValueError(f"{named['warc-record-id']}: the payload is not what its digest says")
    return {
        "page_id": page_of(named["warc-record-id"]), "url": named.get("warc-target-uri"),
        "payload_bytes": size if response else int(headers_of(http)["content-length"]),
        "payload_digest": told, "record_type": named["warc-type"], "refers_to": int(named[REFERS_TO.lower()]) if REFERS_TO.lower() in named else None,
    }


def read(files: DataFrame) -> DataFrame:
    """A row for each record, fetched by the index: page_id, url, payload_bytes, payload_digest, record_type, refers_to."""
    spark = files.sparkSession
    tune(spark)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, f = None, None
        for b in batches:
            out = []
            for path, offset, length in zip(*(b.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True):
                if path != at:
                    if f:
                        f.close()
                    at, f = path, open_shared(path, "random")
                out.append(fetch(f, offset, length))
            yield pa.RecordBatch.from_pylist(out, schema)
        if f:
            f.close()

    stretch = F.floor(F.col("offset") / F.lit(64 << 20))
    dealt = index(files).withColumn("stretch", stretch).repartition("path", "stretch").sortWithinPartitions("path", "offset")
    return dealt.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def digest(pages: DataFrame) -> DataFrame:
    folder = new_path(pages.sparkSession, "warc")
    return read(normalise(write(pages, folder), folder)).drop("url")


ORACLE = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
