"""WARC archives: written with one gzip member for each record, and read back record by record.

The reader inflates a member a piece at a time, takes header lines up to the empty line, frames the block by its
Content-Length, and checks the digests of block and payload before it yields the record.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import cut

PIECE = 1 << 16
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive that breaks the format or whose digests do not fit."""


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(headers: list[tuple[str, str]], http: list[tuple[str, str]], payload: bytes) -> bytes:
    """A record as one gzip member."""
    block = b"HTTP/1.1 200 OK\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in http) + b"\r\n" + payload
    head = [*headers, ("WARC-Block-Digest", f"sha1:{sha1(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    whole = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + b"\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(whole) + z.flush()


class _Source:
    """Bytes of one gzip member after another out of a file, inflated a piece at a time."""

    def __init__(self, file: io.BufferedIOBase):
        self.file, self.rest, self.buffer, self.z = file, b"", bytearray(), None

    def next_member(self) -> bool:
        """Go to the next member; zero bytes between members are padding."""
        while True:
            self.rest = self.rest.lstrip(b"\0")
            if self.rest:
                break
            self.rest = self.file.read(PIECE)
            if not self.rest:
                return False
        self.buffer.clear()
        self.z = zlib.decompressobj(31)
        return True

    def more(self) -> bool:
        """Inflate another piece into the buffer; False at the member's end."""
        if self.z.eof:
            return False
        data = self.z.unconsumed_tail or self.rest or self.file.read(PIECE)
        if not data:
            raise WarcError("the archive ends within a gzip member")
        if not self.z.unconsumed_tail:
            self.rest = b""
        try:
            self.buffer += self.z.decompress(data, PIECE)
        except zlib.error as e:
            raise WarcError(str(e)) from e
        if self.z.eof:
            self.rest = self.z.unused_data
        return True

    def until(self, mark: bytes) -> bytes:
        at = 0
        while (end := self.buffer.find(mark, at)) < 0:
            at = max(0, len(self.buffer) - len(mark))
            if not self.more():
                raise WarcError("a header does not end")
        out = bytes(self.buffer[:end])
        del self.buffer[: end + len(mark)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buffer and not self.more():
                raise WarcError("a block is shorter than its Content-Length")
            part = bytes(self.buffer[:n])
            del self.buffer[: len(part)]
            n -= len(part)
            if part:
                yield part


def _fields(lines: bytes) -> dict[str, str]:
    out = {}
    for line in lines.split(b"\r\n")[1:]:
        k, colon, v = line.partition(b":")
        if not colon:
            raise WarcError("a header line has no colon")
        out[k.decode("utf-8").strip().lower()] = v.decode("utf-8").strip()
    return out


def records(file: io.BufferedIOBase) -> Iterator[Record]:
    """All records of an archive in order; raises WarcError where the format or a digest is broken."""
    source = _Source(file)
    while source.next_member():
        head = source.until(b"\r\n\r\n")
        if not head.startswith(b"WARC/"):
            raise WarcError("a record does not begin with its version")
        headers = _fields(head)
        if not headers.get("content-length", "").isdigit():
            raise WarcError("a record has no Content-Length")
        whole, block = hashlib.sha1(), bytearray()
        for part in source.take(int(headers["content-length"])):
            whole.update(part)
            block += part
        if bytes(b"".join(source.take(4))) != b"\r\n\r\n":
            raise WarcError("a record does not end with two empty lines")
        while source.more():
            pass
        if source.buffer:
            raise WarcError("a gzip member holds more than one record")
        check = headers.get("warc-block-digest")
        if check and check != "sha1:" + base64.b32encode(whole.digest()).decode():
            raise WarcError(f"the block digest of {headers.get('warc-record-id')} does not fit")
        end = block.find(b"\r\n\r\n")
        if end < 0:
            raise WarcError("an HTTP header does not end")
        http, payload = _fields(bytes(block[:end])), bytes(block[end + 4 :])
        check = headers.get("warc-payload-digest")
        if headers.get("warc-type") == "response" and check and check != f"sha1:{sha1(payload)}":
            raise WarcError(f"the payload digest of {headers.get('warc-record-id')} does not fit")
        yield Record(headers, http, payload)


def write(pages: DataFrame, folder: str, least: int = 0, archive_bytes: int = 16 << 20, few: int = 100_000, date: str = "2000-01-01T00:00:00Z") -> None:
    """Write `pages(page_id, url, html)` as WARC archives into `folder`, each of less than archive_bytes before its last record.

    The payload is the html in UTF-8, empty where it is null. Of the rows with equal payloads of at least `least` bytes,
    one with the largest page_id (null lowest; of equal rows any one) becomes a response and the others revisit it; rows
    with smaller payloads are all responses. A null url leaves out the target, a null page_id is written as 'none'.
    Archives go through Spark's text writer, so any file system that Spark knows will do, and a lost task is repeated as
    a whole: a line is an archive without its last byte if that is zero, as it is after members under 16 MiB, and lines
    end with a zero byte; after others it is padding, which gzip readers skip. A file has one line. few: up to so many
    groups of equal payloads (about 10 MB) are broadcast. date: when the pages were captured, the same for all, so that
    reruns agree. Other columns of `pages` are left out; an empty table gives a folder without archives.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("size", F.octet_length("html").cast("long")).withColumn("sha", F.sha1("html"))
    ids = rows.filter(F.col("size") >= least).groupBy("sha", "page_id").agg(F.count("*").alias("c"))
    lowest = F.coalesce("page_id", F.lit(-(1 << 63)))
    best = ids.groupBy("sha").agg(F.max(F.struct(lowest.alias("k"), "page_id")).alias("m"), F.sum("c").alias("n")).filter("n > 1").select("sha", F.col("m.page_id").alias("first"))
    ties = ids.filter("c > 1").select(F.col("sha").alias("tsha"), F.col("page_id").alias("tid"))
    # few groups of equal payloads spare the shuffle of all payloads; many are joined by it
    best, ties = (F.broadcast(t) if t.count() <= few else t for t in (cut(best), cut(ties)))
    marked = rows.join(best, "sha", "left").join(ties, (F.col("sha") == F.col("tsha")) & F.col("page_id").eqNullSafe(F.col("tid")), "left")
    # rows that repeat both payload and page_id are numbered, so that one of them can be the response
    tied = marked.filter("tsha IS NOT NULL").withColumn("copy", F.row_number().over(Window.partitionBy("sha", "page_id").orderBy("url")))
    every = marked.filter("tsha IS NULL").withColumn("copy", F.lit(1)).unionByName(tied)
    response = (F.col("copy") == 1) & (F.col("first").isNull() | F.col("first").eqNullSafe(F.col("page_id"))) | (F.col("size") < least)
    out = every.select("page_id", "url", "html", "sha", response.alias("response"), F.coalesce("first", "page_id").alias("first"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, size = [], 0

        def line() -> pa.RecordBatch:
            whole = b"".join(archive)
            return pa.record_batch({"line": pa.array([whole[:-1] if whole[-1] == 0 else whole], pa.binary())})

        for b in batches:
            for page, url, html, sha, full, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                digest = "sha1:" + base64.b32encode(bytes.fromhex(sha)).decode()
                name = lambda p: f"<urn:page:{'none' if p is None else p}>"
                head = [("WARC-Type", "response" if full else "revisit"), ("WARC-Record-ID", name(page)), ("WARC-Date", date), ("WARC-Payload-Digest", digest)]
                if url is not None:
                    head.append(("WARC-Target-URI", " ".join(url.split())))
                if not full:
                    head += [("WARC-Profile", REVISIT), ("WARC-Refers-To", name(first))]
                http = [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(html)))]
                archive.append(member(head, http, html if full else b""))
                size += len(archive[-1])
                if size >= archive_bytes:
                    yield line()
                    archive, size = [], 0
        if archive:
            yield line()

    lines = out.withColumn("html", F.col("html").cast("binary")).mapInArrow(build, "line binary").select(F.col("line").cast("string").alias("value"))
    lines.write.mode("errorifexists").option("lineSep", "\0").option("maxRecordsPerFile", 1).text(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to) of all records in a folder's archives.

    payload_bytes and payload_digest are those of the full payload, also for revisits, whose own payload is empty.
    A broken archive fails the query. Archives are read whole by tasks, one at a time, so keep them moderate in size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page = lambda x: None if x in (None, "<urn:page:none>") else int(x[len("<urn:page:") : -1])
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])
        for b in batches:
            for i in range(b.num_rows):
                rows, size = [], 0
                for r in records(pa.input_stream(b.column(0)[i].as_buffer())):
                    h = r.headers
                    rows.append({"page_id": page(h["warc-record-id"]), "url": h.get("warc-target-uri"), "record_type": h["warc-type"], "payload": r.payload, "payload_bytes": int(r.http["content-length"]), "payload_digest": h["warc-payload-digest"].removeprefix("sha1:"), "refers_to": page(h.get("warc-refers-to"))})
                    size += len(r.payload)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select("content").mapInArrow(run, "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")
