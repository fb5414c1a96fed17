"""WARC archives: a writer, and a sequential reader.

An archive is a file of gzip members, one for each record. The writer gives each task one file in the shared folder,
under a name of its own until it is whole. The reader goes through a file once: it inflates member after member as bytes
come in, takes the header up to the blank line, reads as many bytes of block as Content-Length says, and holds the payload
against the digest in the header.

Records with equal payloads of 100 bytes or more: that of the smallest page_id is a response, the others are revisits
that name it and have no payload of their own.

Defined cases: null html is an empty payload; rows without a page_id are responses; rows that repeat a page_id are records
each, of the same type; a null url has no target header; payloads may be of any length (a record is held in memory, an
archive is not); an empty table gives empty archives and no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, marked_by, shared_dir

BLOCK = 1 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
LEAST_SHARED = 100


class BadRecord(ValueError):
    pass


@dataclass
class Record:
    headers: dict[str, str]
    payload: bytes


def record_id(page_id: int | None, salt: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'page:{page_id}{salt}')}>"


def one_line(text: str) -> str:
    return "".join(c if c >= " " else "%%%02X" % ord(c) for c in text)


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """A record as a gzip member. first: the page whose payload this one repeats."""
    digest = hashlib.sha256(payload).hexdigest()
    block = HTTP % len(payload) + (b"" if first is not None else payload)
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}",
        "WARC-Date: 2020-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if url:
        lines.append(f"WARC-Target-URI: {one_line(url)}")
    if first is not None:
        lines += [f"WARC-Refers-To: {record_id(first)}", f"X-Refers-To-Page-Id: {first}", f"WARC-Profile: {PROFILE}"]
    lines.append(f"Content-Length: {len(block)}")
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parse(raw: bytes) -> Record:
    """A record from its inflated bytes, its frame and digests checked."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not mark or not lines[0].startswith("WARC/1."):
        raise BadRecord("no WARC header")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    size = int(headers["Content-Length"])
    block, tail = rest[:size], rest[size:]
    if len(block) != size or tail != b"\r\n\r\n":
        raise BadRecord(f"block of {len(rest)} bytes doesn't fit Content-Length {size}")
    if headers["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise BadRecord("block digest")
    http, mark, payload = block.partition(b"\r\n\r\n")
    if not mark:
        raise BadRecord("no HTTP header")
    if headers["WARC-Type"] == "response":
        if headers["WARC-Payload-Digest"] != f"sha256:{hashlib.sha256(payload).hexdigest()}":
            raise BadRecord("payload digest")
        if int(headers["X-Payload-Length"]) != len(payload):
            raise BadRecord("payload length")
    return Record(headers, payload)


def records(blocks: Iterator[bytes]) -> Iterator[Record]:
    """The records of an archive whose bytes come in blocks of any size."""
    inflate, out = zlib.decompressobj(31), []
    for data in blocks:
        while data:
            out.append(inflate.decompress(data))
            data = inflate.unused_data
            if not inflate.eof:
                break
            yield parse(b"".join(out))
            inflate, out = zlib.decompressobj(31), []
    if any(out):
        raise BadRecord("the archive ends within a record")


def blocks_of(path: str) -> Iterator[bytes]:
    store, inner = fs.FileSystem.from_uri(path)
    with store.open_input_stream(inner, compression=None) as f:
        while data := f.read(BLOCK):
            yield data


def revisits(pages: DataFrame) -> DataFrame:
    """pages as (page_id, url, html, first): first is the page whose payload a row repeats, or null.

    Digests move, and minima combine before that. The list of repeats goes back by page_id; a bitmap of it tells the other
    pages apart, whose payloads stay where they are.
    """
    few = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    digests = few.where((F.octet_length("html") >= LEAST_SHARED) & F.col("page_id").isNotNull()).select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("digest"))
    firsts = digests.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("digest", "first")
    again = digests.join(firsts, "digest").where("page_id > first").groupBy("page_id", "digest").agg(F.min("first").alias("first"))
    keys = durable(again.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "first"), "repeats")
    marked, flag = marked_by(few, "page_id", keys.select("p"), 24)
    same = (F.col("page_id") == F.col("p")) & (F.sha2(F.col("html").cast("binary"), 256) == F.col("d"))
    some = marked.where(flag).drop(flag).join(keys, same, "left").select("page_id", "url", "html", "first")
    return marked.where(~F.col(flag)).drop(flag).withColumn("first", F.lit(None).cast("long")).unionByName(some)


def write(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes archives of all pages and returns their paths (column path), durable in the shared folder.

    A task that runs again writes another file and the list names the one of the attempt that counted.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        store, inner = fs.FileSystem.from_uri(name)
        store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(f"{inner}.part", compression=None) as f:
            for b in batches:
                for page_id, url, html, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    f.write(record(page_id, url, html.encode(), first))
        store.move(f"{inner}.part", inner)
        yield pa.RecordBatch.from_arrays([pa.array([name])], names=["path"])

    listed = f"{folder}/index"
    revisits(pages).mapInArrow(run, "path string").write.parquet(listed)
    return spark.read.schema("path string").parquet(listed)


def read(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """Rows (page_id, url, record_type, payload_bytes, payload_digest, refers_to[, payload]) of the archives' records."""
    extra = ", payload binary" if payloads else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: None if x is None else int(x)
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, held = [], 0
                for r in records(blocks_of(path)):
                    h = r.headers
                    rows.append((number(h.get("X-Page-Id")), h.get("WARC-Target-URI"), h["WARC-Type"], int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha256:"), number(h.get("X-Refers-To-Page-Id")), r.payload))
                    held += len(r.payload) * payloads
                    if len(rows) == 5000 or held > 1 << 25:
                        yield batch(rows)
                        rows, held = [], 0
                yield batch(rows)

    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * 7
        n = 7 if payloads else 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols[:n], kinds, strict=False)], names=names[:n])

    spread = archives.repartition(max(1, archives.count()))
    return spread.mapInArrow(run, f"page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long{extra}")
