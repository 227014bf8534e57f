"""WARC archives: written by tasks, read back record by record.

Each record is a gzip member of its own, so a reader needs no more than a stream:
it inflates member after member with zlib, in steps, frames each record by its
Content-Length and checks block and payload digests. A page whose payload equals an earlier one's
(smaller id, at least min_bytes long) becomes a revisit record that names it.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, slices, write_file

#: Bytes of records, before compression, that one archive takes; each is read by one task.
ARCHIVE_BYTES = 16 << 20
#: Bytes that the reader takes, or inflates, at a time.
STEP = 1 << 16
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _digest(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def record_bytes(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    """One WARC record as one gzip member."""
    head = {"WARC-Type": kind} | fields | {"WARC-Block-Digest": _digest(block), "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n") + squeeze.flush()


def page_record(number: int, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, when: str) -> bytes:
    """A response record, or a revisit of the page refers_to, without the payload."""
    fields = {
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}:{number}>",
        "WARC-Date": when,
        "WARC-Payload-Digest": _digest(payload),
        "Content-Type": "application/http; msgtype=response",
    }
    if url is not None:
        fields["WARC-Target-URI"] = re.sub(r"^\s+|\s+$|[\r\n]", lambda m: quote(m[0]), url)
    if page_id is not None:
        fields["X-Page-Id"] = str(page_id)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        return record_bytes("response", fields, http + payload)
    return record_bytes("revisit", fields | {"WARC-Profile": _PROFILE, "X-Refers-To-Page-Id": str(refers_to)}, http)


class WarcError(ValueError):
    """An archive that breaks the format or a digest."""


def inflated(parts: Iterable[bytes]) -> Iterator[bytes]:
    """The bytes of a series of gzip members, inflated step by step; b"" after each member."""
    inflate, inside = zlib.decompressobj(31), False
    for part in parts:
        while part:
            try:
                out = inflate.decompress(part, STEP)
            except zlib.error as e:
                raise WarcError(str(e)) from e
            inside = True
            if out:
                yield out
            if inflate.eof:
                part, inflate, inside = inflate.unused_data, zlib.decompressobj(31), False
                yield b""
            else:
                part = inflate.unconsumed_tail
    if inside:
        raise WarcError("the archive ends inside a gzip member")


def _steps(data: bytes, step: int) -> Iterator[memoryview]:
    view = memoryview(data)
    for at in range(0, len(data), step):
        yield view[at : at + step]


def records(data: bytes, step: int = STEP) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers (lower-case names) and the block of each record of an archive; digests are verified.

    The stream is read in steps: a header up to its empty line, then as many bytes
    as Content-Length says, then the two line ends after them. A member may hold
    more than one record, but no record goes on into the next member.
    """
    held = bytearray()
    fields: dict[str, str] | None = None
    size, sums = 0, hashlib.sha256()
    for part in inflated(_steps(data, step)):
        if not part and (held or fields is not None):
            raise WarcError("a record's length is not its Content-Length")
        held += part
        while True:
            if fields is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                fields, size, done = _fields(bytes(held[:end])), 0, 0
                size = int(fields["content-length"])
                del held[: end + 4]
                sums = hashlib.sha256()
            fresh = min(len(held), size)
            if fresh > done:
                sums.update(memoryview(held)[done:fresh])
                done = fresh
            if len(held) < size + 4:
                break
            if held[size : size + 4] != b"\r\n\r\n":
                raise WarcError("a record's length is not its Content-Length")
            block = bytes(held[:size])
            del held[: size + 4]
            _verify(fields, block, "sha256:" + sums.hexdigest())
            yield fields, block
            fields = None


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise WarcError("no WARC header")
    out = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    if not out.get("content-length", "").isdigit():
        raise WarcError("no Content-Length")
    return out


def _verify(fields: dict[str, str], block: bytes, digest: str) -> None:
    if digest != fields.get("warc-block-digest", digest):
        raise WarcError("block digest differs")
    if fields.get("warc-type") == "response":
        payload = _digest(block.partition(b"\r\n\r\n")[2])
        if payload != fields.get("warc-payload-digest", payload):
            raise WarcError("payload digest differs")


def _http_length(block: bytes) -> int:
    for line in block.partition(b"\r\n\r\n")[0].split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            return int(value)
    raise WarcError("no length in the HTTP header")


def revisits(pages: DataFrame, key: str = "page_id", html: str = "html", min_bytes: int = 100) -> DataFrame:
    """(key, refers_to) of the pages whose payload a page with a smaller key has."""
    payload = F.coalesce(html, F.lit(""))
    digests = pages.select(key, F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("size")).where(F.col("size") >= min_bytes)
    first = digests.groupBy("digest", "size").agg(F.min(key).alias("refers_to"), F.max(key).alias("last")).where("refers_to < last")
    later = digests.join(first, ["digest", "size"]).where(F.col(key) > F.col("refers_to"))
    return later.select(key, "digest", "refers_to").distinct()


def write_warc(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 100) -> DataFrame:
    """Write pages as *.warc.gz files into folder; one row per file: file, n_records, n_bytes.

    A url's line breaks and outer white space are percent-encoded; a null url has no header.

    A null html is an empty payload. Payloads of at least min_bytes that equal one
    of a smaller key become revisits; rows that share the smallest key, and rows
    with a null key, are responses. Writing happens when the result is read: a
    repeated task replaces its own files.
    """
    seen = revisits(pages, key, html, min_bytes)
    payload = F.coalesce(F.col(f"p.`{html}`"), F.lit(""))
    same = (F.col(f"p.`{key}`") == F.col(f"r.`{key}`")) & (F.sha2(payload, 256) == F.col("r.digest"))
    joined = pages.alias("p").join(seen.alias("r"), same, "left")
    rows = joined.select(F.col(f"p.`{key}`").alias("id"), F.col(f"p.`{url}`").cast("string").alias("url"), payload.alias("html"), F.col("r.refers_to").alias("first"))
    when = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, names, counts, sizes = TaskContext.get().partitionId(), [], [], []
        held: list[bytes] = []
        size = number = 0

        def flush() -> None:
            nonlocal held, size
            data = b"".join(held)
            names.append(write_file(folder, f"part-{part:06d}-{len(names):04d}.warc.gz", data))
            counts.append(len(held))
            sizes.append(len(data))
            held, size = [], 0

        for batch in slices(batches, "html"):
            columns = (batch.column(c).to_pylist() for c in ("id", "url", "html", "first"))
            for page_id, target, text, first in zip(*columns, strict=True):
                body = text.encode("utf-8", "surrogatepass")
                held.append(page_record(number, page_id, target, body, first, when))
                number += 1
                size += len(body)
                if size >= ARCHIVE_BYTES:
                    flush()
        if held:
            flush()
        yield pa.RecordBatch.from_pydict({"file": pa.array(names, pa.string()), "n_records": pa.array(counts, pa.int64()), "n_bytes": pa.array(sizes, pa.int64())})

    rows = rows.sortWithinPartitions("id", "url", "html")  # a repeated task cuts the same files
    return rows.mapInArrow(run, "file string, n_records long, n_bytes long")


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the *.warc.gz files in folder.

    page_id, url, record_type, payload_bytes and payload_digest (both of the full
    payload, also of revisits), refers_to, payload (null for revisits). A broken
    archive raises WarcError.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("content")
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows: list[list] = [[] for _ in names]
                for fields, block in records(content.as_py()):
                    kind = fields.get("warc-type")
                    if kind not in ("response", "revisit"):
                        continue
                    page, first = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
                    values = (
                        None if page is None else int(page), fields.get("warc-target-uri"), kind, _http_length(block),
                        fields["warc-payload-digest"].removeprefix("sha256:"), None if first is None else int(first),
                        block.partition(b"\r\n\r\n")[2] if kind == "response" else None,
                    )
                    for column, value in zip(rows, values, strict=True):
                        column.append(value)
                    if len(rows[0]) >= 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=names)
                        rows = [[] for _ in names]
                if rows[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=names)

    return files.mapInArrow(run, schema)


def archive_round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 100) -> DataFrame:
    """pages written to archives in the shared folder and read again (see write_warc and read_warc)."""
    spark = pages.sparkSession
    folder = shared_dir(spark, "warc")
    written = write_warc(pages, folder, key, url, html, min_bytes).agg(F.sum("n_records")).first()[0]
    if not written:
        return spark.createDataFrame([], "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")
    return read_warc(spark, folder)
