"""WARC archives: written by tasks, read back by byte ranges.

Writing: each task writes one ``.warc.gz`` file, one gzip member per record.
Of records with equal payloads the one with the largest page_id is a
``response``, the others are ``revisit`` records that name it and keep its
digest and length in their headers.  A file appears under its final name only
when it is whole, and only files that a finished task reported are read, so a
task that is lost or run twice leaves nothing that is counted.

Reading: files are cut into byte ranges.  A task looks for the gzip magic in
its range, takes a place as the start of a member only if decoding there yields
a WARC header, and owns every record that starts inside its range, reading past
its end for the last one.  Magic bytes inside compressed data do not decode to
a header, so each record has exactly one owner.

Null and empty pages have an empty payload, for which the rule of equal
payloads holds like any other from ``least_payload`` bytes on.  Pages with a
repeated page_id are records of their own; a revisit then names their common
id.  Other columns are ignored.
"""
from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from srcgraph.llm.tables import cut, shared_folder
from srcgraph.session import qualified

SPLIT_BYTES = 4 << 20
# Read tasks; with more ranges than that a task has several.
MOST_TASKS = 50_000
MAGIC = b"\x1f\x8b\x08"
HEAD = b"WARC/1."
READ_SCHEMA = ("page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, "
               "payload binary, file string, offset long")


def urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page-{page_id}')}>"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record: WARC header, HTTP header, and the payload unless it is a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(page_id)}",
             "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Page-ID: {'' if page_id is None else page_id}",
             f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{digest(payload)}",
             "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        lines[2:2] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                      f"WARC-Refers-To: {urn(refers_to)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write(pages: DataFrame, folder: str, least_payload: int = 0) -> DataFrame:
    """Write archives of (page_id, url, html) below ``folder``; (path, size, records) of each file.

    Rows with the same payload and the same largest page_id are all responses.
    """
    folder = qualified(pages.sparkSession, folder)
    payloads = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    payloads = payloads.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    # the largest id of each payload that occurs twice; all others stand alone
    groups = (payloads.where(F.octet_length("html") >= least_payload).groupBy("digest")
              .agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first"))
    rows = payloads.join(groups, "digest", "left").select("page_id", "url", "html", "first")

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = located(folder)
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex}"
        temporary, final = f"{top}/.{name}.tmp", f"{top}/{name}.warc.gz"
        size = count = 0
        out = None
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    system.create_dir(top, recursive=True)
                    out = system.open_output_stream(temporary)
                revisit = r["first"] is not None and r["first"] != r["page_id"]
                data = member(record(r["page_id"], r["url"], r["html"].encode(), r["first"], revisit))
                out.write(data)
                size += len(data)
                count += 1
        if out is not None:
            out.close()
            system.move(temporary, final)
            yield pa.record_batch([[f"{folder}/{name}.warc.gz"], pa.array([size]), pa.array([count])], ["path", "size", "records"])

    return cut(rows.mapInArrow(files, "path string, size long, records long"))[0]


def ranges(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, size, begin, end): byte ranges of the files; a path without a scheme lies in the default file system."""
    store = files.sparkSession._jsc.hadoopConfiguration().get("fs.defaultFS").rstrip("/")
    path = F.when(F.col("path").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.col("path")).otherwise(F.concat(F.lit(store), "path")).alias("path")
    return files.select(path, "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)),
                                                             F.lit(split_bytes).cast("long"))).alias("begin")).select(
        "path", "size", "begin", F.least(F.col("begin") + split_bytes, F.col("size")).alias("end"))


class Member:
    """Incremental decoding of one gzip member from a position of a file."""

    def __init__(self, file, at: int, ahead: bytes = b""):
        self.file, self.next = file, at + len(ahead)
        self.coder = zlib.decompressobj(31)
        self.data = b""
        self.feed(ahead)

    def feed(self, raw: bytes) -> bool:
        """False at the end of the member or of the file."""
        if not raw or self.coder.eof:
            return False
        self.data += self.coder.decompress(raw)
        return not self.coder.eof

    def more(self, n: int = 1 << 16) -> bool:
        if self.coder.eof:
            return False
        self.file.seek(self.next)
        raw = self.file.read(n)
        self.next += len(raw)
        return self.feed(raw)


def is_member(file, at: int, ahead: bytes) -> bool:
    """Whether a gzip member with a WARC header starts here."""
    try:
        found = Member(file, at, ahead)
        while len(found.data) < len(HEAD) and found.more():
            pass
        return found.data.startswith(HEAD)
    except zlib.error:
        return False


def whole_record(file, at: int) -> tuple[bytes, int]:
    """Decoded record that starts at ``at`` and the position after its member."""
    found = Member(file, at)
    while found.more():
        pass
    if not found.coder.eof:
        raise ValueError(f"record at {at} is cut off")
    return found.data, found.next - len(found.coder.unused_data)


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def parse(data: bytes) -> dict:
    """Columns of a record."""
    head, _, block = data.partition(b"\r\n\r\n")
    warc = fields(head)
    block = block[:int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = warc["warc-type"] == "revisit"
    page, refers = warc.get("warc-page-id", ""), warc.get("warc-refers-to-page-id", "")
    return {"page_id": int(page) if page else None, "url": warc.get("warc-target-uri", ""), "record_type": warc["warc-type"],
            "refers_to": int(refers) if refers else None,
            "payload_digest": warc["warc-payload-digest"].removeprefix("sha1:") if revisit else digest(payload),
            "payload_bytes": int(fields(http).get("content-length", 0)) if revisit else len(payload),
            "payload": None if revisit else payload}


def records(file, begin: int, end: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded record) of every record that starts in [begin, end)."""
    at, window, start = begin, b"", begin
    while at < end:
        # candidates: magic bytes, also when they straddle the end of the range
        if not start <= at < start + len(window) - 2:
            file.seek(at)
            start, window = at, file.read(min(SPLIT_BYTES, max(64, end - at + 2)))
            if len(window) < 3:
                return
        hit = window.find(MAGIC, at - start)
        if hit < 0:
            at = start + len(window) - 2
            if start + len(window) >= min(size, end + 2):
                return
            continue
        at = start + hit
        if at >= end:
            return
        if is_member(file, at, window[hit:hit + 512]):
            data, after = whole_record(file, at)
            yield at, data
            at = after
        else:
            at += 1


def read(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All records of the archives (path, size), each by the range it starts in."""
    def scan(batches):
        for batch in batches:
            for path, size, begin, end in zip(*(batch.column(c).to_pylist() for c in range(4))):
                rows, held = [], 0
                with opened(path) as file:
                    for at, data in records(file, begin, end, size):
                        rows.append(parse(data) | {"file": path, "offset": at})
                        held += len(data)
                        if held > 8 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)
    # the rows are tiny and the work behind them is not, so the number of tasks is fixed by hand
    tasks = files.agg(F.sum(F.ceil(F.col("size") / split_bytes))).first()[0] or 1
    return ranges(files, split_bytes).repartition(min(int(tasks), MOST_TASKS), "path", "begin").mapInArrow(scan, READ_SCHEMA)


def located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or a plain path."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def opened(path: str):
    system, inside = located(path)
    return system.open_input_file(inside)


def batch_of(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(),
             "payload_digest": pa.string(), "payload_bytes": pa.int64(), "payload": pa.binary(), "file": pa.string(), "offset": pa.int64()}
    return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], list(kinds))


def round_trip(pages: DataFrame, least_payload: int = 0, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Write the pages to the shared folder and read the archives back."""
    folder = os.path.join(shared_folder(pages.sparkSession), f"warc-{uuid.uuid4().hex}")
    return read(write(pages, folder, least_payload), split_bytes)
