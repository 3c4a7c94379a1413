"""WARC archives: written by Spark tasks, read back by byte ranges.

Writing. A page becomes one record, a gzip member of its own, so that archives can be entered at any record. Of pages with equal
payloads of at least LEAST bytes the one with the smallest page_id is a `response`; the others `revisit` it: they name its record
and keep the HTTP header with the length and the digest of the payload, but not the payload. Which page is first is found on
(digest, page_id) alone; groups are cut by SALTS, so that a payload that a third of all pages share is no hot key. Only payloads
that occur more than once meet that table (broadcast, if it is small enough), so distinct pages are not shuffled at all. Each task
writes archives of about FILE_BYTES under names of its own and hands on a manifest row a file; only files of the manifest, which is a
written table, count, so what lost or repeated tasks leave behind is never read.

Reading. A file is cut into ranges of RANGE bytes, and a task owns the records that start inside its ranges. It looks for the
magic of gzip, decodes what follows and takes a candidate as a member only if it decodes to its end, its checksum holds and
it begins with a WARC header whose Content-Length is that of its block; from then on members follow each other, and after
damaged bytes the search starts anew. Records that cross the end of a range are read on to their end. Memory: one
record and STEP bytes of the file.

Files are opened by Arrow's file systems, by the address of the shared folder (file, hdfs, s3, gs, ...).

Defined results: null html is an empty payload; smaller payloads than LEAST are all responses; a null page_id comes after all others,
and reads back as null; repeated rows of a page_id with one payload are all response (or all revisit), as none has the smaller id; a
null url is left out, and characters that a header cannot hold (controls and blanks) are percent-encoded; very long payloads are
one record each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import converted, discard, matched, shared_dir, written

LEAST = 100
SALTS = 64
FILE_BYTES = 256 << 20
RANGE = 8 << 20
STEP = 1 << 20
BROADCAST_ROWS = 500_000
MAGIC = b"\x1f\x8b\x08"
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BLANK = {c: f"%{c:02X}" for c in [*range(33), 127]}
MANIFEST = "path string, bytes bigint, records bigint"
RECORD = "path string, offset bigint, length bigint, record_type string, record_id string, refers_to_id string, uri string, payload_bytes bigint, payload_digest string, intact boolean, payload binary"


# ---- records -----------------------------------------------------------------------------------------------------------


def record_bytes(page_id, url: str | None, payload: bytes | None, size: int, digest: str, refers_to=None) -> bytes:
    """One record; payload None makes a revisit of refers_to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {url.translate(BLANK)}")
    if payload is None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = http + (payload or b"")
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(record) + c.flush()


def fields(head: bytes) -> dict[str, str]:
    """The named fields of a header, names in small letters."""
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


@dataclass(frozen=True)
class Record:
    head: dict[str, str]
    http: dict[str, str]
    payload: bytes

    @classmethod
    def of(cls, raw: bytes) -> Record | None:
        """The record of a member's bytes, or None if they are none."""
        if not raw.startswith(b"WARC/1."):
            return None
        at = raw.find(b"\r\n\r\n")
        head = fields(raw[:at]) if at >= 0 else {}
        block = raw[at + 4 : -4]
        if not {"warc-type", "warc-record-id", "content-length"} <= head.keys() or head["content-length"] != str(len(block)) or raw[-4:] != b"\r\n\r\n":
            return None
        if head.get("content-type", "").startswith("application/http"):
            http, _, payload = block.partition(b"\r\n\r\n")
            return cls(head, fields(http), payload)
        return cls(head, {}, block)


# ---- reading -----------------------------------------------------------------------------------------------------------


class Source:
    """An open file, read STEP bytes at a time."""

    def __init__(self, file, size: int):
        self.file, self.size, self.base, self.held = file, size, 0, b""

    def read(self, at: int, n: int) -> bytes:
        """n bytes from `at`, or what is there."""
        n = max(0, min(n, self.size - at))
        if not self.base <= at or at + n > self.base + len(self.held):
            self.base, self.held = at, self.file.read_at(max(n, min(STEP, self.size - at)), at)
        return self.held[at - self.base : at - self.base + n]


def candidate(source: Source, at: int, piece: int = 1 << 16) -> tuple[Record, int] | None:
    """The record of the gzip member at `at`, and the member's length; None if there is no whole member that is one."""
    d, parts, size, read = zlib.decompressobj(31), [], 0, at
    try:
        while not d.eof:
            more = source.read(read, piece)
            if not more:
                return None
            parts.append(d.decompress(more))
            read += len(more)
            if size < 7 <= size + len(parts[-1]) and not b"".join(parts).startswith(b"WARC/1."):
                return None
            size += len(parts[-1])
    except zlib.error:
        return None
    record = Record.of(b"".join(parts))
    return None if record is None else (record, read - at - len(d.unused_data))


def records(source: Source, start: int, end: int) -> Iterator[tuple[int, int, Record]]:
    """Offset, length and record of every member that starts within [start, end)."""
    at, end = start, min(end, source.size)
    while at < end:
        piece = source.read(at, min(1 << 16, end - at + len(MAGIC) - 1))
        found = piece.find(MAGIC)
        if found < 0:
            at += max(len(piece) - len(MAGIC) + 1, 1)
            continue
        at += found
        if at >= end:
            return
        got = candidate(source, at)
        if got is None:
            at += 1
        else:
            yield at, got[1], got[0]
            at += got[1]


def opened(path: str):
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    return system, at


def read_archives(manifest: DataFrame, payload: bool = True, split: int = RANGE) -> DataFrame:
    """The records (RECORD) of the files of a table (path, bytes): type, ids as `<...>` holds them, uri, length and digest of the payload
    (of a revisit: those that it names), whether a response's payload has the digest that it names, and the payload if asked for."""
    whole = F.when(F.col("bytes") > 0, F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(split)))
    ranges = manifest.select("path", "bytes", F.explode(whole).alias("start"))

    def rows(path: str, size: int, start: int) -> Iterator[tuple]:
        system, at = opened(path)
        with system.open_input_file(at) as file:
            for offset, length, r in records(Source(file, size), start, start + split):
                said = r.head.get("warc-payload-digest", "").rpartition(":")[2].lower() or None
                if r.head["warc-type"] == "revisit":
                    n, digest, body = r.http.get("content-length"), said, None
                    n = int(n) if n is not None and n.isdigit() else None
                else:
                    n, digest, body = len(r.payload), hashlib.sha256(r.payload).hexdigest(), r.payload if payload else None
                ids = [r.head.get(f, "").strip("<>") or None for f in ("warc-record-id", "warc-refers-to")]
                yield path, offset, length, r.head["warc-type"], *ids, r.head.get("warc-target-uri"), n, digest, digest == said, body

    names = [c.split()[0] for c in RECORD.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.bool_(), pa.binary()]

    def batch(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size, start in zip(*(b.column(c).to_pylist() for c in ("path", "bytes", "start")), strict=True):
                held, weight = [], 0
                for row in rows(path, size, start):
                    held.append(row)
                    weight += 200 + len(row[-1] or b"")
                    if weight > STEP:
                        yield batch(held)
                        held, weight = [], 0
                if held:
                    yield batch(held)

    n = manifest.agg(F.sum(F.ceil(F.col("bytes") / split)).alias("n")).first()["n"] or 1
    return ranges.repartition(min(int(n), 20_000)).mapInArrow(run, RECORD)


# ---- writing -----------------------------------------------------------------------------------------------------------


def digests(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, and the salt that deals equal payloads out."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload"))
    salt = F.pmod(F.xxhash64(F.col("page_id").cast("string")), F.lit(SALTS)).cast("int")
    return rows.select("*", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), salt.alias("salt"))


def firsts(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """payload_digest, salt, first: the smallest page_id of each payload that more than one page_id has. A payload is at most SALTS rows
    here before the window, whatever the number of its pages."""
    slim = digests(pages).filter(F.col("payload_bytes") >= least)
    parts = slim.groupBy("payload_digest", "salt").agg(F.min("page_id").alias("low"), F.max("page_id").alias("high"), F.max(F.col("page_id").isNull()).alias("nulls"))
    w = Window.partitionBy("payload_digest")
    whole = parts.select("payload_digest", "salt", F.min("low").over(w).alias("first"), F.max("high").over(w).alias("last"), F.max("nulls").over(w).alias("nulls"))
    return whole.filter((F.col("first") < F.col("last")) | (F.col("nulls") & F.col("first").isNotNull())).select("payload_digest", "salt", "first")


def archived(pages: DataFrame, folder: str | None = None, least: int = LEAST, file_bytes: int = FILE_BYTES, level: int = 6) -> DataFrame:
    """Writes the archives and returns their manifest (path, bytes, records). Without a folder they go to the shared one, and
    with the session."""
    spark = pages.sparkSession
    if folder is None:
        folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
        _delete_on_exit(spark, folder)
    first = written(firsts(pages, least), "warc-first")
    rows = digests(pages)
    keys = first.toDF("same_digest", "same_salt", "first")
    rows = matched(rows, keys, (F.col("payload_digest") == F.col("same_digest")) & (F.col("salt") == F.col("same_salt")), "left", BROADCAST_ROWS)
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.col("payload_bytes") >= least)
    text = F.when(~again, F.col("payload"))
    rows = rows.select(F.col("page_id").cast("string"), "url", text.alias("payload"), "payload_bytes", "payload_digest", F.col("first").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = opened(folder)
        system.create_dir(at, recursive=True)
        out, name, n = None, "", 0

        def done() -> pa.RecordBatch:
            size = out.tell()
            out.close()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "bytes": [size], "records": [n]})

        for b in batches:
            for row in range(len(b)):
                page_id, url, payload, size, digest, refers = (b.column(c)[row].as_py() for c in range(6))
                if out is None:
                    name, n = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{at}/{name}", compression=None)
                out.write(member(record_bytes(page_id, url, payload, size, digest, refers), level))
                n += 1
                if out.tell() >= file_bytes:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    manifest = written(rows.mapInArrow(run, MANIFEST), "warc-manifest")
    discard(first)
    return manifest


def _delete_on_exit(spark: SparkSession, folder: str) -> None:
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)


def query(pages: DataFrame, least: int = LEAST, split: int = RANGE, file_bytes: int = FILE_BYTES) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, read back from the archives."""
    kind = pages.schema["page_id"].dataType.simpleString()
    number = lambda c: F.nullif(F.regexp_replace(c, "^urn:page:", ""), F.lit("")).cast(kind)
    read = read_archives(archived(pages, least=least, file_bytes=file_bytes), False, split)
    return read.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to_id").alias("refers_to"))


ORACLE = f"""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {LEAST} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {LEAST} AND page_id <> first THEN first END AS refers_to FROM f
"""
