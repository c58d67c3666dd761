"""WARC archives: a writer with revisit records and a splittable reader.

The archives are files of gzip members, a member a record.  Spark's text writer stores them (raw bytes
pass through it), so the commit protocol of the output keeps lost tasks from leaving half an archive,
and any store that Spark writes will do.  The writer's line separator is a zero byte, which is the last
byte of a member already: the top byte of its length, for records under 16 MiB.  Larger records are
followed by one byte of zero padding, which gzip readers skip.

The reader is splittable.  Spark's text reader scans byte ranges of the files for the gzip magic as its
separator, and what starts in a range belongs to it, read to its end even if that lies beyond.  A
candidate counts as a record only if it decodes to a WARC header; other finds of the magic are compressed
data of the record before.  A member is read until its deflate stream ends and its length and CRC agree.
Where a member runs over a false magic into the next range, its parts are put together afterwards.
Archives must not have names that end in .gz, since Hadoop reads those whole.

A record holds a page: `payload_digest` is SHA-1 of the payload in upper-case base32.  Of pages with equal
payloads of at least `min_dedup_bytes` bytes the one with the largest page_id is the response, and the
others are revisits without a body that refer to it; a shorter payload is always a response.  Null html is
an empty payload.  Rows that repeat the largest page_id are all responses.  A null page_id is smaller than
any other.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import records, saved, scratch_path

MAGIC = b"\x1f\x8b\x08"
GZIP_HEADER = MAGIC + b"\0\0\0\0\0\0\xff"
#: No page: the id of a null page_id in a record.
NO_PAGE = "none"
READ_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(data: bytes) -> bytes:
    """A gzip member without time or name, so that equal records are equal bytes."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    return GZIP_HEADER + z.compress(data) + z.flush() + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """The bytes of a WARC/1.1 record; with refers_to a revisit."""
    revisit = refers_to is not None
    # Header lines end at CR LF: what breaks a line in a URL is escaped.
    url = "".join(f"%{ord(c):02X}" if ord(c) < 33 or c in "%\x7f" else c for c in url or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{NO_PAGE if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    lines.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parsed(data: bytes) -> tuple:
    """The columns of READ_SCHEMA of a record."""
    from urllib.parse import unquote

    head, _, body = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    page = lambda s: None if s is None or s == f"<urn:page:{NO_PAGE}>" else int(s.removeprefix("<urn:page:").removesuffix(">"))
    payload = body[: int(fields["Content-Length"])]
    return (page(fields["WARC-Record-ID"]), unquote(fields["WARC-Target-URI"]), fields["WARC-Type"], page(fields.get("WARC-Refers-To")), int(fields.get("WARC-Payload-Length", len(payload))), fields["WARC-Payload-Digest"].removeprefix("sha1:"), payload)


def starts_record(data: bytes) -> bool:
    """Whether data, which begins with the magic, decodes to the start of a WARC record."""
    try:
        return zlib.decompressobj(31).decompress(data, 8).startswith(b"WARC/1.")
    except zlib.error:
        return False


class Member:
    """A gzip member taken up part by part; `data` when it is whole."""

    def __init__(self) -> None:
        self.z, self.out, self.parts = zlib.decompressobj(31), [], []

    def take(self, part: bytes) -> bool:
        """Whether the member has ended, its CRC and length checked by zlib."""
        if not self.z.eof:
            self.parts.append(part)
            self.out.append(self.z.decompress(part))
        return self.z.eof

    @property
    def data(self) -> bytes:
        return b"".join(self.out)


def write_archives(pages: DataFrame, path: str, min_dedup_bytes: int = 0) -> None:
    """Writes (page_id, url, html) as archives into the folder `path`."""
    html = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    pages = pages.select("page_id", "url", html.alias("payload")).withColumn("sha", F.unhex(F.sha1("payload")))
    several = pages.where(F.octet_length("payload") >= min_dedup_bytes).groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("response")).where("n > 1 and response is not null")
    # Read back as a table of its own: a copy group of any size is then a skewed join that Spark splits.
    several = saved(several.select("sha", "response"), "payloads")
    pages = pages.join(several, "sha", "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("member", pa.binary())])
        for batch in batches:
            out = []
            for page_id, url, payload, sha, response in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "sha", "response")), strict=True):
                data = record(page_id, url, payload, base64.b32encode(sha).decode(), response if response != page_id else None)
                packed = member(data)
                out.append(packed[:-1] if packed[-1] == 0 else packed)
            yield records(schema, [out])

    pages.mapInArrow(work, "member binary").select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives in `path`: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    A response whose payload doesn't have its digest is an error.
    """
    spans = spark.read.option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).text(path)
    spans = spans.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a byte range come in order.  Parts of members that cross into or out of the range go on with their place."""
        schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("seq", pa.int32()), ("part", pa.binary()), ("data", pa.binary())])
        place, now, seq = None, None, 0
        for batch in batches:
            files, begins, seqs, parts, datas = [], [], [], [], []

            def put(seq: int, part: bytes | None, data: bytes | None) -> None:
                files.append(place[0])
                begins.append(place[1])
                seqs.append(seq)
                parts.append(part)
                datas.append(data)

            for value, *at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place != (at := tuple(at)):
                    if now:  # goes on in the next range of its file
                        put(1 << 30, b"".join(now.parts), None)
                    place, now, seq = at, None, 0
                    if at[1] == 0:  # before the first magic of a file
                        continue
                part = MAGIC + value
                if now is None:
                    if starts_record(part):
                        now = Member()
                    else:
                        if seq >= 0:  # of a member that began in an earlier range
                            put(seq, part, None)
                            seq += 1
                        continue
                seq = -1
                if now.take(part):
                    put(0, None, now.data)
                    now = None
            yield records(schema, [files, begins, seqs, parts, datas])
        if now:
            yield records(schema, [[place[0]], [place[1]], [1 << 30], [b"".join(now.parts)], [None]])

    found = saved(spans.mapInArrow(work, "file string, start long, seq int, part binary, data binary"), "records")

    def joined(key: tuple, table: pa.Table) -> pa.Table:
        """The parts of a file in order: each run of them is a member, or padding."""
        table = table.sort_by([("start", "ascending"), ("seq", "ascending")])
        out, now = [], None
        for seq, part in zip(table.column("seq").to_pylist(), table.column("part").to_pylist(), strict=True):
            if seq == 1 << 30:
                now = Member()
            if now and now.take(part):
                out.append(now.data)
                now = None
        return pa.table({"data": pa.array(out, pa.binary())})

    # Members with a false magic just where a range begins: few, about one in 2^24 ranges.
    crossing = found.where("part is not null").select("file", "start", "seq", "part").groupBy("file").applyInArrow(joined, "data binary")
    whole = found.where("data is not null").select("data").unionByName(crossing)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            rows = [parsed(d) for d in batch.column(0).to_pylist()]
            for page_id, _, kind, _, _, digest, payload in rows:
                if kind == "response" and digest_of(payload) != digest:
                    raise ValueError(f"page {page_id}: the payload doesn't have its digest {digest}")
            yield records(schema, [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * len(schema))

    return whole.mapInArrow(decode, READ_SCHEMA)


def archived(pages: DataFrame, min_dedup_bytes: int = 0) -> DataFrame:
    """The pages written as archives and read back."""
    path = scratch_path(pages.sparkSession, "archives")
    write_archives(pages, path, min_dedup_bytes)
    return read_archives(pages.sparkSession, path)
