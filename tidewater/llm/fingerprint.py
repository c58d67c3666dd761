"""Canonical exact fingerprints of documents.

A text's canonical form is NFKC, case-folded, normalised again, with every run of white space one space
and none at the ends.  The fingerprint is the 128-bit xxh3 digest of the form's UTF-8 bytes, 32 hex
digits.  Equal digests are grouped and the canonical bytes are compared inside each bucket; were two
forms ever to share a digest, those after the first (in byte order) get `-1`, `-2`, ... appended.  So
equal texts have equal fingerprints, and equal fingerprints have equal canonical texts.

The grouping shuffles narrow rows (digest, length).  Only digests that occur more than once send their
canonical bytes, combined in each task first, so that a group of copies sends one row a task.

Null texts are empty.  Repeated rows each get their row.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import records, saved, texts_of

#: Documents in one range of the order of doc_id, and ranges at most.
RANGE_ROWS, MAX_RANGES = 500, 4000


def canonical(text: str | None) -> bytes:
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split()).encode("utf-8", "surrogatepass")


def digest(data: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(data)


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def likeness(a: bytes, b: bytes) -> float:
    """1 for equal canonical forms, else 0: an exact fingerprint knows nothing in between."""
    return float(a == b)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.string())])
        for batch in batches:
            yield records(schema, [batch.column(0), [digest(canonical(t)) for t in batch.column(1).to_pylist()]])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, digest string")


def collisions(docs: DataFrame, digests: DataFrame) -> dict[tuple[str, bytes], int]:
    """The canonical forms that share their digest with a smaller one, with their place among those.

    Nobody knows two such texts: of n texts, n * n / 2**129 pairs are to be expected.  That bounds the result.
    """
    slots = 1 << min(28, max(16, (16 * digests.count()).bit_length()))
    several = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # A fixed number of bits tells the tasks which digests may repeat; it only ever says yes too often.
    slot = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") % slots
    maps = several.groupBy(F.bitmap_bucket_number(slot + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot + 1)).alias("bits")).toArrow()
    bits = np.zeros(slots // 8, np.uint8)
    for bucket, data in zip(maps.column("bucket").to_pylist(), maps.column("bits").to_pylist(), strict=True):
        bits[(bucket - 1) * len(data) : bucket * len(data)] = np.frombuffer(data, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits.tobytes())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("digest", pa.string()), ("form", pa.binary())])
        marked = shared.value
        for batch in batches:
            rows = {}
            for text in batch.column(0).to_pylist():
                form = canonical(text)
                d = digest(form)
                at = int(d[:8], 16) % slots
                if marked[at >> 3] >> (at & 7) & 1:
                    rows[form] = d
            yield records(schema, [list(rows.values()), [zlib.compress(f, 1) for f in rows]])

    # Grouping by the bytes compares them; equal forms are one row for each task.
    forms = saved(docs.select("text").mapInArrow(work, "digest string, form binary").groupBy("digest", "form").agg(F.count(F.lit(1)).alias("n")).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) > 1, F.sort_array(F.collect_list("form"))).alias("forms")).where("n > 1"), "collisions")
    found = {}
    for row in forms.toLocalIterator():
        for i, form in enumerate(sorted(zlib.decompress(f) for f in row["forms"])):
            found[row["digest"], form] = i
    return found


def fingerprint(form: bytes, collided: dict[tuple[str, bytes], int]) -> str:
    d = digest(form)
    at = collided.get((d, form), 0) if collided else 0
    return f"{d}-{at}" if at else d


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_chars, fingerprint."""
    docs = docs.select("doc_id", "text")
    collided = docs.sparkSession.sparkContext.broadcast(collisions(docs, saved(digests(docs), "digests")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("fingerprint", pa.string())])
        for batch in batches:
            texts = texts_of(batch)
            yield records(schema, [batch.column(0), [len(t) for t in texts], [fingerprint(canonical(t), collided.value) for t in texts]])

    return docs.mapInArrow(work, "doc_id long, n_chars long, fingerprint string")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, fingerprint, class_id (the smallest doc_id with that fingerprint), copies (rows with it)."""
    rows = saved(fingerprints(docs).select("doc_id", "fingerprint"), "fingerprints")
    groups = saved(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies")), "classes")
    return rows.join(groups, "fingerprint").select("doc_id", "fingerprint", "class_id", "copies")


def compared_with_next(docs: DataFrame) -> DataFrame:
    """Every text against its edited text and against the next document's, by descending doc_id (after the last: the first).

    Rows: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.  A null
    doc_id comes after all others; rows with one doc_id come in the order of a hash of their texts.

    The order is cut into ranges of doc_id, dealt out by a shuffle of the compressed texts.  The first
    document of each range is also sent to the range before it, so no range needs another one.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    rows = saved(digests(docs), "digests")
    collided = spark.sparkContext.broadcast(collisions(docs, rows))
    n = min(MAX_RANGES, max(1, rows.count() // RANGE_ROWS))
    cuts = np.unique(np.array(rows.stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 1e-4) if n > 1 else [], np.int64))

    def ranges(batch: pa.RecordBatch) -> np.ndarray:
        """0 for the largest doc_ids; nulls are in a range of their own, the last."""
        ids = batch.column(0)
        number = len(cuts) - np.searchsorted(cuts, ids.fill_null(0).to_numpy(zero_copy_only=False), side="left")
        return np.where(ids.is_null().to_numpy(zero_copy_only=False), len(cuts) + 1, number)

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("range", pa.int32()), ("doc_id", pa.int64())])
        best: dict[int, int | None] = {}
        for batch in batches:
            for r, i in zip(ranges(batch).tolist(), batch.column(0).to_pylist(), strict=True):
                best[r] = i if i is None else max(best.get(r, i), i)
        yield records(schema, [list(best), list(best.values())])

    # At most MAX_RANGES + 1 rows.
    heads = {r["range"]: r["first"] for r in rows.select("doc_id").mapInArrow(firsts, "range int, doc_id long").groupBy("range").agg(F.max("doc_id").alias("first")).collect()}
    filled = sorted(heads)
    before = {r: filled[i - 1] for i, r in enumerate(filled)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("range", pa.int32()), ("guest", pa.bool_()), ("doc_id", pa.int64()), ("h", pa.int64()), ("data", pa.binary())])
        for batch in batches:
            out: list[tuple] = []
            for r, i, text, h in zip(ranges(batch).tolist(), batch.column(0).to_pylist(), texts_of(batch), batch.column(2).to_pylist(), strict=True):
                data = zlib.compress(text.encode("utf-8", "surrogatepass"), 1)
                out.append((r, False, i, h, data))
                if heads[r] == i:
                    out.append((before[r], True, i, h, data))
            yield records(schema, [list(c) for c in zip(*out, strict=True)] if out else [[]] * 5)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
        last = None
        for batch in batches:
            out: list[tuple] = []
            for r, guest, i, data in zip(*(batch.column(c).to_pylist() for c in ("range", "guest", "doc_id", "data")), strict=True):
                if guest and last and last[0] == r and last[1]:
                    continue
                text = zlib.decompress(data).decode("utf-8", "surrogatepass")
                form = canonical(text)
                if last and last[0] == r and not last[1]:
                    _, _, own_id, own, own_form = last
                    new = edited(own, text)
                    new_form = canonical(new)
                    out.append((own_id, len(own), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint(own_form, collided.value), fingerprint(new_form, collided.value), likeness(own_form, new_form), likeness(own_form, form)))
                last = (r, guest, i, text, form)
            yield records(schema, [list(c) for c in zip(*out, strict=True)] if out else [[]] * 7)

    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.mapInArrow(deal, "range int, guest boolean, doc_id long, h long, data binary").repartition(shuffles, "range")
    dealt = dealt.sortWithinPartitions("range", "guest", F.col("doc_id").desc_nulls_last(), "h")
    return dealt.mapInArrow(compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
