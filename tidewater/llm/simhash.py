"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at distance d meet if each emits every variant within d/2 bits of it.  Half of a
radius of 3 isn't whole, and balls of radius 2 would be 2081 variants each.  So the 64 bits are cut
into `BLOCKS` blocks: of two different fingerprints some block differs, and without that block at
most two bits are left to differ, for which balls of radius 1 meet.  Every distinct fingerprint emits,
for each block left out, itself and all its one-bit variants over the other bits (131 rows with three
blocks); equal keys are shuffled together, and colliding pairs are verified on all 64 bits.

Copies cost nothing here: only distinct fingerprints emit.  Within a bucket the verified links are
followed breadth first and only those that join something new are kept, at most one fewer than the
bucket has members: no bucket emits all its pairs, and no link between different parts is lost.

Null and empty texts, and texts of white space only, have the fingerprint 0 and link like any other.
Repeated rows each get their row.  Other columns are ignored.  Fewer than three words make one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW_KEY, one_of_each_class, records, saved, with_row_key
from .components import connected_components

WORDS, SEED, RADIUS, BLOCKS = 3, 42, 3, 3
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The 64-bit SimHash of the word shingles; a bit is set if more than half of the shingle hashes have it."""
    # Lower-casing and splitting of bytes touch ASCII only: A-Z, and 0x20 and 0x09-0x0D.
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = list(accumulate(len(p) + 1 for p in parts))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    n = len(parts) - words + 1
    for k in range(0, n, CHUNK):
        hashes = np.array([digest(joined[a : b - 1], seed) for a, b in zip(starts[k : min(k + CHUNK, n)], ends[k + words - 1 :], strict=False)], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), one row per input row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
        for batch in batches:
            fps = np.array([fingerprint(t, words, seed) for t in batch.column(1).to_pylist()], np.uint64)
            yield records(schema, [batch.column(0), pa.array(fps.view(np.int64))])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, fp long")


def block_masks(blocks: int) -> np.ndarray:
    """For each block the mask of the bits that stay when it is left out."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    return np.array([(2**64 - 1) ^ (2**b - 2**a) for a, b in zip(cuts, cuts[1:], strict=False)], np.uint64)


def variants(fps: np.ndarray, mask: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All variants of fps & mask within `radius` bits of the mask: (index of the fingerprint, variant)."""
    flips = [0]
    bits = [1 << i for i in range(64) if int(mask) >> i & 1]
    last = [(0, -1)]
    for _ in range(radius):
        last = [(v | bits[i], i) for v, k in last for i in range(k + 1, len(bits))]
        flips += [v for v, _ in last]
    flips = np.array(flips, np.uint64)
    return np.repeat(np.arange(len(fps)), len(flips)), ((fps & np.uint64(mask))[:, None] ^ flips[None, :]).ravel()


def spanning_links(fps: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Of distinct fingerprints: links at `radius` bits or fewer that join what the links join, as few as that takes."""
    left, a, b = fps, [], []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            node, front = front[0], front[1:]
            near = np.bitwise_count(left ^ node) <= radius
            if near.any():
                found = left[near]
                a += [int(node)] * len(found)
                b += found.tolist()
                front, left = np.concatenate([front, found]), left[~near]
    return a, b


def links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Distinct `fp` values to links (a, b) at `radius` bits or fewer, enough to join what all links join."""
    half = (radius - 1) // 2 if radius % 2 else radius // 2
    masks = block_masks(blocks) if radius % 2 else np.array([2**64 - 1], np.uint64)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.int8()), ("key", pa.int64()), ("fp", pa.int64())])
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(every), 2000):
                part = every[k : k + 2000]
                for i, mask in enumerate(masks):
                    at, keys = variants(part, mask, half)
                    yield records(schema, [pa.array(np.full(len(keys), i, np.int8)), pa.array(keys.view(np.int64)), pa.array(part[at].view(np.int64))])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (block, key): a bucket is a run of rows, and may go on in the next batch."""
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        rest_key, rest = None, np.empty(0, np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            key = batch.column(1).to_numpy(zero_copy_only=False)
            fp = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            edge = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1
            bounds = [0, *edge.tolist(), len(key)]
            out_a: list[int] = []
            out_b: list[int] = []
            first = (int(block[0]), int(key[0]))
            if rest_key == first:
                head = np.concatenate([rest, fp[: bounds[1]]])
            else:
                for o, x in zip((out_a, out_b), spanning_links(np.unique(rest), radius), strict=True):
                    o += x
                head = fp[: bounds[1]]
            if len(bounds) == 2:
                rest_key, rest = first, head
            else:
                sizes = np.diff(bounds)
                runs = [head] + [fp[bounds[i] : bounds[i + 1]] for i in (np.flatnonzero(sizes[1:-1] > 1) + 1).tolist()]
                for run in runs:
                    if len(run) == 2:
                        if run[0] != run[1] and int(run[0] ^ run[1]).bit_count() <= radius:
                            out_a.append(int(run[0]))
                            out_b.append(int(run[1]))
                    elif len(run) > 2:
                        for o, x in zip((out_a, out_b), spanning_links(np.unique(run), radius), strict=True):
                            o += x
                rest_key, rest = (int(block[-1]), int(key[-1])), fp[bounds[-2] :]
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield records(schema, [signed(out_a), signed(out_b)])
        a, b = spanning_links(np.unique(rest), radius)
        yield records(schema, [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)])

    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = fps.select("fp").mapInArrow(emit, "block byte, key long, fp long")
    return keyed.repartition(n, "block", "key").sortWithinPartitions("block", "key").mapInArrow(verify, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id, the smallest doc_id reachable over links."""
    rows = saved(fingerprints(docs, words, seed), "fingerprints")
    distinct = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    joined = connected_components(links(distinct, radius)).withColumnRenamed("node", "fp")
    # The component's label is a fingerprint; its documents' smallest id becomes the class id.
    classes = saved(distinct.join(joined, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "classes")
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = saved(classes.join(least, "component").select("fp", "component_id"), "class-of-fingerprint")
    return rows.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Of each class the document with the smallest doc_id, and of those that share it that with the least hash of its text.

    A null doc_id is larger than all others.  Different texts under one doc_id are documents of their own; of equal rows
    one stays.
    """
    keyed = with_row_key(docs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(ROW_KEY[0], pa.int64()), (ROW_KEY[1], pa.binary()), ("fp", pa.int64())])
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column(2).to_pylist()], np.uint64)
            yield records(schema, [batch.column(0), batch.column(1), pa.array(fps.view(np.int64))])

    rows = saved(keyed.select(*ROW_KEY, "text").mapInArrow(work, f"{ROW_KEY[0]} long, {ROW_KEY[1]} binary, fp long"), "fingerprints")
    joined = connected_components(links(saved(rows.select("fp").distinct(), "distinct-fingerprints"), radius)).withColumnRenamed("node", "fp")
    return one_of_each_class(keyed, rows.join(joined, "fp", "left").select(F.coalesce("component", "fp").alias("class"), *ROW_KEY)).select(*docs.columns)
