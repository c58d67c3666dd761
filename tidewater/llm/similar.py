"""Near-copies by the similarity of their word shingles, exactly: SimHash, then a prefix filter for what it can't link.

SimHash links, by ball hashing, what differs in few bits.  Of what is left, two sets with a Jaccard similarity of p/q or
more share an element among the first n - ceil(p n / q) + 1 of each, in any order that is the same for all.  Those
prefixes meet by shingle: a sketch of one bit a slot tells which shingles may be in two of them, and only those are
shuffled.  Of two sets that meet, first their sizes and places and then a sketch of each bound what they can share, and
what is left is verified on the whole sets.  A sketch has slots with a bit each, whether an odd number of the set's shingles is
in it: a shingle that one of two sets has alone changes one bit, so they differ in no fewer shingles than bits.  Shingles that many documents have come last in the order, so that
boilerplate makes no large buckets.  All documents are counted, in a fixed number of slots: no shingle is counted too low,
and rare ones that share a slot with a frequent one come last with it, which changes the order only, not what is found.

Large classes: first each set is compared with one of the bucket, its likely middle.  What that hasn't joined is never
written as pairs: a bucket hands on, of the pairs that sizes, places and sketches leave, no more than join the same sets.
The components of those are clusters, in which all that may be similar is together.  Their members get their texts, once
each, and a task compares a pair of blocks of a cluster's sets and hands on no more links than join them.
Equal sets count as one.  A class is whatever the similarity joins: SimHash's pairs are verified too.

Shingles, and sets, are told apart by 64-bit hashes.  Lower-casing and splitting touch ASCII only.  Fewer than five words
make one shingle; null, empty and white texts are all the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW_KEY, blocks, drop_saved, marked, marks, one_of_each_class, records, saved, with_row_key
from .components import connected_components
from .hyperminhash import _groups, in_block_pairs, spanning_links
from .shingles import KNOWN, WORDS, _Hashes, node_of, shingles, similar
from .simhash import RADIUS, fingerprint, links
from .substrings import CHUNK, PARTS, PARTS_SCHEMA, in_bits, merged, mixed, slot_parts

SIMILAR = 4, 5
#: A slot is at the end of the order if it is met by one in RARE documents and COMMON at least, over the mean of all slots.
COMMON, RARE = 8, 2_500
#: Slots in which the documents of each shingle are counted, and how many go together.
COUNTERS, COUNTERS_TOGETHER = 1 << 22, 1 << 17
#: Slots of the sketch for each shingle of a prefix, and at most; with fewer more shingles are shuffled.
SLOTS, MAX_BITS = 4, 1 << 30
#: Slots of a set's sketch at least; sets, and shingles, of a cluster that meet in one block.
SKETCH, BLOCK, BLOCK_SHINGLES = 512, 1024, 1 << 19
#: Rows of buckets, or pairs, that a task gathers before it hands them on.
PAIRS = 1 << 15


def _may(size, at, sizes, ats, least: tuple[int, int]) -> np.ndarray:
    """Whether sets of these sizes that meet at these places can be similar enough, had they nothing before in common."""
    p, q = least
    return (p + q) * np.minimum(size - at, sizes - ats) >= p * (size + sizes)


def sketch_of(every: np.ndarray) -> bytes:
    """A bit for each slot, half as many as shingles or more: whether an odd number of the set's shingles is in it."""
    slots = max(SKETCH, 1 << (len(every) // 2).bit_length())
    return np.packbits((np.bincount((every % np.uint64(slots)).astype(np.int64), minlength=slots) & 1).astype(bool)).tobytes()


def _folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """The sketch in fewer slots."""
    while len(sketch) > words:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


class Sketches:
    """Sketches of several sets, which tell from below in how many shingles two of them differ: in one for each bit at least."""

    def __init__(self, column: list[bytes]) -> None:
        parts = [np.frombuffer(x, np.uint64) for x in column]
        self.words = np.array([len(x) for x in parts])
        self.by_words = {}
        for n in np.unique(self.words).tolist():
            rows = np.flatnonzero((self.words == n) | (self.words == 2 * n))
            place = np.full(len(parts), -1)
            place[rows] = np.arange(len(rows))
            self.by_words[n] = place, np.stack([_folded(parts[i], n) for i in rows.tolist()])

    def differ(self, k: int, others: np.ndarray) -> np.ndarray:
        fewer, more = np.minimum(self.words[others], self.words[k]), np.maximum(self.words[others], self.words[k])
        out = np.zeros(len(others), np.int64)  # of lengths further apart nothing is known
        for n in {int(self.words[k]), int(self.words[k]) // 2} & self.by_words.keys():
            at = np.flatnonzero((fewer == n) & (more <= 2 * n))
            place, folded = self.by_words[n]
            out[at] = np.bitwise_count(folded[place[others[at]]] ^ folded[place[k]]).sum(axis=1)
        return out


def _near_by_bits(bits, size, sizes, least: tuple[int, int]):
    """Whether sets that differ in so many shingles, or more, can be similar enough."""
    p, q = least
    return (p + q) * bits <= (q - p) * (size + sizes)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def _counter_of(keys: np.ndarray) -> np.ndarray:
    return mixed(keys) % np.uint64(COUNTERS)


def _common_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """A bit for each slot: whether its shingles are at the end of the order.  Every document is counted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = _Hashes(), np.zeros(COUNTERS, np.uint32)
        for batch in blocks(batches):
            found = np.concatenate([shingles(t, words, hashes) for t in batch.column(0).to_pylist()])
            counts += np.bincount(_counter_of(found).astype(np.int64), minlength=COUNTERS).astype(np.uint32)
        parts = [(k, zlib.compress(c.tobytes(), 1)) for k, c in enumerate(np.split(counts, COUNTERS // COUNTERS_TOGETHER)) if c.any()]
        yield records(pa.schema([("part", pa.int32()), ("counts", pa.binary())]), [list(c) for c in zip(*parts, strict=True)] if parts else [[]] * 2)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(zlib.decompress(data), np.uint32).astype(np.int64)
        schema = pa.schema([("part", pa.int32()), ("total", pa.int64()), ("counts", pa.binary())])
        yield records(schema, [list(sums), [int(c.sum()) for c in sums.values()], [zlib.compress(c.tobytes(), 1) for c in sums.values()]])

    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = saved(docs.select("text").mapInArrow(count, "part int, counts binary").repartition(n, "part").mapInArrow(add, "part int, total long, counts binary"), "counts")
    total = counted.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n")).first()["n"]
    least = max(COMMON, docs.count() / RARE) + total / COUNTERS

    def late(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, counts = (c.to_pylist() for c in batch.columns)
            yield records(pa.schema([("part", pa.int32()), ("bits", pa.binary())]), [parts, [np.packbits(np.frombuffer(zlib.decompress(c), np.int64) >= least).tobytes() for c in counts]])

    whole = counted.select("part", "counts").mapInArrow(late, "part int, bits binary").toArrow()  # a bit a slot, not its count
    bits = np.zeros((COUNTERS // COUNTERS_TOGETHER, COUNTERS_TOGETHER // 8), np.uint8)
    for part, data in zip(whole.column(0).to_pylist(), whole.column(1).to_pylist(), strict=True):
        bits[part] = np.frombuffer(data, np.uint8)
    drop_saved(counted)
    return bits.ravel()


def _rows(keyed: DataFrame, common, words: int, least: tuple[int, int]) -> DataFrame:
    """The rows' keys with fp, the SimHash, and node, size, sketch, prefix: what stands for the set, its size, its sketch, its first shingles in order."""
    p, q = least

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(ROW_KEY[0], pa.int64()), (ROW_KEY[1], pa.binary()), ("fp", pa.int64()), ("node", pa.int64()), ("size", pa.int32()), ("sketch", pa.binary()), ("prefix", pa.binary())])
        hashes, last = _Hashes(), common.value
        for batch in blocks(batches):
            fps, nodes, sizes, sketches, prefixes = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                every = shingles(text, words, hashes)
                n = len(every)
                late = in_bits(last, _counter_of(every))
                fps.append(fingerprint(text))
                nodes.append(node_of(every))
                sizes.append(n)
                sketches.append(sketch_of(every))
                prefixes.append(np.concatenate([every[~late], every[late]])[: n - -(-p * n // q) + 1].tobytes())
            yield records(schema, [batch.column(0), batch.column(1), pa.array(np.array(fps, np.uint64).view(np.int64)), nodes, sizes, sketches, prefixes])

    return saved(keyed.select(*ROW_KEY, "text").mapInArrow(work, f"{ROW_KEY[0]} long, {ROW_KEY[1]} binary, fp long, node long, size int, sketch binary, prefix binary"), "nodes")


def _new_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(node, size, at, key) of all shingles of the prefixes of each batch; a set that the task has had lately is left out."""
    known: set[int] = set()
    for batch in batches:
        if len(known) > KNOWN:
            known = set()
        nodes, sizes, keys = [], [], []
        for node, size, prefix in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if node not in known:
                known.add(node)
                nodes.append(node)
                sizes.append(size)
                keys.append(np.frombuffer(prefix, np.uint64))
        if nodes:
            n = np.array([len(k) for k in keys])
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(np.array(nodes, np.int64), n), np.repeat(np.array(sizes, np.int32), n), at.astype(np.int32), np.concatenate(keys)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(key, columns) of each run of equal keys with two rows or more; rows come sorted by key, and a run may go on in the next batch."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            columns = [np.concatenate(x) for x in zip(rest, columns, strict=True)]
        key = columns[0]
        bounds = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
        for i in np.flatnonzero(np.diff(bounds) > 1).tolist():
            yield int(key[bounds[i]]), [c[bounds[i] : bounds[i + 1]] for c in columns[1:]]
        rest = [c[bounds[-1] :].copy() for c in columns]
    if rest is not None and len(rest[0]) > 1:
        yield int(rest[0][0]), rest[1:]


def _meetings(rows: DataFrame, least: tuple[int, int]) -> DataFrame:
    """key, node, size, at, with: the rows of buckets of three sets and more, and in `with` the bucket's middle set where it may be similar."""
    spark = rows.sparkSession
    n_keys = rows.agg(F.coalesce(F.sum(F.octet_length("prefix")), F.lit(0)).alias("n")).first()["n"] // 8
    slots = min(max(CHUNK, SLOTS * n_keys), MAX_BITS)
    slot_of = lambda key: mixed(key) % np.uint64(slots)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, key in _new_sets(batches):
            yield records(PARTS_SCHEMA, slot_parts(np.sort(slot_of(key)).astype(np.int64), CHUNK))

    prefixes = rows.select("node", "size", "prefix")
    shared = spark.sparkContext.broadcast(merged(prefixes.mapInArrow(partial, PARTS), slots, CHUNK))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("size", pa.int32()), ("at", pa.int32())])
        for node, size, at, key in _new_sets(batches):
            several = in_bits(shared.value, slot_of(key))
            yield records(schema, [pa.array(_signed(key[several])), *(pa.array(x[several]) for x in (node, size, at))])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("size", pa.int32()), ("at", pa.int32()), ("with", pa.int64())])
        out: list[list[np.ndarray]] = []
        held = 0
        for key, (node, size, at) in _buckets(batches):
            node, first = np.unique(node, return_index=True)
            if len(node) < 2:
                continue
            size, at = size[first].astype(np.int64), at[first].astype(np.int64)
            # The set with the fewest rare shingles before this one is the most likely middle of a class.
            k = int(np.lexsort((node, at))[0])
            may = _may(size[k], at[k], size, at, least)
            may[k] = False
            if len(node) == 2 and not may.any():
                continue
            take = may if len(node) == 2 else slice(None)
            out.append([np.full(len(node), key, np.int64)[take], node[take], size[take].astype(np.int32), at[take].astype(np.int32), np.where(may, node[k], node)[take]])
            held += len(node)
            if held > PAIRS:
                yield records(schema, [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)])
                out, held = [], 0
        if out:
            yield records(schema, [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = prefixes.mapInArrow(emit, "key long, node long, size int, at int")
    return keyed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(meet, "key long, node long, size int, at int, with long")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()


def _both(pairs: DataFrame, of: DataFrame, *columns: str) -> DataFrame:
    """The pairs with the columns of each end."""
    side = lambda end: of.select(F.col("node").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in columns))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", *(f"{c}_{end}" for end in "ab" for c in columns))


def _packed_texts(nodes: DataFrame, rows: DataFrame, keyed: DataFrame) -> DataFrame:
    """node and a text that has this set, packed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("node", pa.int64()), ("packed", pa.binary())])
        for batch in batches:
            yield records(schema, [batch.column(0), [zlib.compress((t or "").encode("utf-8", "surrogatepass"), 1) for t in batch.column(1).to_pylist()]])

    of = marked(rows, marks(nodes, "node"), "node").join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct(*ROW_KEY)).alias("of"))
    of = saved(of.select("node", *(F.col(f"of.{k}").alias(k) for k in ROW_KEY)), "wanted")
    texts = marked(keyed, marks(of, *ROW_KEY), *ROW_KEY).join(of, ROW_KEY).select("node", "text").dropDuplicates(["node"])
    return saved(texts.mapInArrow(pack, "node long, packed binary"), "packed")


def _unpacked(packed: bytes, words: int, hashes: dict) -> np.ndarray:
    return shingles(zlib.decompress(packed).decode("utf-8", "surrogatepass"), words, hashes)


def _of_nodes(nodes: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """These columns of `rows` for some nodes, once each."""
    return marked(rows, marks(nodes, "node"), "node").join(nodes, "node", "left_semi").select("node", *columns).dropDuplicates(["node"])


def _verified(pairs: DataFrame, rows: DataFrame, keyed: DataFrame, words: int, least: tuple[int, int]) -> DataFrame:
    """Of (a, b) pairs of sets those that are similar: by their sketches, then by their texts, which are shuffled packed."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, m, x, n, y = (c.to_pylist() for c in batch.columns)
            good = []
            for i in range(len(a)):
                u, v = (np.frombuffer(s[i], np.uint64) for s in (x, y))
                words = min(len(u), len(v))
                if _near_by_bits(int(np.bitwise_count(_folded(u, words) ^ _folded(v, words)).sum()), m[i], n[i], least):
                    good.append(i)
            yield records(schema, [[a[i] for i in good], [b[i] for i in good]])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            good = [i for i in range(len(a)) if similar(_unpacked(x[i], words, hashes), _unpacked(y[i], words, hashes), least)]
            yield records(schema, [[a[i] for i in good], [b[i] for i in good]])

    sketches = saved(_of_nodes(_ends(pairs), rows, "size", "sketch"), "sketches")
    pairs = saved(_both(pairs, sketches, "size", "sketch").mapInArrow(bound, "a long, b long"), "pairs")
    texts = _packed_texts(_ends(pairs), rows, keyed)
    out = saved(_both(pairs, texts, "packed").mapInArrow(compare, "a long, b long"), "similar")
    drop_saved(sketches, pairs, texts)
    return out


def _apart(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """The pairs whose sets aren't in one component."""
    of = lambda end: joined.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
    return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where("of_a is null or of_b is null or of_a != of_b").select("a", "b")


def _handed_on(schema: pa.Schema, found: Iterator[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Batches of the columns that are found for one bucket after the other."""
    out: list[list[np.ndarray]] = []
    held = 0
    for columns in found:
        out.append(columns)
        held += len(columns[0])
        if held > PAIRS:
            yield records(schema, [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)])
            out, held = [], 0
    if out:
        yield records(schema, [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)])


def with_partners(size: np.ndarray, at: np.ndarray, of: np.ndarray, least: tuple[int, int]) -> np.ndarray:
    """Which sets of a bucket have one there that is of another component and may be similar by size and place."""
    found = np.zeros(len(size), bool)
    for k in range(len(size) - 1):
        near = (of[k + 1 :] != of[k]) & _may(size[k], at[k], size[k + 1 :], at[k + 1 :], least)
        found[k] |= near.any()
        found[k + 1 :] |= near
    return found


def spanning_pairs(size: np.ndarray, at: np.ndarray, of: np.ndarray, sketches: Sketches, least: tuple[int, int]) -> tuple[list[int], list[int]]:
    """Of the pairs (by index) of a bucket that are of two components and may be similar as few as join what all of them join."""
    a, b, left = [], [], np.arange(len(size))
    while len(left) > 1:
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            k = front.pop()
            may = (of[left] != of[k]) & _may(size[k], at[k], size[left], at[left], least)
            if may.any():
                may[may] = _near_by_bits(sketches.differ(k, left[may]), size[k], size[left[may]], least)
            found = left[may].tolist()
            a += [k] * len(found)
            b += found
            front += found
            left = left[~may]
    return a, b


def _candidates(meetings: DataFrame, joined: DataFrame, rows: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Pairs of sets that meet in a bucket, may be similar and aren't in one component, enough to join what all join."""
    columns = [("key", pa.int64()), ("node", pa.int64()), ("size", pa.int32()), ("at", pa.int32()), ("of", pa.int64())]
    wide = lambda *x: (c.astype(np.int64) for c in x)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[list[np.ndarray]]:
            for key, (node, size, at, of) in _buckets(batches):
                if (of != of[0]).any():
                    some = with_partners(*wide(size, at), of, least)
                    yield [np.full(int(some.sum()), key, np.int64), *(c[some] for c in (node, size, at, of))]

        yield from _handed_on(pa.schema(columns), found())

    def span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[list[np.ndarray]]:
            for _, (node, size, at, of, sketch) in _buckets(batches):
                a, b = spanning_pairs(*wide(size, at), of, Sketches(sketch.tolist()), least)
                yield [np.minimum(node[a], node[b]), np.maximum(node[a], node[b])]

        yield from _handed_on(pa.schema([("a", pa.int64()), ("b", pa.int64())]), found())

    n = int(meetings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = meetings.join(joined, "node", "left").select("key", "node", "size", "at", F.coalesce("component", "node").alias("of"))
    some = saved(every.repartition(n, "key").sortWithinPartitions("key").mapInArrow(members, "key long, node long, size int, at int, of long"), "members")
    sketches = _of_nodes(some.select("node").distinct(), rows, "sketch")
    some_with = some.join(sketches, "node").select("key", "node", "size", "at", "of", "sketch")
    out = saved(some_with.repartition(n, "key").sortWithinPartitions("key", "node").mapInArrow(span, "a long, b long").distinct(), "candidates")
    drop_saved(some)
    return out


def _other_links(candidates: DataFrame, joined: DataFrame, rows: DataFrame, keyed: DataFrame, words: int, least: tuple[int, int]) -> DataFrame:
    """Links between similar sets of one cluster of candidates that aren't in one component, enough to join what all join."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, hashes = pa.schema([("a", pa.int64()), ("b", pa.int64())]), _Hashes()
        for _, _, _, node, of, packed in _groups(batches, 3):
            found = spanning_links([_unpacked(x, words, hashes) for x in packed], of, least)
            yield records(schema, [[int(node[a]) for a, _ in found], [int(node[b]) for _, b in found]])

    clusters = connected_components(candidates).select("node", F.col("component").alias("key"))
    members = clusters.join(joined, "node", "left").join(_of_nodes(clusters.select("node"), rows, "size"), "node")
    members = saved(members.select("key", "node", "size", F.coalesce("component", "node").alias("of")), "members")
    cuts = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("size") / BLOCK_SHINGLES)).cast("int")
    dealt = in_block_pairs(members.join(members.groupBy("key").agg(cuts.alias("cuts")), "key"))
    texts = _packed_texts(members.select("node"), rows, keyed)
    place, n = ("key", "i", "j"), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.join(texts, "node").select(*place, "node", "of", "packed").repartition(n, *place).sortWithinPartitions(*place)
    out = saved(dealt.mapInArrow(link, "a long, b long").distinct(), "links")
    drop_saved(members, texts)
    return out


def keep_one_of_similar(docs: DataFrame, words: int = WORDS, least: tuple[int, int] = SIMILAR, radius: int = RADIUS) -> DataFrame:
    """Of each class of near-copies one document, that with the smallest doc_id (and then hash of its text).

    Linked are documents with a similarity of `least` (p, q) or more over shingles of `words` words; what SimHash finds within
    `radius` bits is verified like all else.  A null doc_id is larger than all others.  Different texts under one doc_id are documents of
    their own; of equal rows one stays.
    """
    common = docs.sparkSession.sparkContext.broadcast(_common_shingles(docs, words))
    keyed = with_row_key(docs)
    rows = _rows(keyed, common, words, least)
    of_fp = saved(rows.groupBy("fp").agg(F.min("node").alias("least")), "distinct-fingerprints")
    end = lambda name: of_fp.select(F.col("fp").alias(name), F.col("least").alias(f"{name}_node"))
    by_bits = links(of_fp, radius).join(end("a"), "a").join(end("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    same_bits = rows.select("fp", "node").distinct().join(of_fp, "fp").where("node != least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    near_bits = by_bits.union(same_bits).where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    known = _verified(saved(near_bits, "pairs"), rows, keyed, words, least)
    joined = connected_components(known).select("node", "component")
    meetings = saved(_meetings(rows, least), "meetings")
    first = meetings.where("with != node").select(F.least("node", "with").alias("a"), F.greatest("node", "with").alias("b")).distinct()
    first = saved(_apart(first, joined), "pairs")
    known = saved(known.union(_verified(first, rows, keyed, words, least)), "links")
    joined = connected_components(known).select("node", "component")
    candidates = _candidates(meetings.drop("with"), joined, rows, least)
    if candidates.limit(1).count():
        joined = connected_components(known.union(_other_links(candidates, joined, rows, keyed, words, least)))
    classes = rows.join(joined, "node", "left").select(F.coalesce("component", "node").alias("class"), *ROW_KEY)
    return one_of_each_class(keyed, classes).select(*docs.columns)
