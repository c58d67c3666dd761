"""MinHash near-duplicates by HyperMinHash: compressed registers are banded, estimated and verified.

A set of word shingles has `REGISTERS` registers.  The first bits of a shingle's 64-bit hash choose the register, which
keeps, of the least hash that it gets, the count of leading zeros and the `MANTISSA` bits behind the first one: 16 bits.
Bands of `BAND` registers are keys under which sets meet.  Of two sets with a similarity of 0.8 all 42 bands differ with
a probability of 8e-14.  Sets of `SMALL` shingles and fewer meet by a prefix of their shingles as well, which is exact:
two of them that are similar enough share one of the first n - ceil(4 n / 5) + 1 of each in the order of the hashes.

Where sets meet, their sizes bound what is worth a look.  The registers of what is left are compared: of the share of equal
ones the share that equal by accident (a closed form of the two sizes) is taken off, and a pair goes on if its estimate is no
more than `SIGMAS` deviations below what is asked.  Then the whole sets decide.

Large classes: a set is compared with one of every bucket first, the one that meets most others in all its buckets: what
near copies were copied from is in the most.  After that only sets of a bucket that aren't in one component are compared,
and no pair of them is ever written: a task finds the members of a bucket that have a likely partner in it with which they
share no earlier band, the members get their texts, and a task that has all of a bucket's counts what they share in one
product of matrices and hands on no more links than join them.  Buckets of more than `BLOCK` sets, or of more than
`BLOCK_SHINGLES` shingles, are dealt out in pairs of blocks, so that no task holds more than two blocks.  Equal sets count as
one, copies cost nothing.  No pair is dropped but by the bounds above, and links are complete up to their probabilities.

Lower-casing and splitting touch ASCII only.  Texts with fewer words than a shingle make one; null, empty and white texts
have no set and are linked with nothing.  A null doc_id is larger than all others; a class of such rows has a null
component_id, and they are kept.  Repeated rows each get their row.  Other columns are ignored, whatever their names.
Shingles, and sets, are told apart by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, drop_saved, marked, marks, records, saved
from .components import connected_components
from .shingles import _Hashes, node_of, shingles, similar
from .substrings import CHUNK, PARTS, PARTS_SCHEMA, in_bits, merged, mixed, slot_parts

WORDS, SIMILAR = 4, (4, 5)
#: Fixed by the 16 bits of a register: 2**7 registers, 10 bits of mantissa, 6 for the zeros; registers of a band.
BITS, MANTISSA, BAND = 7, 10, 3
REGISTERS = 1 << BITS
#: Shingles up to which a set emits a prefix of them; covers every pair in which one set has 32 or fewer.
SMALL = 40
#: Deviations below the asked similarity that an estimate may be.
SIGMAS = 6
#: Sets, and shingles, of a bucket that meet in one block; shingles that are counted at a time.
BLOCK, BLOCK_SHINGLES, COLUMNS = 2048, 1 << 20, 1024
#: Stands for the band of keys that are shingles.
NO_BAND = 127
#: Slots of the sketch of keys for each key, and at most; with fewer more keys are shuffled.
SLOTS, MAX_BITS = 4, 1 << 30


def set_of(text: str | None, words: int = WORDS, hashes: dict | None = None) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles; none without words."""
    if not text or not text.strip(" \t\n\v\f\r"):
        return np.empty(0, np.uint64)
    return shingles(text, words, hashes)


def registers(every: np.ndarray) -> np.ndarray:
    """The registers of a sorted set; 0 stands for an empty one."""
    which = np.arange(REGISTERS, dtype=np.uint64)
    at = np.searchsorted(every, which << np.uint64(64 - BITS))
    least = every[np.minimum(at, len(every) - 1)]
    filled = (at < len(every)) & (least >> np.uint64(64 - BITS) == which)
    # 52 bits of the rest, which a double holds exactly.
    rest = ((least << np.uint64(BITS)) >> np.uint64(12)).astype(np.int64)
    zeros = 52 - np.frexp(rest.astype(np.float64))[1]
    mantissa = (rest << zeros) >> (51 - MANTISSA) & ((1 << MANTISSA) - 1)
    return np.where(filled, (zeros << MANTISSA | mantissa) + 1, 0).astype(np.uint16)


def bands(regs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, band, key) of all bands of some sets' registers that aren't empty."""
    n = REGISTERS // BAND
    parts = regs[:, : n * BAND].reshape(len(regs), n, BAND).astype(np.uint64)
    key = np.arange(1, n + 1, dtype=np.uint64)[None, :].repeat(len(regs), 0)
    for k in range(BAND):
        key = mixed(key * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, k])
    row, band = np.nonzero(parts.any(axis=2))
    return row, band, key[row, band]


def by_accident(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The expected number of registers of two sets of these sizes that are equal though their hashes differ.

    A register's least hash x, of a / b hashes on average, has the density a exp(-a x); registers are equal within cells of
    2**-(zeros + 1 + MANTISSA).
    """
    a, b = np.asarray(n, float)[:, None] / REGISTERS, np.asarray(m, float)[:, None] / REGISTERS
    low = 0.5 ** np.arange(1, 53)[None, :]
    inside = a * b / (a + b) * (np.exp(-(a + b) * low) - np.exp(-2 * (a + b) * low))
    return REGISTERS * 2.0**-MANTISSA * (low * inside).sum(axis=1)


def estimated(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(similarity, registers that it is from) of pairs of sets by their registers, corrected for equal registers of different hashes."""
    either = ((x > 0) | (y > 0)).sum(axis=1)
    equal = ((x == y) & (x > 0)).sum(axis=1)
    return np.clip((equal - by_accident(n, m)) / np.maximum(either, 1), 0, 1), either


def least_estimate(either: np.ndarray, least: tuple[int, int] = SIMILAR) -> np.ndarray:
    """The estimate from so many registers below which a pair isn't looked at."""
    asked = least[0] / least[1]
    return asked - SIGMAS * np.sqrt(asked * (1 - asked) / np.maximum(either, 1))


def near(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, least: tuple[int, int] = SIMILAR) -> np.ndarray:
    """Whether pairs may be similar enough, by their estimates."""
    guess, either = estimated(x, y, n, m)
    return guess >= least_estimate(either, least)


def _rows(docs: DataFrame, words: int, least: tuple[int, int]) -> DataFrame:
    """doc_id, text_hash, node (what stands for the set; null without one), size, regs and, of small sets, prefix."""
    p, q = least
    names = ("doc_id", "text_hash", "node", "size", "regs", "prefix")
    schema = pa.schema(list(zip(names, (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in blocks(batches):
            sets = [set_of(t, words, hashes) for t in batch.column(1).to_pylist()]
            nodes = [node_of(s) if len(s) else None for s in sets]
            prefixes = [s[: len(s) - -(-p * len(s) // q) + 1].tobytes() if 0 < len(s) <= SMALL else None for s in sets]
            yield records(schema, [batch.column(0), batch.column(2), nodes, [len(s) for s in sets], [registers(s).tobytes() if len(s) else None for s in sets], prefixes])

    rows = docs.select("doc_id", "text", _text_hash().alias("text_hash"))
    return saved(rows.mapInArrow(work, "doc_id long, text_hash binary, node long, size int, regs binary, prefix binary"), "sets")


def _text_hash() -> Column:
    return F.unhex(F.md5(F.col("text").cast("binary")))


def _keys(sets: DataFrame) -> DataFrame:
    """key, band, node and size of every band, and of the shingles of small sets' prefixes, that a sketch has seen more than once."""
    schema = pa.schema([("key", pa.int64()), ("band", pa.int8()), ("node", pa.int64()), ("size", pa.int32())])

    def keyed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        regs = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, REGISTERS)
        row, band, key = bands(regs)
        prefixes = [np.frombuffer(p or b"", np.uint64) for p in batch.column(3).to_pylist()]
        n = np.array([len(p) for p in prefixes])
        return np.concatenate([row, np.repeat(np.arange(len(n)), n)]), np.concatenate([band, np.full(n.sum(), NO_BAND)]), np.concatenate([key, *(mixed(p + np.uint64(1)) for p in prefixes)])

    every = sets.select("node", "size", "regs", "prefix")
    n_keys = (REGISTERS // BAND) * sets.count()
    slots = min(max(CHUNK, SLOTS * n_keys), MAX_BITS)
    slot_of = lambda key: mixed(key) % np.uint64(slots)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield records(PARTS_SCHEMA, slot_parts(np.sort(slot_of(keyed(batch)[2])).astype(np.int64), CHUNK))

    shared = every.sparkSession.sparkContext.broadcast(merged(every.mapInArrow(partial, PARTS), slots, CHUNK))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            row, band, key = keyed(batch)
            several = in_bits(shared.value, slot_of(key))
            row, band, key = row[several], band[several], key[several]
            node, size = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            yield records(schema, [pa.array(key.view(np.int64)), pa.array(band.astype(np.int8)), pa.array(node[row]), pa.array(size[row])])

    return every.mapInArrow(emit, "key long, band byte, node long, size int")


def _both(pairs: DataFrame, of: DataFrame, *columns: str) -> DataFrame:
    side = lambda end: of.select(F.col("node").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in columns))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", *(f"{c}_{end}" for end in "ab" for c in columns))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()


def _packed_texts(nodes: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """node and its text, packed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("node", pa.int64()), ("packed", pa.binary())])
        for batch in batches:
            yield records(schema, [batch.column(0), [zlib.compress((t or "").encode("utf-8", "surrogatepass"), 1) for t in batch.column(1).to_pylist()]])

    of = saved(sets.join(nodes, "node", "left_semi").select("node", "text_hash"), "wanted")
    hashed = docs.select("text", _text_hash().alias("text_hash"))
    texts = marked(hashed, marks(of, "text_hash"), "text_hash").join(of, "text_hash").select("node", "text").dropDuplicates(["node"])
    return saved(texts.mapInArrow(pack, "node long, packed binary"), "packed")


def _unpacked(packed: bytes, words: int, hashes: dict) -> np.ndarray:
    return set_of(zlib.decompress(packed).decode("utf-8", "surrogatepass"), words, hashes)


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, words: int, least: tuple[int, int]) -> DataFrame:
    """Of (a, b) pairs of sets those that are similar: by their registers, then by their texts, which are shuffled packed."""
    pair_schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b, n, x, m, y = batch.columns
                regs = [np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in (x, y)]
                good = pa.array(near(*regs, n.to_numpy(), m.to_numpy(), least))
                yield records(pair_schema, [a.filter(good), b.filter(good)])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            last, known = None, np.empty(0, np.uint64)
            good = []
            for i in range(len(a)):
                if x[i] != last:
                    last, known = x[i], _unpacked(x[i], words, hashes)
                if similar(known, _unpacked(y[i], words, hashes), least):
                    good.append(i)
            yield records(pair_schema, [[a[i] for i in good], [b[i] for i in good]])

    pairs = saved(_both(pairs, sets, "size", "regs").mapInArrow(estimate, "a long, b long"), "pairs")
    texts = _packed_texts(_ends(pairs), sets, docs)
    out = saved(_both(pairs, texts, "packed").mapInArrow(compare, "a long, b long"), "similar")
    drop_saved(pairs, texts)
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """The columns of each run of rows that agree in the first so many columns; rows come sorted by them, and a run may go on in the next batch."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            columns = [np.concatenate(x) for x in zip(rest, columns, strict=True)]
        new = np.any([np.diff(c) != 0 for c in columns[:keys]], axis=0)
        cuts = [0, *(np.flatnonzero(new) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield [c[a:b] for c in columns]
        rest = [c[cuts[-1] :].copy() for c in columns]
    if rest is not None:
        yield rest


def with_partners(band: int, i: int, j: int, own: np.ndarray, size: np.ndarray, of: np.ndarray, regs: np.ndarray, least: tuple[int, int]) -> np.ndarray:
    """Which sets of a block pair of a bucket have one there that may be similar, is of another component and shares no band before."""
    p, q = least
    found = np.zeros(len(own), bool)
    first = int(np.searchsorted(own, i, "right"))  # rows of block i
    filled, n_bands = regs > 0, REGISTERS // BAND
    for k in range(first):
        start = k + 1 if i == j else first
        at = np.flatnonzero((of[start:] != of[k]) & (q * np.minimum(size[start:], size[k]) >= p * np.maximum(size[start:], size[k]))) + start
        if not len(at):
            continue
        same = (regs[at] == regs[k]) & filled[k]
        either = (filled[at] | filled[k]).sum(axis=1)
        good = same.sum(axis=1) >= either * least_estimate(either, least)
        at, same = at[good], same[good]
        if len(at) and band < NO_BAND and band:
            # A band is shared where its registers are equal, be they empty or not, and one isn't empty.
            equal = (regs[at, : band * BAND] == regs[k, : band * BAND]).reshape(len(at), -1, BAND).all(axis=2)
            at = at[~(equal & same[:, : n_bands * BAND].reshape(len(at), n_bands, BAND)[:, :band].any(axis=2)).any(axis=1)]
        if len(at):
            found[k] = True
            found[at] = True
    return found


def spanning_links(sets: list[np.ndarray], of: np.ndarray, least: tuple[int, int] = SIMILAR) -> list[tuple[int, int]]:
    """Links (by index) between similar sets of different components, as few as join what all of them join.

    What two sets share is counted in products of matrices of sets by shingles, so many shingles at a time.
    """
    p, q = least
    n = np.array([len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), n)
    shared = times[column] > 1
    row, column = row[shared], (np.cumsum(times > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)  # whole numbers below 2**24
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (k, k + COLUMNS))
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[row[a:b], column[a:b] - k] = 1
        both += part @ part.T
    linked = ((p + q) * both >= p * (n[:, None] + n[None, :])) & (of[:, None] != of[None, :])
    out, left = [], np.ones(len(sets), bool)
    for start in range(len(sets)):
        front = [start] if left[start] else []
        left[start] = False
        while front:
            k = front.pop()
            near_k = np.flatnonzero(linked[k] & left)
            left[near_k] = False
            out += [(k, x) for x in near_k.tolist()]
            front += near_k.tolist()
    return out


def in_block_pairs(rows: DataFrame) -> DataFrame:
    """Rows of key, node and cuts, the key's number of blocks, once for each pair of blocks (i, j) that its block, own, is in."""
    # A row of block i goes to the pairs (0, i), ..., (i, i), (i, i + 1), ...: every two rows meet once.
    own = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    return rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})


def _other_links(met: DataFrame, sets: DataFrame, joined: DataFrame, docs: DataFrame, words: int, least: tuple[int, int], block: int = BLOCK) -> DataFrame:
    """Links between sets that meet in a bucket, are similar and aren't in one component, enough to join what all join."""
    rows = stored = saved(met.where("several > 2").join(joined, "node", "left").select("key", "band", "node", "size", F.coalesce("component", "node").alias("of")), "met")
    mixed_keys = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"), F.min("of").alias("low"), F.max("of").alias("high")).where("low != high")
    cuts = F.ceil(F.greatest(F.col("n") / block, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    rows = rows.join(mixed_keys.select("key", cuts.alias("cuts")), "key").join(sets.select("node", "regs"), "node")
    place = ("key", "i", "j")
    rows = in_block_pairs(rows).select(*place, "own", "band", "node", "size", "of", "regs")
    shuffles = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("node", pa.int64()), ("of", pa.int64())])
        for key, i, j, own, band, node, size, of, regs in _groups(batches, 3):
            if len(key) > 1 and (of != of[0]).any():
                whole = np.frombuffer(b"".join(regs), np.uint16).reshape(len(regs), -1)
                at = with_partners(int(band[0]), int(i[0]), int(j[0]), own, size.astype(np.int64), of, whole, least)
                if at.any():
                    yield records(schema, [pa.array(np.ascontiguousarray(c[at])) for c in (key, i, j, node, of)])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, hashes = pa.schema([("a", pa.int64()), ("b", pa.int64())]), _Hashes()
        for _, _, _, node, of, packed in _groups(batches, 3):
            links = spanning_links([_unpacked(x, words, hashes) for x in packed], of, least)
            yield records(schema, [[int(node[a]) for a, _ in links], [int(node[b]) for _, b in links]])

    found = rows.repartition(shuffles, *place).sortWithinPartitions(*place, "own").mapInArrow(members, "key long, i int, j int, node long, of long")
    found = saved(found, "members")
    drop_saved(stored)
    texts = _packed_texts(found.select("node").distinct(), sets, docs)
    rows = found.join(texts, "node").select(*place, "node", "of", "packed")
    out = saved(rows.repartition(shuffles, *place).sortWithinPartitions(*place).mapInArrow(link, "a long, b long").distinct(), "links")
    drop_saved(found, texts)
    return out


def linked_sets(docs: DataFrame, rows: DataFrame, words: int = WORDS, least: tuple[int, int] = SIMILAR, block: int = BLOCK) -> DataFrame:
    """node, component: the classes of the sets that have a link."""
    of = rows.where("size > 0").groupBy("node").agg(F.min(F.struct("text_hash", "size", "regs", "prefix")).alias("of"))
    sets = saved(of.select("node", "of.*"), "distinct-sets")
    keys = saved(_keys(sets), "keys")
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("several")).where("several > 1")
    met = saved(keys.join(counts, "key"), "met")
    drop_saved(keys)
    weighed = saved(met.join(met.groupBy("node").agg(F.sum("several").alias("weight")), "node"), "meetings")
    drop_saved(met)
    met = weighed
    hubs = met.groupBy("key").agg(F.max(F.struct("weight", "node", "size")).alias("hub"))
    p, q = least
    may = (F.col("node") != F.col("hub.node")) & (q * F.least("size", "hub.size") >= p * F.greatest("size", "hub.size"))
    first = met.join(hubs, "key").where(may).select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()
    first = saved(first, "pairs")
    known = _verified(first, sets, docs, words, least)
    joined = connected_components(known)
    others = _other_links(met, sets, joined, docs, words, least, block)
    drop_saved(met, first)
    return connected_components(known.union(others)) if others.limit(1).count() else joined


def near_duplicates(docs: DataFrame, words: int = WORDS, least: tuple[int, int] = SIMILAR, block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest doc_id reachable over links, itself included) and kept (whether that is its own)."""
    rows = _rows(docs, words, least)
    joined = linked_sets(docs, rows, words, least, block)
    of_set = rows.where("size > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    of_set = saved(of_set.join(joined, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component")), "classes")
    classes = of_set.groupBy("component").agg(F.min("least").alias("component_id"))
    of_set = saved(of_set.join(classes, "component").select("node", "component_id"), "class-of-set")
    out = rows.select("doc_id", "node", "size").join(of_set, "node", "left")
    component = F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("size").cast("long").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
