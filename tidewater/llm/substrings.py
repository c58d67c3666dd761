"""Substring dedup with a count-min prefilter: only windows estimated repeated are grouped exactly.

Pass 1: every task hashes its word windows to the slots of a count-min sketch and sends, for each
chunk of slots, which slots it has seen and which more than once, for as many windows at once as it can
hold (the denser they lie, the fewer bytes each takes); the partition sketches are merged chunk by chunk.  A merged estimate is never below the true count, so a window that repeats is
always estimated repeated.  Pass 2: windows with an estimate of two or more in every row of the sketch
are grouped by a 96-bit hash of their words.  A task settles what it can: windows whose words also
start in a smaller doc_id of those that it holds are removed at once, and only the first document
of each window is shuffled, so a passage in a third of all documents sends a few rows a task.

The sketch has `slots` slots a window and row, at most `max_bits` in all; it is broadcast as one bit a
slot.  What is shuffled is packed: a binary value for each block and part.  Where the bound binds, more windows pass the filter and are grouped: slower, same result.

Null texts have no words.  Rows that share a doc_id never remove each other's words; a null doc_id
counts as larger than any other.  Repeated rows each get their row.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, blocks, count_bytes, records

WINDOW, DEPTH, SLOTS, MAX_BITS = 13, 2, 3, 1 << 30
#: Bytes of text whose windows a task holds at a time.
BLOCK_BYTES = 6 << 20
#: Windows that a task gathers from its blocks before it sends their slots, and windows that passed the filter before it settles them.
SKETCH_WINDOWS, ASKED_WINDOWS = 4_000_000, 2_000_000
#: Sorted slots that are packed in one go, about.
PACKED_SLOTS = 500_000
#: Bytes of text for a window at least, to size the sketch before reading it.
BYTES_A_WORD = 6
#: Slots of the sketch that are merged at a time.
CHUNK = 1 << 18
#: Bytes of text whose hashes, or documents, make a part; starts that a task gathers before it hands them on.
PART_BYTES, FLUSH_STARTS = 16 << 20, 2_000_000
KNOWN_WORDS = 250_000


class WordHashes(dict):
    """Word to 64-bit hash, forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64) | np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def words_of(text: str | None) -> list[bytes]:
    """Splitting bytes splits at 0x20 and 0x09-0x0D only."""
    return (text or "").encode("utf-8", "surrogatepass").split()


class Windows:
    """The windows of a block of texts: hash, row and position of each."""

    def __init__(self, texts: list, window: int, hashes: WordHashes) -> None:
        hashed = [np.array(list(map(hashes.__getitem__, words_of(t))), np.uint64) for t in texts]
        n = np.array([len(w) for w in hashed], np.int64)
        self.words = np.concatenate([np.empty(0, np.uint64), *hashed])
        del hashed
        ends = np.cumsum(n)
        counts = np.maximum(n - window + 1, 0)
        self.row = np.repeat(np.arange(len(n), dtype=np.int32), counts)
        self.pos = (np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
        self.at = (np.repeat(ends - n, counts) + self.pos).astype(np.int32)
        self.window = window

    def hash(self, seed: int, of: np.ndarray | None = None) -> np.ndarray:
        at = self.at if of is None else self.at[of]
        h = np.zeros(len(at), np.uint64)
        for j, m in enumerate(multipliers(self.window, seed)):
            h += self.words[at + j] * m
        return mixed(h)


def slots_of(h: np.ndarray, row: int, width: int) -> np.ndarray:
    """The slot of each hash in a row of the sketch; the rows' slots follow each other."""
    g = mixed(h + np.uint64((row * 0xD1B54A32D192ED03) % (1 << 64)))
    return ((g >> np.uint64(32)) * np.uint64(width) >> np.uint64(32)) + np.uint64(row * width)


def packed(slots: np.ndarray) -> bytes:
    """Increasing numbers as gaps, a byte each; 255 adds to the next."""
    gaps = np.diff(slots, prepend=0)
    ends = np.cumsum(gaps // 255 + 1) - 1
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 255, np.uint8)
    out[ends] = gaps % 255
    return out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, np.uint8)
    return np.cumsum(steps, dtype=np.int64)[steps != 255]


def slot_parts(slots: np.ndarray, size: int) -> list[list]:
    """Sorted slots as (chunk of `size`, slots seen, slots seen more than once) of each chunk, packed."""
    first = np.flatnonzero(np.diff(slots, prepend=-1))
    times = np.diff(first, append=len(slots))
    slots = slots[first]
    cuts = np.flatnonzero(np.diff(slots // size, prepend=-1))
    seen, again, chunks = [], [], (slots[cuts] // size).astype(np.int32)
    low, twice = slots % size, times > 1
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(slots)], strict=True):
        seen.append(packed(low[a:b]))
        again.append(packed(low[a:b][twice[a:b]]))
    return [chunks, seen, again]


PARTS, PARTS_SCHEMA = "chunk int, seen binary, again binary", pa.schema([("chunk", pa.int32()), ("seen", pa.binary()), ("again", pa.binary())])


def merged(parts: DataFrame, slots: int, size: int) -> np.ndarray:
    """One bit for each slot: whether it was seen more than once in all parts together."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by chunk."""
        schema = pa.schema([("chunk", pa.int32()), ("bits", pa.binary())])
        now, counts = None, np.zeros(size, np.uint8)
        for batch in batches:
            done: list[tuple[int, bytes]] = []
            for chunk, seen, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if chunk != now:
                    if now is not None:
                        done.append((now, np.packbits(counts > 1).tobytes()))
                    now, counts = chunk, np.zeros(size, np.uint8)
                at = unpacked(seen)
                counts[at] = np.minimum(counts[at] + 1, 2)
                counts[unpacked(again)] = 2
            if done:
                yield records(schema, [[k for k, _ in done], [b for _, b in done]])
        if now is not None:
            yield records(schema, [[now], [np.packbits(counts > 1).tobytes()]])

    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = parts.repartition(n, "chunk").sortWithinPartitions("chunk").mapInArrow(merge, "chunk int, bits binary").toArrow()
    bits = np.zeros(((slots - 1) // size + 1) * size // 8, np.uint8)
    for batch in whole.to_batches():
        for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            bits[chunk * size // 8 : (chunk + 1) * size // 8] = np.frombuffer(data, np.uint8)
    return bits


def in_bits(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    at = at.astype(np.uint64)
    return (bits[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8) & 1).astype(bool)


def gathered(found: Iterator, most: int, size: Callable = len) -> Iterator[list]:
    """Lists of what comes, each of about `most` windows (one block at least)."""
    held, n = [], 0
    for x in found:
        if held and n + size(x) > most:
            yield held
            held, n = [], 0
        held.append(x)
        n += size(x)
        del x
    if held:
        yield held


def merged_sketch(docs: DataFrame, window: int, depth: int, width: int) -> np.ndarray:
    """One bit for each slot of each row of the sketch: whether its merged count is two or more."""

    def sent(h: np.ndarray) -> Iterator[pa.RecordBatch]:
        for row in range(depth if len(h) else 0):
            slots = slots_of(h, row, width)
            slots.sort()
            # A chunk isn't split: its slots seen twice must be seen together.
            ends = np.searchsorted(slots, (slots[PACKED_SLOTS::PACKED_SLOTS] // np.uint64(CHUNK) + np.uint64(1)) * np.uint64(CHUNK))
            for some in np.split(slots, np.unique(ends)):
                if len(some):
                    yield records(PARTS_SCHEMA, slot_parts(some.astype(np.int64), CHUNK))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for held in gathered((Windows(b.column(0).to_pylist(), window, hashes).hash(1) for b in blocks(batches, "text", BLOCK_BYTES)), SKETCH_WINDOWS):
            yield from sent(np.concatenate(held))

    return merged(docs.select("text").mapInArrow(partial, PARTS), depth * width, CHUNK)


def least_of(h1: np.ndarray, h2: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the smallest id of each group of equal hashes, the group of every row)."""
    order = np.lexsort((ids, h2, h1))
    a, b = h1[order], h2[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return ids[order][new], group


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of n words lie in a window that starts at one of `starts`."""
    steps = np.zeros(n + window + 1, np.int64)
    starts = np.unique(starts)
    steps[starts] += 1
    steps[starts + window] -= 1
    return np.cumsum(steps)[:n] > 0


def pack(docs: np.ndarray, refs: np.ndarray, pos: np.ndarray, h1: np.ndarray | None = None, h2: np.ndarray | None = None) -> bytes:
    """Positions of rows in order of (doc, ref): each run's ids once, steps of doc_ids and positions by byte planes; hashes as they are."""
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (refs[1:] != refs[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(at, append=len(docs)).astype(np.int32)
    planes = lambda x: np.ascontiguousarray(np.diff(x, prepend=x.dtype.type(0)).view(np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes()
    # References don't get shorter.
    rest = refs[at].tobytes() + zlib.compress(planes(docs[at]) + runs.tobytes() + planes(pos.astype(np.int32)), 1)
    hashes = b"" if h1 is None else h1.tobytes() + h2.tobytes()
    return struct.pack("<II", len(docs), len(at)) + hashes + rest


def unpack(data: bytes, hashed: bool) -> tuple[np.ndarray, ...]:
    """(docs, refs, runs, pos) and, if hashed, (h1, h2); docs and refs once a run."""
    n, m = struct.unpack_from("<II", data)
    at = 8 + 12 * n * hashed
    refs = np.frombuffer(data, np.int64, m, at)
    rest = zlib.decompress(memoryview(data)[at + 8 * m :])
    summed = lambda k, kind, start: np.cumsum(np.ascontiguousarray(np.frombuffer(rest, np.uint8, k * kind().itemsize, start).reshape(-1, k).T).view(kind).ravel(), dtype=kind)
    docs, runs, pos = summed(m, np.int64, 0), np.frombuffer(rest, np.int32, m, 8 * m), summed(n, np.int32, 12 * m)
    if not hashed:
        return docs, refs, runs, pos
    return docs, refs, runs, pos, np.frombuffer(data, np.uint64, n, 8), np.frombuffer(data, np.uint32, n, 8 + 8 * n)


def split(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each key, in order."""
    if not len(keys):
        return
    keys = keys.astype(np.int64)
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order], prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)], strict=True):
        yield int(keys[order[a]]), order[a:b]


_BITS: dict[int, np.ndarray] = {}


def sketch_bits(shared) -> np.ndarray:
    """The broadcast sketch, unpacked once a worker."""
    key = id(shared.value)
    if key not in _BITS:
        _BITS.clear()
        _BITS[key] = np.frombuffer(zlib.decompress(shared.value), np.uint8)
    return _BITS[key]


def remove_repeats(docs: DataFrame, window: int = WINDOW, depth: int = DEPTH, slots: float = SLOTS, max_bits: int = MAX_BITS, with_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept, the remaining words joined by one space."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("ref"))
    _, n_bytes = count_bytes(docs)
    width = int(min(max(CHUNK, slots * n_bytes / BYTES_A_WORD), max_bits // depth, (1 << 32) - 1))
    sketch = spark.sparkContext.broadcast(zlib.compress(merged_sketch(docs, window, depth, width).tobytes(), 1))
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Hashes are dealt into parts and documents into shelves; a task takes one of them at a time.
    parts = max(shuffles, n_bytes // PART_BYTES)
    packed_schema = pa.schema([("part", pa.int32()), ("kind", pa.int8()), ("data", pa.binary())])

    def shelves(ids: np.ndarray, refs: np.ndarray, pos: np.ndarray) -> list[tuple[int, int, bytes]]:
        """Starts of windows to remove, packed by the shelf of their document."""
        out = []
        for shelf, at in split(refs.view(np.uint64) % np.uint64(parts)):
            at = at[np.lexsort((pos[at], refs[at], ids[at]))]
            out.append((shelf, 1, pack(ids[at], refs[at], pos[at])))
        return out

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        """(doc_id, ref, position, two hashes) of each block's windows that pass the filter."""
        hashes, bits = WordHashes(), sketch_bits(sketch)
        for batch in blocks(batches, "text", BLOCK_BYTES):
            ids = np.array([NO_ID if i is None else i for i in batch.column(0).to_pylist()], np.int64)
            refs = batch.column(2).to_numpy(zero_copy_only=False)
            windows = Windows(batch.column(1).to_pylist(), window, hashes)
            h1 = windows.hash(1)
            often = np.ones(len(h1), bool)
            for row in range(depth):
                often &= in_bits(bits, slots_of(h1, row, width))
            often = np.flatnonzero(often)
            row = windows.row[often]
            found = ids[row], refs[row], windows.pos[often], h1[often], windows.hash(2, often).astype(np.uint32)
            del windows, h1, often, row
            yield found

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in gathered(passed(batches), ASKED_WINDOWS, lambda found: len(found[0])):
            ids, refs, pos, h1, h2 = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            least, group = least_of(h1, h2, ids)
            settled = ids > least[group]
            out = shelves(ids[settled], refs[settled], pos[settled])
            ask = np.flatnonzero(~settled)
            for part, at in split(h1[ask] % np.uint64(parts)):
                at = ask[at]  # still in order of row and position
                out.append((part, 0, pack(ids[at], refs[at], pos[at], h1[at], h2[at])))
            yield records(packed_schema, [list(c) for c in zip(*out, strict=True)] if out else [[]] * 3)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by part: all places of a window's hash are in one part."""
        kept: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            out = shelves(*(np.concatenate(c) for c in zip(*kept, strict=True))) if kept else []
            kept.clear()
            size = 0
            return records(packed_schema, [list(c) for c in zip(*out, strict=True)] if out else [[]] * 3)

        def removed(group: list[bytes]) -> None:
            nonlocal size
            found = [unpack(data, True) for data in group]
            ids, refs = (np.concatenate([np.repeat(f[i], f[2]) for f in found]) for i in (0, 1))
            pos, h1, h2 = (np.concatenate([f[i] for f in found]) for i in (3, 4, 5))
            least, number = least_of(h1, h2, ids)
            drop = ids > least[number]
            kept.append((ids[drop], refs[drop], pos[drop]))
            size += int(drop.sum())

        now, group = None, []
        for batch in batches:
            through = []
            for part, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 1:
                    through.append((part, 1, data))
                    continue
                if part != now and group:
                    removed(group)
                    group = []
                    if size > FLUSH_STARTS:
                        yield flush()
                now = part
                group.append(data)
            if through:
                yield records(packed_schema, [list(c) for c in zip(*through, strict=True)])
        if group:
            removed(group)
        yield flush()

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("kind", pa.int8()), ("doc_id", pa.int64()), ("ref", pa.int64()), ("data", pa.binary())])
        for batch in batches:
            refs = batch.column(2).to_numpy(zero_copy_only=False)
            data = [zlib.compress(b" ".join(words_of(t)), 1) for t in batch.column(1).to_pylist()]
            yield records(schema, [pa.array((refs.view(np.uint64) % np.uint64(parts)).astype(np.int32)), pa.array(np.full(len(refs), 2, np.int8)), batch.column(0), batch.column(2), data])

    asked = docs.mapInArrow(candidates, "part int, kind byte, data binary").repartition(shuffles, "part").sortWithinPartitions("part", "kind")
    decided = asked.mapInArrow(decide, "part int, kind byte, data binary").select("part", "kind", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("ref"), "data")
    both = decided.unionByName(docs.mapInArrow(texts, "part int, kind byte, doc_id long, ref long, data binary"))

    def kept_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shelf: first what to remove on it, then its texts."""
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())][: 5 if with_text else 4])
        now, starts = None, {}
        for batch in batches:
            out: list[tuple] = []
            for part, kind, doc_id, ref, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    now, starts = part, {}
                if kind == 1:
                    ids, refs, runs, pos = unpack(data, False)
                    ends = np.cumsum(runs)
                    for i, r, a, b in zip(ids.tolist(), refs.tolist(), (ends - runs).tolist(), ends.tolist(), strict=True):
                        starts.setdefault((i, r), []).append(pos[a:b])
                    continue
                words = zlib.decompress(data).split()
                n = len(words)
                if found := starts.get((NO_ID if doc_id is None else doc_id, ref)):
                    drop = covered(n, np.concatenate(found).astype(np.int64), window)
                    words = [w for w, d in zip(words, drop.tolist(), strict=True) if not d]
                text = b" ".join(words)
                out.append((doc_id, n, n - len(words), hashlib.sha256(text).hexdigest(), text.decode("utf-8", "surrogatepass"))[: len(schema)])
            yield records(schema, [list(c) for c in zip(*out, strict=True)] if out else [[]] * len(schema))

    both = both.repartition(shuffles, "part").sortWithinPartitions("part", "kind")
    return both.mapInArrow(kept_words, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
