"""Periodic runs of words by enumeration of maximal pairs in the tree of LCP intervals.

A maximal pair is two places of one word sequence whose words before differ and whose words behind differ.  Two places
at distance q that share L words make the stretch of L + q words with period q that no neighbour extends, so the maximal
pairs with L >= (exponent - 1) q and L + q >= min_length are exactly the runs: nothing is extended.  A stretch that is
found with several periods keeps the smallest, which divides the others (Fine and Wilf).

(1) Prefix doubling over a block of texts names the suffixes; in each round only those that still share their words with
another of the same text are sorted on.  Places without an equal one near enough for what they share drop out.
(2) What is left is few.  Their LCP intervals are closed bottom up, smaller lists of places into larger ones; the class
of a place is the word to its left.  Places of one interval within L / 2 of each other are an arithmetic progression
whose difference is the period, all but its first have the same left word and all but its last the same right word.  So
a place has at most one partner on either side, of another class and from another child: two searches find it.

Null and empty texts have no words.  Repeated rows each get their row.  Other columns are ignored, whatever their names.
Memory is that of a block of texts, or of one text.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, records

MIN_LENGTH, EXPONENT = 6, 4
#: Bytes of text that are sorted together.
BLOCK_BYTES = 3 << 20
#: Equal words that are compared one by one before whole slices are.
STEPS = 64

Words = list[bytes]
Run = tuple[int, int, int]


def least_shared(min_length: int, exponent: int) -> int:
    """The fewest words that the two places of a run can share."""
    return min(max(min_length - q, (exponent - 1) * q) for q in range(1, min_length + 1))


def near_suffixes(words: np.ndarray, min_length: int, exponent: int) -> np.ndarray:
    """Of the suffixes of a sequence in which every text ends with a word of its own: the places that may be in a run, in suffix order.

    A pair that shares from k to 2k - 1 words is near enough at a distance of (2k - 1) / (exponent - 1) at most.
    """
    n, least = len(words), least_shared(min_length, exponent)
    order = np.argsort(words, kind="stable")
    first = np.flatnonzero(np.diff(words[order], prepend=-1))
    sizes = np.diff(first, append=n)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, sizes)
    left, near, k = order[np.repeat(sizes > 1, sizes)], np.zeros(n, bool), 1
    while len(left):
        key = rank[left] * n + rank[left + k]
        at = np.argsort(key, kind="stable")
        left, key = left[at], key[at]
        group = rank[left]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        sizes = np.diff(first, append=len(left))
        of_group = np.flatnonzero(np.diff(group, prepend=-1))
        rank[left] = group + np.repeat(first, sizes) - np.repeat(of_group, np.diff(of_group, append=len(left)))
        left, k = left[np.repeat(sizes > 1, sizes)], 2 * k
        if 2 * k > least:
            close = (rank[left[1:]] == rank[left[:-1]]) & (np.diff(left) <= (2 * k - 1) // (exponent - 1))
            near[left[1:][close]] = near[left[:-1][close]] = True
    places = np.flatnonzero(near)
    return places[np.argsort(rank[places])]


def shared_words(words: np.ndarray, listed: list[int], suffixes: list[int]) -> list[int]:
    """How many words each suffix shares with the one before it in the list; the places are taken in order, so that most is known."""
    at = {p: r for r, p in enumerate(suffixes)}
    out, known, last, before = [0] * len(suffixes), 0, -2, -2
    for p in sorted(suffixes):
        r = at[p]
        if not r:
            known, last = 0, -2
            continue
        j = suffixes[r - 1]
        known = known - 1 if known and last == p - 1 and before + 1 in at else 0
        step = 0
        while step < STEPS and listed[p + known] == listed[j + known]:
            known, step = known + 1, step + 1
        if step == STEPS:
            known = _compared(words, p, j, known)
        out[r], last, before = known, p, j
    return out


def _compared(words: np.ndarray, p: int, j: int, known: int) -> int:
    size = STEPS
    while True:
        size = min(2 * size, len(words) - known - max(p, j))
        differ = np.flatnonzero(words[p + known : p + known + size] != words[j + known : j + known + size])
        if len(differ):
            return known + int(differ[0])
        known += size


def runs_of(words: np.ndarray, suffixes: list[int], min_length: int, exponent: int) -> list[Run]:
    """(start, length, period) of the runs of one text, whose last word is nowhere else in it, by start, then period."""
    listed = words.tolist()
    shared, least, factor = shared_words(words, listed, suffixes), least_shared(min_length, exponent), exponent - 1
    found: dict[tuple[int, int], int] = {}

    def pair(i: int, j: int, depth: int) -> None:
        q = j - i
        # The word to the left of the first is the last one, which is nowhere else.
        if listed[i - 1] != listed[j - 1] and q + depth >= min_length:
            found[i, q + depth] = min(q, found.get((i, q + depth), q))

    def joined(a: list[int], b: list[int], depth: int) -> list[int]:
        """The places of two children of an interval in order; the maximal pairs between them are noted."""
        if len(a) < len(b):
            a, b = b, a
        reach = depth // factor
        for p in b:
            k = bisect_left(a, p)
            i = bisect_left(a, p - reach, 0, k)
            if i < k:
                pair(a[i], p, depth)
            if k < len(a) and a[k] - p <= reach:
                pair(p, a[k], depth)
        if len(b) < 8:
            for p in b:
                insort(a, p)
        else:
            a += b
            a.sort()
        return a

    open_: list[tuple[int, list[int]]] = []
    child: list[int] = []
    for p, depth in zip([*suffixes, -1], [*shared, 0], strict=True):
        if child:
            while open_ and open_[-1][0] > depth:
                inner, places = open_.pop()
                child = joined(places, child, inner)
            if depth >= least:
                if open_ and open_[-1][0] == depth:
                    child = joined(open_.pop()[1], child, depth)
                open_.append((depth, child))
        child = [p]
    return sorted(((start, length, q) for (start, length), q in found.items()), key=lambda r: (r[0], r[2]))


def block_runs(texts: list[Words], min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> list[list[Run]]:
    """The runs of each of several texts."""
    if exponent < 3 or min_length < 2:
        raise ValueError("runs of an exponent of 3 and a length of 2 words at least")
    numbers: list[int] = []
    starts = [0]
    next_number = 0
    for words in texts:
        known: defaultdict = defaultdict(count(next_number).__next__)
        numbers += map(known.__getitem__, words)
        numbers.append(next_number + len(known))
        next_number += len(known) + 1
        starts.append(len(numbers))
    sequence, bounds = np.array(numbers, np.int64), np.array(starts)
    del numbers
    out: list[list[Run]] = [[] for _ in texts]
    suffixes = near_suffixes(sequence, min_length, exponent)
    if not len(suffixes):
        return out
    # The numbers of a text follow those of the texts before, and so do its suffixes.
    text = np.searchsorted(bounds, suffixes, "right") - 1
    cuts = np.flatnonzero(np.diff(text, prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(suffixes)], strict=True):
        t = int(text[a])
        out[t] = runs_of(sequence[starts[t] : starts[t + 1]], (suffixes[a:b] - starts[t]).tolist(), min_length, exponent)
    return out


def collapsed(words: Words, runs: list[Run]) -> Words:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    steps = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        steps[start + q] += 1
        steps[start + length] -= 1
    return [w for w, over in zip(words, np.cumsum(steps).tolist(), strict=False) if not over]


def find_runs(docs: DataFrame, min_length: int = MIN_LENGTH, exponent: int = EXPONENT, edit: Callable[[int | None, Words], Words] | None = None) -> DataFrame:
    """One row per input row: doc_id, n_words, runs (start, length and period in words, by start, then period) and collapsed, the text without the repeats of its runs.

    edit: what is done to the words of a document first.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run)), ("collapsed", pa.string())])
        for batch in blocks(batches, "text", BLOCK_BYTES):
            ids = batch.column(0).to_pylist()
            # Splitting bytes splits at 0x20 and 0x09-0x0D only.
            texts = [(t or "").encode("utf-8", "surrogatepass").split() for t in batch.column(1).to_pylist()]
            if edit:
                texts = [edit(i, w) for i, w in zip(ids, texts, strict=True)]
            found = block_runs(texts, min_length, exponent)
            flat = [r for runs in found for r in runs]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.StructArray.from_arrays([pa.array([r[k] for r in flat], pa.int64()) for k in range(3)], fields=list(run)))
            rest = pa.array([b" ".join(collapsed(w, r)) for w, r in zip(texts, found, strict=True)], pa.binary()).cast(pa.string())
            yield records(schema, [batch.column(0), [len(w) for w in texts], lists, rest])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(doc_id: int | None, words: Words) -> Words:
    """Every tenth document, by the hash of its id, goes on in a period from some word on; documents without an id stay."""
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    part = words[start : start + period]
    return words[:start] + (part * -(-(n - start) // period))[: n - start]


def digests(found: DataFrame) -> DataFrame:
    """doc_id, the number of runs, the run of the highest exponent, and digests of the runs and of the collapsed text."""
    # Quotients of numbers of up to 2**26 differ, as doubles, where they differ.
    best = F.array_max(F.transform("runs", lambda r: F.struct((r["length"] / r["period"]).alias("exponent"), (-r["start"]).alias("start"), (-r["period"]).alias("period"), r["length"].alias("length"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    rows = found.withColumns({"best": best, "lines": F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))})
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div -best.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
