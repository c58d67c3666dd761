"""Best-fit packing of documents into sequences, by vectors.

A sequence has three capacities: tokens, documents and attention cost (the sum of squared piece
lengths).  A piece of length L takes (L, 1, L * L).  Pieces are placed longest first; of the open bins
in which a piece fits under every constraint, the one is taken whose residual after the placement has
the smallest weighted norm (`rule="norm"`) or whose residual has the smallest weighted dot product with
the piece (`rule="dot"`), residuals and pieces as shares of the capacities.

The pieces' vectors depend on their length alone.  So the plan is made from the histogram of lengths,
at most `max_tokens` numbers however large the corpus: bins with equal residuals are one class, a run
of bin numbers, and all pieces of a length are placed class by class, which gives what placing them one
by one would give.  The plan is a short list of segments; each task turns a piece's rank among the
pieces of its length into sequence and offset.  Ranks come from counts of (length, shard), so that even
if all pieces have one length they are ranked in `shards` groups.

Only documents longer than a sequence are cut, into full sequences and a rest.  Null texts are empty and
take one token, the end mark.  Repeated rows are packed each.  Other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, records, row_ref, saved, texts_of
from .tokens import load_tokenizer

MAX_TOKENS, END_ID, SHARDS = 4096, 1, 128
#: tokens, documents, attention cost
WEIGHTS = (1.0, 0.01, 0.01)
#: Words, and parts of words, whose ids a task remembers; longer words aren't remembered.
KNOWN_WORDS, LONG = 600_000, 64

_UNSAFE = re.compile(r"[^\t\n\r -~À-ÖØ-öø-ÿ]")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


class WordIds(dict):
    """White-space-delimited word to the bytes of its ids (unsigned 32-bit, little-endian).

    The tokenizer lower-cases, drops white space and splits what is between, so a text's ids are its
    words' ids one after the other as long as its characters are in the checked alphabet.
    """

    def __init__(self, tokenizer) -> None:
        self.tokenize, self.parts = tokenizer.model.tokenize, {}
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        self.letters = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def __missing__(self, word: str) -> bytes:
        lower = word.lower()
        if lower.isalpha():
            found = self.of_part(lower)
        else:
            found = b"".join([self.of_part(part) for part in _PARTS.findall(lower)])
        if len(word) <= LONG:
            if len(self) > KNOWN_WORDS:
                self.clear()
            self[word] = found
        return found

    def of_part(self, part: str) -> bytes:
        """The ids of a part; words that differ in case or punctuation share their parts."""
        if (found := self.parts.get(part)) is None:
            # Letters of ASCII stand for themselves.
            letters = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.tokenize(letters)]
            found = struct.pack(f"<{len(ids)}I", *ids)
            if len(part) <= LONG:
                if len(self.parts) > KNOWN_WORDS:
                    self.parts.clear()
                self.parts[part] = found
        return found


def ids_of(text: str, tokenizer, words: WordIds) -> bytes:
    if _UNSAFE.search(text) or "<|" in text:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    return b"".join([words[w] for w in text.split()])


def pieces(docs: DataFrame, tokenizer_path: str | Callable[[], str], max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """doc_id, ref, piece, start, length, ids_crc32 of every piece."""
    where = tokenizer_path if callable(tokenizer_path) else lambda: tokenizer_path

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("ref", pa.binary()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        tokenizer = load_tokenizer(where())
        words = WordIds(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in blocks(batches):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                ids, ref = ids_of(text, tokenizer, words) + end, row_ref(doc_id, text)
                for k in range(0, len(ids), 4 * max_tokens):
                    part = ids[k : k + 4 * max_tokens]
                    rows.append((doc_id, ref, k // 4 // max_tokens, k // 4, len(part) // 4, zlib.crc32(part)))
            yield records(schema, [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 6)

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, ref binary, piece int, start long, length long, ids_crc32 long")


class Plan:
    """Segments by length: from rank `first` on, `each` pieces to a bin from number `bin` on, the first at `offset`."""

    def __init__(self) -> None:
        self.segments: dict[int, list[tuple[int, int, int, int]]] = {}
        self.bins = 0

    def place(self, length: int, rank: int) -> tuple[int, int]:
        segments = self.segments[length]
        first, number, each, offset = segments[bisect_right(segments, (rank, 1 << 62)) - 1]
        return number + (rank - first) // each, offset + (rank - first) % each * length


def make_plan(histogram: dict[int, int], max_tokens: int, max_docs: int, max_cost: int, weights: tuple = WEIGHTS, rule: str = "norm") -> Plan:
    """The placement of histogram[L] pieces of each length L.  A single piece must fit an empty bin."""
    capacity, weights = np.array([max_tokens, max_docs, max_cost], float), np.array(weights, float)
    if any(n and (length > max_tokens or length * length > max_cost or max_docs < 1) for length, n in histogram.items()):
        raise ValueError("a piece exceeds a sequence's capacities")
    plan = Plan()
    residuals = np.empty((0, 3), np.int64)
    runs: list[list[tuple[int, int]]] = []  # of each class: (first bin, bins)
    at: dict[tuple, int] = {}

    def add(residual: tuple, run: tuple[int, int]) -> None:
        nonlocal residuals
        if (k := at.get(residual)) is None:
            at[residual] = len(runs)
            residuals = np.vstack([residuals, np.array([residual], np.int64)])
            runs.append([run])
        else:
            runs[k].append(run)

    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        left, rank = histogram[length], 0
        item = np.array([length, 1, length * length], np.int64)
        alive = np.array([bool(r) for r in runs], bool) & (residuals[:, 0] > 0) if runs else np.empty(0, bool)
        if not alive.all():  # full and emptied classes go
            keep = np.flatnonzero(alive)
            residuals, runs = residuals[keep], [runs[i] for i in keep]
            at = {tuple(r): i for i, r in enumerate(residuals.tolist())}
        while left:
            fits = np.flatnonzero((residuals >= item).all(axis=1) & np.array([bool(r) for r in runs], bool)) if runs else np.empty(0, int)
            if len(fits):
                rest = residuals[fits]
                if rule == "norm":
                    cost = (weights * ((rest - item) / capacity) ** 2).sum(axis=1)
                else:
                    cost = (weights * (rest / capacity) * (item / capacity)).sum(axis=1)
                k = int(fits[int(np.argmin(cost))])
                residual, (number, bins) = residuals[k], runs[k].pop()
            else:
                residual, number, bins = capacity.astype(np.int64), plan.bins, None
            each = int((residual // item).min())
            full = left // each if bins is None else min(bins, left // each)
            offset = max_tokens - int(residual[0])
            if full:
                plan.segments.setdefault(length, []).append((rank, number, each, offset))
                add(tuple((residual - each * item).tolist()), (number, full))
                rank, left = rank + full * each, left - full * each
            used = full
            if left and left < each and (bins is None or used < bins):
                plan.segments.setdefault(length, []).append((rank, number + used, each, offset))
                add(tuple((residual - left * item).tolist()), (number + used, 1))
                rank, left, used = rank + left, 0, used + 1
            if bins is None:
                plan.bins += used
            elif used < bins:
                add(tuple(residual.tolist()), (number + used, bins - used))
    return plan


def pack(docs: DataFrame, tokenizer_path: str | Callable[[], str], max_tokens: int = MAX_TOKENS, max_docs: int | None = None, max_cost: int | None = None, weights: tuple = WEIGHTS, rule: str = "norm", end_id: int = END_ID, shards: int = SHARDS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    max_docs, max_cost = max_docs or max_tokens, max_cost or max_tokens * max_tokens
    shard = F.pmod(F.xxhash64("ref", "piece"), F.lit(shards)).cast("int")
    parts = saved(pieces(docs, tokenizer_path, max_tokens, end_id).withColumn("shard", shard), "pieces")
    # At most max_tokens x shards rows.
    counts = parts.groupBy("length", "shard").agg(F.count(F.lit(1)).alias("n")).toArrow()
    before = np.zeros((max_tokens + 1, shards + 1), np.int64)
    before[counts.column("length").to_numpy(), counts.column("shard").to_numpy() + 1] = counts.column("n").to_numpy()
    before = np.cumsum(before, axis=1)
    plan = make_plan({k: int(n) for k, n in enumerate(before[:, -1]) if n}, max_tokens, max_docs, max_cost, weights, rule)
    shared = spark.sparkContext.broadcast((before, plan))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
        before, plan = shared.value
        for batch in batches:
            lengths, shards, ranks = (batch.column(c).to_pylist() for c in ("length", "shard", "rank"))
            found = [plan.place(n, int(before[n, s]) + r - 1) for n, s, r in zip(lengths, shards, ranks, strict=True)]
            yield records(schema, [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), [f[0] for f in found], [f[1] for f in found]])

    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("length", "shard").orderBy("doc_id", "ref", "piece")))
    return ranked.mapInArrow(assign, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
