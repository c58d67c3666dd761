"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as words: lower-cased runs of letters and digits, and in scripts without spaces single
letters.  An item of n words may be changed
by `rate` of its words, k = floor(rate * n) edits (a word added, dropped or replaced).  Cut into k + 1
pieces, an item that occurs with at most k edits has at least one piece unchanged.  All pieces are
searched at once, as strings of whole words (Aho-Corasick); around every hit the item is verified with
Myers' bit-parallel edit distance over words, Python's integers holding items of any length.

Items are taken in blocks of `items_a_pass`, so that what is broadcast is bounded; each block passes
over all documents.  Items of fewer than five words have a budget of 0 edits.

Null texts have no words and match nothing; null and empty items are not searched.  Items repeated under
several ids, and repeated documents, each get their rows.  Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import records

RATE, MIN_WORDS, ITEMS_A_PASS = 0.2, 1, 20_000
MATCHES = "doc_id long, item_id long, distance int, budget int, first_word long, last_word long"
#: Windows whose verification a task remembers: passages that many documents share are verified once.
KNOWN_WINDOWS = 2_000

_BETWEEN = re.compile(r"[\W_]+")
#: Letters of scripts that don't put spaces between words: South-East Asian, Japanese, Chinese.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def normalised(text: str | None) -> str:
    """The words, each with one space on either side."""
    text = (text or "").lower()
    if not text.isascii() and _UNSPACED.search(text):
        text = _UNSPACED.sub(r" \g<0> ", text)
    return f" {_BETWEEN.sub(' ', text).strip()} "


def cut(words: list[str], k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length: (place of the first word, string of whole words)."""
    edges = [len(words) * i // (k + 1) for i in range(k + 2)]
    return [(a, f" {' '.join(words[a:b])} ") for a, b in zip(edges, edges[1:], strict=False)]


def best_match(pattern: list[str], text: list[str]) -> tuple[int, int]:
    """The least edit distance of the pattern to any run of words of the text, and where the first such run ends (exclusive)."""
    m, masks = len(pattern), {}
    for i, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, w in enumerate(text):
        eq = masks.get(w, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        hp = minus | ~(xh | plus) & full
        hm = plus & xh
        if hp & top:
            score += 1
        elif hm & top:
            score -= 1
        hp, hm = hp << 1 & full, hm << 1 & full
        plus = hm | ~(xv | hp) & full
        minus = hp & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    """Finds the items of a block in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        import ahocorasick

        self.items = [(i, n.split()) for i, n in items]
        self.budgets = [int(rate * len(w)) for _, w in self.items]
        places: dict[str, list[tuple[int, int]]] = {}
        for at, ((_, words), k) in enumerate(zip(self.items, self.budgets, strict=True)):
            for place, piece in cut(words, k):
                places.setdefault(piece, []).append((at, place))
        self.search = ahocorasick.Automaton()
        for piece, where in places.items():
            self.search.add_word(piece, (piece.count(" ") - 1, where))
        self.search.make_automaton()
        self.known: dict[tuple, tuple[int, int]] = {}

    def verified(self, at: int, window: tuple[str, ...]) -> tuple[int, int]:
        key = (at, window)
        if (found := self.known.get(key)) is None:
            if len(self.known) > KNOWN_WINDOWS:
                self.known.clear()
            words = self.items[at][1]
            end = best_match(words, list(window))
            # Backwards from there, where the run begins.
            found = self.known[key] = (end[0], end[1], end[1] - best_match(words[::-1], list(window[: end[1]])[::-1])[1] if end[0] <= self.budgets[at] else 0)
        return found

    def find(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """(item_id, distance, budget, first word, last word exclusive), an item's best occurrence each."""
        flat = normalised(text)
        hits: dict[int, set[int]] = {}
        count, seen = 0, 0
        for end, (n, where) in self.search.iter(flat):
            count += flat.count(" ", seen, end)
            seen = end
            for at, place in where:  # the piece's last word is word number count - 1
                hits.setdefault(at, set()).add(count - n - place)
        if not hits:
            return []
        words, out = flat.split(), []
        for at, begins in hits.items():
            (item_id, item), k = self.items[at], self.budgets[at]
            best = None
            low = high = None
            spans = []
            for b in sorted(begins):  # windows that overlap are verified as one
                lo, hi = max(0, b - k), min(len(words), b + len(item) + k)
                if high is not None and lo <= high:
                    high = max(high, hi)
                else:
                    if high is not None:
                        spans.append((low, high))
                    low, high = lo, hi
            spans.append((low, high))
            for lo, hi in spans:
                distance, end, begin = self.verified(at, tuple(words[lo:hi]))
                if distance <= k and (best is None or distance < best[0]):
                    best = (distance, lo + begin, lo + end)
            if best:
                out.append((item_id, best[0], k, best[1], best[2]))
        return out


def item_blocks(benchmark: DataFrame, min_words: int, items_a_pass: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items, normalised, in blocks."""
    rows = benchmark.select("item_id", "text").where("text is not null").orderBy("item_id", "text").toLocalIterator()
    block = []
    for item_id, text in rows:
        flat = normalised(text)
        if len(flat.split()) >= min_words:
            block.append((item_id, flat))
            if len(block) == items_a_pass:
                yield block
                block = []
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, min_words: int = MIN_WORDS, items_a_pass: int = ITEMS_A_PASS) -> DataFrame:
    """A row for each document and item that it holds: distance in words, the budget, and where its best occurrence is, in words."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], MATCHES)
    for block in item_blocks(benchmark, min_words, items_a_pass):
        shared = spark.sparkContext.broadcast(block)

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("budget", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64())])
            matcher = Matcher(shared.value, rate)
            for batch in batches:
                rows = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in matcher.find(t)]
                yield records(schema, [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 6)

        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(work, MATCHES))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, min_words: int = MIN_WORDS, items_a_pass: int = ITEMS_A_PASS) -> DataFrame:
    """The documents that hold no item."""
    at = docs.columns.index("text")
    for block in item_blocks(benchmark, min_words, items_a_pass):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.find(t) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(work, docs.schema)
    return docs
