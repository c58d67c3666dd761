"""Toxicity: a linear classifier over words and word beginnings, regularised by counterfactuals.

A text's features are its different lower-cased words and their beginnings of 3 to 7 letters, hashed to
2**22 numbers.  The classifier is logistic regression with an L1 penalty.  Besides it is fitted on
counterfactual pairs: in every sentence of a labelled text that names a group of people, each such term
is swapped for the next term of its list, and the squared change of the score is penalised.  So a group's
name can't carry weight of its own, and neutral mentions of it aren't taken for toxic.

The model is fitted on the driver, on `max_rows` labelled rows at most, taken in the order of a hash of
their doc_id; that number bounds its memory.  What is broadcast is the model, whose non-zero weights are
fewer than the sample's features.  Every text is scored whole.

Null and empty texts have no features and get the score of the intercept.  Documents without a label, and
labels without a document, don't train.  Without labels of both kinds every text scores the share of the
label 1 (0 without any).  Repeated rows are scored each, and train as often as they are labelled.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, records

MAX_ROWS, BITS, MIN_TEXTS = 10_000, 22, 3
L1, COUNTERFACTUAL, POSITIVE_WEIGHT, STEPS = 3e-4, 1.0, 2.0, 250
THRESHOLD = 0.5
#: Features of a piece in which the fit goes through its rows.
PIECE = 1 << 20
#: Units whose active features a task remembers.
KNOWN_UNITS = 100_000

#: Terms for groups of people, list by list; a term is swapped for the next of its list.
GROUPS = (
    ("women", "men", "girls", "boys", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"),
    ("woman", "man", "girl", "boy", "frau", "mann", "femme", "homme", "mujer", "hombre"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "atheists", "christen", "muslime", "juden", "chrétiens", "musulmans", "juifs", "cristianos", "musulmanes", "judíos"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic", "protestant"),
    ("black", "white", "asian", "latino", "arab", "indigenous", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer", "heterosexual", "homosexual"),
    ("immigrants", "citizens", "refugees", "foreigners", "migrants", "natives"),
    ("mexican", "chinese", "american", "german", "french", "spanish", "indian", "russian", "turkish", "polish", "japanese", "nigerian"),
    ("disabled", "blind", "deaf", "autistic", "elderly", "young", "old"),
)
SWAP = {term: group[(i + 1) % len(group)] for group in GROUPS for i, term in enumerate(group)}

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


def word_features(word: str) -> list[int]:
    return [zlib.crc32(f.encode()) & (1 << BITS) - 1 for f in (word, *(f"^{word[:k]}" for k in range(3, 8) if len(word) > k))]


def features(words: set[str]) -> set[int]:
    return {f for w in words for f in word_features(w)}


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def counterfactuals(text: str) -> list[tuple[list[int], list[int]]]:
    """For each sentence that names a group: the features it loses and those it gains when the terms are swapped."""
    lower, out = text.lower(), []
    if not any(t in lower for t in SWAP):
        return out
    for sentence in _SENTENCE.split(lower):
        words = set(_WORD.findall(sentence))
        if named := words & SWAP.keys():
            before, after = features(words), features(words - named | {SWAP[t] for t in named})
            out.append((sorted(before - after), sorted(after - before)))
    return out


def held_out(folds: int, fold: int) -> Column:
    """Whether crc32 of the doc_id as text leaves the remainder `fold`."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == fold


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, max_rows: int) -> DataFrame:
    """text, y of at most max_rows labelled rows outside the held-out fold: that many labels, and after the join that many rows."""
    labels = labels.select("doc_id", F.col(label).alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(folds, fold))
    labels = labels.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id").select("text", "y", F.xxhash64("doc_id", "text").alias("h"))
    return rows if rows.count() <= max_rows else rows.orderBy("h", "y").limit(max_rows)


class Sparse:
    """Rows of feature numbers, each 1.  Products go through it in pieces of whole rows: beside two numbers of 4 bytes for each feature of a row little is held."""

    def __init__(self, lists: list[np.ndarray], known: np.ndarray | None = None) -> None:
        self.rows = len(lists)
        sizes = np.array([len(x) for x in lists], np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // PIECE)) + 1).tolist(), len(lists)]
        pieces = [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
        flat = lambda piece: np.concatenate([np.empty(0, np.int64), *lists[piece]], dtype=np.int64)
        if known is None:
            n = np.zeros(1 << BITS, np.int32)
            for piece in pieces:
                n += np.bincount(flat(piece), minlength=len(n)).astype(np.int32)
            known = np.flatnonzero(n >= MIN_TEXTS)
            del n
        self.known, self.pieces = known, []
        for piece in pieces:
            features = flat(piece)
            at = np.minimum(np.searchsorted(known, features), max(0, len(known) - 1))
            keep = known[at] == features if len(known) else np.zeros(len(features), bool)
            row = np.repeat(np.arange(piece.stop - piece.start), sizes[piece])
            self.pieces.append((piece, at[keep].astype(np.int32), row[keep].astype(np.int32)))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.concatenate([np.empty(0), *(np.bincount(row, weights=w[at], minlength=piece.stop - piece.start) for piece, at, row in self.pieces)])

    def transposed(self, v: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.known))
        for piece, at, row in self.pieces:
            out += np.bincount(at, weights=v[piece][row], minlength=len(out))
        return out


def fit(texts: list[np.ndarray] | Sparse, y: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], l1: float = L1, counterfactual: float = COUNTERFACTUAL) -> tuple[dict[int, float], float]:
    """Weights by feature and intercept, by accelerated proximal gradient steps."""
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return {}, float(np.clip(np.log((share + 1e-6) / (1 - share + 1e-6)), -14, 14))
    x = texts if isinstance(texts, Sparse) else Sparse(texts)
    lost, gained = (Sparse([np.asarray(p[i]) for p in pairs], x.known) for i in (0, 1))
    weight = np.where(y == 1, POSITIVE_WEIGHT, 1.0) / len(y)
    pull = counterfactual / max(1, len(pairs))

    def curvature(v: np.ndarray) -> np.ndarray:
        change = lost.times(v) - gained.times(v)
        return x.transposed(0.25 * weight * x.times(v)) + 2 * pull * (lost.transposed(change) - gained.transposed(change))

    v = np.ones(len(x.known))
    for _ in range(20):
        v /= np.linalg.norm(v) or 1.0
        v = curvature(v)
    step = 1 / (1.05 * np.linalg.norm(v) or 1.0)
    w, z, b, t = np.zeros(len(x.known)), np.zeros(len(x.known)), 0.0, 1.0
    for _ in range(STEPS):
        g = weight * (1 / (1 + np.exp(-np.clip(x.times(z) + b, -30, 30))) - y)
        change = lost.times(z) - gained.times(z)
        w_new = z - step * (x.transposed(g) + 2 * pull * (lost.transposed(change) - gained.transposed(change)))
        w_new = np.sign(w_new) * np.maximum(np.abs(w_new) - step * l1, 0)
        b -= 2 * float(g.sum())
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = w_new + (t - 1) / t_new * (w_new - w), w_new, t_new
    return {int(x.known[i]): float(w[i]) for i in np.flatnonzero(w)}, b


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, fold: int = 0, max_rows: int = MAX_ROWS, counterfactual: float = COUNTERFACTUAL) -> tuple[dict[int, float], float]:
    """Fits on the labelled rows outside the held-out fold."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.struct([("lost", pa.list_(pa.int32())), ("gained", pa.list_(pa.int32()))])
        schema = pa.schema([("y", pa.int32()), ("h", pa.int64()), ("features", pa.list_(pa.int32())), ("pairs", pa.list_(pair))])
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            yield records(schema, [batch.column(1).cast(pa.int32()), batch.column(2), [sorted(features(words_of(t))) for t in texts], [[{"lost": a, "gained": b} for a, b in counterfactuals(t)] for t in texts]])

    rows = labelled(docs, labels, label, folds, fold, max_rows).mapInArrow(work, "y int, h long, features array<int>, pairs array<struct<lost:array<int>,gained:array<int>>>").toArrow()
    order = pc.sort_indices(rows.select(["h", "y"]), sort_keys=[("h", "ascending"), ("y", "ascending")]).to_pylist()
    y = rows.column("y").to_numpy().astype(float)[order]
    pairs = rows.column("pairs").to_pylist()
    pairs = [(np.array(p["lost"], np.int64), np.array(p["gained"], np.int64)) for i in order for p in pairs[i]]
    lists = [x.values.to_numpy() for chunk in rows.column("features").chunks for x in chunk]  # where they are, not copied
    texts = Sparse([lists[i] for i in order])
    del rows, lists
    pa.default_memory_pool().release_unused()
    return fit(texts, y, pairs, counterfactual=counterfactual)


class Scorer:
    """Scores texts; remembers which features of a unit carry weight, which is none for most."""

    def __init__(self, weights: dict[int, float], intercept: float) -> None:
        self.weights, self.intercept, self.known = weights, intercept, {}

    def score(self, text: str | None) -> float:
        active: set[int] = set()
        known = self.known
        for unit in set((text or "").lower().split()):
            found = known.get(unit)
            if found is None:
                if len(known) > KNOWN_UNITS:
                    known.clear()
                found = known[unit] = tuple(f for w in _WORD.findall(unit) for f in word_features(w) if f in self.weights)
            if found:
                active.update(found)
        total = self.intercept + sum(self.weights[f] for f in sorted(active))
        return 1 / (1 + float(np.exp(-max(-30.0, min(30.0, total)))))


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted (1 from the threshold on)."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, "toxic", folds, fold, max_rows))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
        scorer = Scorer(*model.value)
        for batch in blocks(batches):
            yield records(schema, [batch.column(0), [scorer.score(t) for t in batch.column(1).to_pylist()]])

    scored = docs.select("doc_id", "text").mapInArrow(work, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(folds, fold), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """The documents below the threshold, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, "toxic", folds, fold, max_rows))
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model.value)
        for batch in blocks(batches):
            yield batch.filter(pa.array([scorer.score(t) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
