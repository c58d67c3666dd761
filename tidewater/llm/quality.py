"""Quality: histogram gradient-boosted trees over document statistics.

A text becomes a vector of `STATISTICS`: sizes, shares of kinds of characters, repetition of words and
lines, word lengths.  Trees grow on binned statistics, level by level, from histograms of gradients; the
forest is flattened into arrays (statistic, threshold, left child, value), and a batch of texts goes
through all trees level by level with numpy indexing.

The forest is fitted on the driver, on the statistics of `max_rows` labelled rows at most, taken in the
order of a hash of their doc_id; that number bounds its memory.  Every text is scored whole.

Null and empty texts have zero statistics and are scored like any other.  Documents without a label, and
labels without a document, don't train.  Without labels of both kinds every text scores the share of the
label 1 (0 without any).  Repeated rows are scored each, and train as often as they are labelled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import records
from .toxicity import held_out, labelled

MAX_ROWS, TREES, DEPTH, BINS, RATE, L2, MIN_HESSIAN = 30_000, 80, 4, 64, 0.15, 1.0, 2.0
THRESHOLD = 0.7

STATISTICS = (
    "log_chars", "log_words", "log_lines", "mean_word", "word_spread", "long_words", "short_words",
    "upper", "lower", "digits", "spaces", "stops", "commas", "marks", "symbols", "pipes", "beyond_ascii",
    "distinct_words", "top_word", "top_3_words", "repeated_next", "distinct_lines", "words_a_line", "title_words", "upper_words",
    "marked_words", "stops_at_line_end", "braces", "slashes", "urls",
)


def statistics(text: str | None) -> list[float]:
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256).tolist()
    n = len(data)
    of = lambda chars: sum(counts[c] for c in chars) / n
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    w = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    times = Counter(words)
    top = [k for _, k in times.most_common(3)]
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), float(lengths.mean()), float(lengths.std()), float((lengths > 14).mean()), float((lengths < 3).mean()),
        of(range(65, 91)), of(range(97, 123)), of(range(48, 58)), of((9, 10, 13, 32)), of(b".!?"), of(b",;:"), of(b"!?"), of(b"#$%&*@^~+=<>"), of(b"|"), of(range(128, 256)),
        len(times) / w, (top[0] if top else 0) / w, sum(top) / w, sum(map(bytes.__eq__, words, words[1:])) / w, len(set(lines)) / max(1, len(lines)), w / max(1, len(lines)),
        sum(map(bytes.istitle, words)) / w, sum(map(bytes.isupper, words)) / w,
        sum(x[-1] in b"#$%&*!|" for x in words) / w, sum(x[-1:] in (b".", b"!", b"?") for x in lines) / max(1, len(lines)), of(b"{}[]()"), of(b"/\\_"), data.count(b"://") / w,
    ]


class Forest:
    """Trees in one set of arrays: a node's statistic (-1: a leaf), threshold, left child (the right one follows) and value."""

    def __init__(self, base: float, depth: int) -> None:
        self.base, self.depth = base, depth
        self.roots: list[int] | np.ndarray = []
        self.statistic: list[int] | np.ndarray = []
        self.threshold: list[float] | np.ndarray = []
        self.left: list[int] | np.ndarray = []
        self.value: list[float] | np.ndarray = []

    def node(self) -> int:
        self.statistic.append(-1)
        self.threshold.append(np.inf)
        self.left.append(0)
        self.value.append(0.0)
        return len(self.statistic) - 1

    def flattened(self) -> Forest:
        self.roots, self.statistic, self.left = (np.array(x, np.int32) for x in (self.roots, self.statistic, self.left))
        self.threshold, self.value = np.array(self.threshold), np.array(self.value)
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        if not len(self.roots) or not len(x):
            return np.full(len(x), self.base)
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            statistic = self.statistic[at]
            inner = statistic >= 0
            right = x[rows, np.maximum(statistic, 0)] > self.threshold[at]
            at = np.where(inner, self.left[at] + right, at)
        return self.base + self.value[at].sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Forest:
    share = float(y.mean()) if len(y) else 0.0
    forest = Forest(float(np.log((share + 1e-6) / (1 - share + 1e-6))), depth)
    if not len(y) or y.min() == y.max():
        return forest.flattened()
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T, strict=True)], axis=1)
    raw = np.full(len(y), forest.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        root = forest.node()
        forest.roots.append(root)
        at = np.full(len(y), root)
        level = [root]
        for _ in range(depth):
            # Histograms of all nodes of the level at once, statistic by statistic.
            number = {node: i for i, node in enumerate(level)}
            place = np.full(len(forest.statistic), -1)
            for node, i in number.items():
                place[node] = i
            here = place[at]
            rows = np.flatnonzero(here >= 0)
            best: list[tuple[float, int, int]] = [(1e-6, -1, 0)] * len(level)
            for s in range(x.shape[1]):
                keys = here[rows] * bins + binned[rows, s]
                sg = np.bincount(keys, weights=g[rows], minlength=len(level) * bins).reshape(len(level), bins)
                sh = np.bincount(keys, weights=h[rows], minlength=len(level) * bins).reshape(len(level), bins)
                lg, lh = np.cumsum(sg, axis=1), np.cumsum(sh, axis=1)
                tg, th = lg[:, -1:], lh[:, -1:]
                gain = lg**2 / (lh + L2) + (tg - lg) ** 2 / (th - lh + L2) - tg**2 / (th + L2)
                gain[(lh < MIN_HESSIAN) | (th - lh < MIN_HESSIAN)] = -1
                gain[:, len(edges[s]) :] = -1
                cut = gain.argmax(axis=1)
                for i in range(len(level)):
                    if gain[i, cut[i]] > best[i][0]:
                        best[i] = (float(gain[i, cut[i]]), s, int(cut[i]))
            following = []
            for node, i in number.items():
                _, s, cut = best[i]
                if s < 0:
                    continue
                left, right = forest.node(), forest.node()
                forest.statistic[node], forest.threshold[node], forest.left[node] = s, float(edges[s][cut]), left
                own = np.flatnonzero(at == node)
                at[own] = np.where(binned[own, s] > cut, right, left)
                following += [left, right]
            level = following
            if not level:
                break
        tg, th = np.bincount(at, weights=g, minlength=len(forest.value)), np.bincount(at, weights=h, minlength=len(forest.value))
        step = -rate * tg / (th + L2)
        for node in np.unique(at):
            forest.value[node] = float(step[node])
        raw += step[at]
    return forest.flattened()


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, fold: int = 2, max_rows: int = MAX_ROWS) -> Forest:
    """Fits on the labelled rows outside the held-out fold."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("y", pa.int32()), ("h", pa.int64()), ("x", pa.list_(pa.float64()))])
        for batch in batches:
            yield records(schema, [batch.column(1).cast(pa.int32()), batch.column(2), [statistics(t) for t in batch.column(0).to_pylist()]])

    rows = labelled(docs, labels, label, folds, fold, max_rows).mapInArrow(work, "y int, h long, x array<double>").toArrow()
    rows = rows.sort_by([("h", "ascending"), ("y", "ascending")]).combine_chunks()
    x = rows.column("x").combine_chunks().flatten().to_numpy() if rows.num_rows else np.empty(0)
    return fit(x.reshape(-1, len(STATISTICS)), rows.column("y").to_numpy().astype(float))


def quality(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted (1 from the threshold on)."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, "quality", folds, fold, max_rows))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
        forest = model.value
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                x = np.array([statistics(t) for t in part.column(1).to_pylist()]).reshape(-1, len(STATISTICS))
                yield records(schema, [part.column(0), forest.scores(x)])

    scored = docs.select("doc_id", "text").mapInArrow(work, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(folds, fold), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
