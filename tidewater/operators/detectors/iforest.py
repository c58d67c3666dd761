"""Isolation forest (Liu, Ting, Zhou 2008) in flat arrays; scores whole batches at once."""

from __future__ import annotations

import json

import numpy as np

from tidewater.config import SETTINGS

from .base import Detector, values

#: Rows of a tree, trees, the share of the training rows that counts as anomalous, and the scale of a score.
SAMPLE, TREES, CONTAMINATION, SCALE = 256, 200, 0.05, 0.15


def expected_path(n: np.ndarray | float) -> np.ndarray:
    """The mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    m = np.maximum(n, 2.0)
    return np.where(n > 2, 2 * (np.log(m - 1) + np.euler_gamma) - 2 * (m - 1) / m, np.where(n == 2, 1.0, 0.0))


class IsolationForest(Detector):
    """Features are standardised by mean and population deviation; 0 on the inlier side of the offset, down to -1."""

    name = "isolation_forest"

    def __init__(self, trees: int = TREES, sample: int = SAMPLE, contamination: float = CONTAMINATION, seed: int = SETTINGS.seed) -> None:
        self.trees, self.sample, self.contamination, self.seed = trees, sample, contamination, seed
        self.fitted = False

    def fit(self, x: np.ndarray) -> IsolationForest:
        x = np.asarray(x, float)
        if not len(x):  # nothing to learn from: unfitted, every score is 0
            return self
        self.mean, self.std = x.mean(axis=0), x.std(axis=0)
        self.std = np.where(self.std == 0, 1.0, self.std)
        z, rng = (x - self.mean) / self.std, np.random.default_rng(self.seed)
        n = min(self.sample, len(z))
        depth = int(np.ceil(np.log2(max(2, n))))
        size = 2 ** (depth + 1) - 1
        self.depth, self.n = depth, n
        self.feature = np.full((self.trees, size), -1, np.int64)
        self.cut = np.zeros((self.trees, size))
        self.length = np.zeros((self.trees, size))
        for t in range(self.trees):
            work = [(0, 0, rng.permutation(len(z))[:n])]
            while work:
                node, level, rows = work.pop()
                part = z[rows]
                open_ = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(rows) > 1 and level < depth else []
                if not len(open_):
                    self.length[t, node] = level + float(expected_path(len(rows)))
                    continue
                f = int(rng.choice(open_))
                cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
                self.feature[t, node], self.cut[t, node] = f, cut
                right = part[:, f] > cut
                work += [(2 * node + 1, level + 1, rows[~right]), (2 * node + 2, level + 1, rows[right])]
        self.offset = 0.0
        self.fitted = True
        self.offset = float(np.percentile(self.samples_score(x), 100 * self.contamination))
        return self

    def samples_score(self, x: np.ndarray) -> np.ndarray:
        z = (np.asarray(x, float) - self.mean) / self.std
        at = np.zeros((len(z), self.trees), np.int64)
        rows, trees = np.arange(len(z))[:, None], np.arange(self.trees)[None, :]
        for _ in range(self.depth):
            f = self.feature[trees, at]
            inner = f >= 0
            at = np.where(inner, 2 * at + 1 + (z[rows, np.maximum(f, 0)] > self.cut[trees, at]), at)
        return -(2.0 ** (-self.length[trees, at].mean(axis=1) / float(expected_path(self.n) or 1.0)))

    def decision(self, x: np.ndarray) -> np.ndarray:
        return self.samples_score(x) - self.offset

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.zeros(len(x))
        raw = self.decision(x)
        return np.where(raw >= 0, 0.0, np.maximum(-1.0, raw / SCALE))

    def score(self, row: dict) -> float:
        return float(self.scores(np.array([values(row)]))[0]) if self.fitted else 0.0

    def predict(self, row: dict) -> tuple[float, bool]:
        """(score, whether the row is beyond the offset)."""
        return self.score(row), self.fitted and bool(self.decision(np.array([values(row)]))[0] < 0)

    def to_json(self) -> str:
        keep = {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in vars(self).items()}
        return json.dumps(keep)

    @classmethod
    def from_json(cls, text: str) -> IsolationForest:
        out = cls()
        for k, v in json.loads(text).items():
            setattr(out, k, np.array(v) if isinstance(v, list) else v)
        return out
