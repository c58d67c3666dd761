"""Half-space trees (Tan, Ting, Liu 2011): masses of random half-spaces, compared with the last full window."""

from __future__ import annotations

import numpy as np

from tidewater.config import FEATURES, SETTINGS

from .base import Detector, values


class HalfSpaceTrees(Detector):
    """Features are taken to lie in [0, 1]; larger and smaller ones fall on the outer sides.

    A node splits a random feature's range at a random point of its middle 70 %.  A point's mass is, over the
    trees, mass times 2**depth of the node where it ends: the first with at most `least` of the window's
    points, or a leaf.  The score is 0 until the first window is full.
    """

    name = "hst"

    def __init__(self, trees: int = SETTINGS.hst_trees, height: int = SETTINGS.hst_height, window: int = SETTINGS.hst_window, seed: int = SETTINGS.seed) -> None:
        rng, n, d = np.random.default_rng(seed), 2 ** (height + 1) - 1, len(FEATURES)
        self.height, self.window, self.least = height, window, 0.1 * window
        self.feature = np.zeros((trees, n), np.int64)
        self.cut = np.zeros((trees, n))
        for t in range(trees):
            low, high = {0: np.zeros(d)}, {0: np.ones(d)}
            for node in range(2**height - 1):
                f = int(rng.integers(d))
                a, b = low[node][f], high[node][f]
                c = a + (b - a) * (0.15 + 0.7 * rng.random())
                self.feature[t, node], self.cut[t, node] = f, c
                for child, edge, side in ((2 * node + 1, c, "high"), (2 * node + 2, c, "low")):
                    low[child], high[child] = low[node].copy(), high[node].copy()
                    (high if side == "high" else low)[child][f] = edge
        self.masses = np.zeros((trees, n))
        self.latest = np.zeros((trees, n))
        self.seen = 0
        self.trees = np.arange(trees)

    def walk(self, x: np.ndarray) -> np.ndarray:
        """The nodes on the way of each row of `x` through each tree: height + 1, rows, trees."""
        rows, at = np.arange(len(x))[:, None], np.zeros((len(x), len(self.trees)), np.int64)
        out = [at]
        for _ in range(self.height):
            at = 2 * at + 1 + (x[rows, self.feature[self.trees, at]] >= self.cut[self.trees, at])
            out.append(at)
        return np.stack(out)

    def rate(self, paths: np.ndarray) -> np.ndarray:
        """1 for a point where no mass is, towards 0 where all of it is."""
        if self.seen < self.window:
            return np.zeros(paths.shape[1])
        masses = self.masses[self.trees, paths]
        few = masses <= self.least
        end = np.where(few.any(axis=0), few.argmax(axis=0), self.height)
        total = (np.take_along_axis(masses, end[None], 0)[0] * 2.0**end).sum(axis=1)
        return 1.0 - total / (len(self.trees) * self.window * 2.0**self.height)

    def learn(self, paths: np.ndarray) -> None:
        """Rows that don't reach beyond the window's end."""
        np.add.at(self.latest, (self.trees, paths), 1)
        self.seen += paths.shape[1]
        if self.seen % self.window == 0:
            self.masses, self.latest = self.latest, np.zeros_like(self.latest)

    def score(self, row: dict) -> float:
        return float(0.0 - np.minimum(3.0 * self.rate(self.walk(np.array([values(row)]))), 1.0)[0])

    def update(self, row: dict) -> None:
        self.learn(self.walk(np.array([values(row)])))

    def replay(self, x: np.ndarray) -> np.ndarray:
        """Scores of rows in order, each scored and then learned, a window at a time."""
        out = [np.zeros(0)]
        while len(x):
            left = self.window - self.seen % self.window
            paths, x = self.walk(x[:left]), x[left:]
            out.append(0.0 - np.minimum(3.0 * self.rate(paths), 1.0))
            self.learn(paths)
        return np.concatenate(out)
