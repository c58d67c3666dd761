"""Sequence autoencoders over the last rows of a key: an LSTM, which `lstm` fits, or a linear one fitted here."""

from __future__ import annotations

from collections import deque

import numpy as np

from tidewater.config import FEATURES, SETTINGS

from .base import Detector, values


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class LstmWeights:
    """Encoder and decoder LSTM cells with gates in the order input, forget, cell, output, and a linear read-out.

    Names: {enc,dec}_{x,h,b} of shapes (4n, in), (4n, n), (4n); out_w (features, n), out_b.  What `np.savez` keeps.
    """

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.a = {k: np.asarray(v, float) for k, v in arrays.items()}

    def cell(self, name: str, x: np.ndarray, h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i, f, g, o = np.split(self.a[f"{name}_x"] @ x + self.a[f"{name}_h"] @ h + self.a[f"{name}_b"], 4)
        c = sigmoid(f) * c + sigmoid(i) * np.tanh(g)
        return sigmoid(o) * np.tanh(c), c

    def rebuilt(self, z: np.ndarray) -> np.ndarray:
        n = self.a["enc_h"].shape[1]
        h, c = np.zeros(n), np.zeros(n)
        for x in z:
            h, c = self.cell("enc", x, h, c)
        code, out = h, []  # the decoder goes on from the encoder's last state
        for _ in z:
            h, c = self.cell("dec", code, h, c)
            out.append(self.a["out_w"] @ h + self.a["out_b"])
        return np.array(out)


class LinearWeights:
    """The projection on the first `size` principal directions of the flattened sequences."""

    def __init__(self, mean: np.ndarray, directions: np.ndarray) -> None:
        self.mean, self.directions = mean, directions

    @classmethod
    def fit(cls, sequences: np.ndarray, size: int = 8) -> LinearWeights:
        flat = sequences.reshape(len(sequences), -1)
        mean = flat.mean(axis=0)
        _, vectors = np.linalg.eigh(np.cov((flat - mean).T, bias=True))
        return cls(mean, vectors[:, ::-1][:, :size].T)

    def rebuilt(self, z: np.ndarray) -> np.ndarray:
        flat = z.ravel() - self.mean
        return (self.directions.T @ (self.directions @ flat) + self.mean).reshape(z.shape)


class Autoencoder(Detector):
    """0 until the buffer, which never holds the row being scored, is full; then the capped error of rebuilding it."""

    name = "lstm_ae"

    def __init__(self, weights: LstmWeights | LinearWeights | None = None, mean: np.ndarray | None = None, std: np.ndarray | None = None, length: int = SETTINGS.sequence_length) -> None:
        self.weights, self.length = weights, length
        self.mean = np.zeros(len(FEATURES)) if mean is None else np.asarray(mean, float)
        self.std = np.ones(len(FEATURES)) if std is None else np.asarray(std, float)
        self.buffer: deque[list[float]] = deque(maxlen=length)

    def normalised(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / (self.std + 1e-8)

    def score(self, row: dict) -> float:
        if self.weights is None or len(self.buffer) < self.length:
            return 0.0
        z = self.normalised(np.array(self.buffer))
        return 0.0 - min(float(((z - self.weights.rebuilt(z)) ** 2).mean()), 2.0) / 2.0

    def update(self, row: dict) -> None:
        self.buffer.append(values(row))


def fit_linear(rows: np.ndarray, groups: list[np.ndarray], length: int = SETTINGS.sequence_length, size: int = 8) -> Autoencoder:
    """Fits on each group's rows in order; normalisation by all rows' mean and population deviation."""
    mean, std = rows.mean(axis=0), rows.std(axis=0)
    runs = [((g - mean) / (std + 1e-8))[i : i + length] for g in groups for i in range(len(g) - length + 1)]
    return Autoencoder(LinearWeights.fit(np.array(runs), size) if runs else None, mean, std, length)
