"""Fitting of the LSTM autoencoder: synchronous data-parallel steps, gradients in tasks, Adam on the driver.

Sequences are dealt once into shards by a seeded hash and written a file a shard.  An epoch goes through all shards in an
order drawn from the seed, `workers` of them a step: a step reads its shards only, each task goes forward and back through
time over its batches and returns one row, the sum of its gradients, and the driver adds up `workers` rows of some 13,000
numbers and takes one step of Adam.  What a step reads is bounded by the batch size, whatever the table's; the number of
steps isn't, as in any such fit.  The result depends on rows and seed only, up to the order of sums.

Sequences with a null among their features count it as 0, as scoring does.  Without a full sequence there are no weights.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.config import FEATURES, SETTINGS
from tidewater.scratch import scratch

from .detectors.autoencoder import Autoencoder, LstmWeights, sigmoid

#: Adam, as its paper has it.
RATE, BETA1, BETA2, EPSILON = 1e-3, 0.9, 0.999, 1e-8
#: Sequences that a task takes through time together.
AT_ONCE = 1024


def shapes(features: int, hidden: int) -> dict[str, tuple[int, ...]]:
    """The arrays of `LstmWeights`, in the order in which they are flattened."""
    cell = lambda name, inputs: {f"{name}_x": (4 * hidden, inputs), f"{name}_h": (4 * hidden, hidden), f"{name}_b": (4 * hidden,)}
    return {**cell("enc", features), **cell("dec", hidden), "out_w": (features, hidden), "out_b": (features,)}


def first_weights(features: int, hidden: int, seed: int) -> np.ndarray:
    """Uniform within 1 / sqrt(hidden)."""
    n = sum(int(np.prod(s)) for s in shapes(features, hidden).values())
    return np.random.default_rng(seed).uniform(-1, 1, n) / np.sqrt(hidden)


def named(flat: np.ndarray, features: int, hidden: int) -> dict[str, np.ndarray]:
    """The arrays as views of a flat vector."""
    out, at = {}, 0
    for name, shape in shapes(features, hidden).items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def _forward(w: dict, name: str, xs: list[np.ndarray], h: np.ndarray, c: np.ndarray) -> list[tuple]:
    """(input, h and c before, gates, c and h after) of every step."""
    steps = []
    for x in xs:
        i, f, g, o = np.split(x @ w[f"{name}_x"].T + h @ w[f"{name}_h"].T + w[f"{name}_b"], 4, axis=1)
        i, f, g, o = sigmoid(i), sigmoid(f), np.tanh(g), sigmoid(o)
        after = f * c + i * g
        steps.append((x, h, c, i, f, g, o, after, o * np.tanh(after)))
        h, c = steps[-1][8], after
    return steps


def _back(w: dict, d: dict, name: str, steps: list[tuple], dhs: list, dh: np.ndarray, dc: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Adds to the gradients `d`; returns those of the inputs, and of h and c before the first step."""
    dxs = []
    for (x, h, c, i, f, g, o, after, _), outer in zip(reversed(steps), reversed(dhs), strict=True):
        dh = dh + outer
        t = np.tanh(after)
        dc = dc + dh * o * (1 - t * t)
        gates = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dc * i * (1 - g * g), dh * t * o * (1 - o)], axis=1)
        d[f"{name}_x"] += gates.T @ x
        d[f"{name}_h"] += gates.T @ h
        d[f"{name}_b"] += gates.sum(axis=0)
        dxs.append(gates @ w[f"{name}_x"])
        dh, dc = gates @ w[f"{name}_h"], dc * f
    return dxs[::-1], dh, dc


def gradient(flat: np.ndarray, z: np.ndarray, hidden: int) -> tuple[float, np.ndarray]:
    """(sum of squared errors, its gradient) of rebuilding normalised sequences z of shape (n, steps, features)."""
    n, length, features = z.shape
    w = named(flat, features, hidden)
    total = np.zeros_like(flat)
    d = named(total, features, hidden)
    xs = [z[:, k] for k in range(length)]
    zero = np.zeros((n, hidden))
    enc = _forward(w, "enc", xs, zero, zero)
    code, cell = enc[-1][8], enc[-1][7]
    dec = _forward(w, "dec", [code] * length, code, cell)
    errors = [s[8] @ w["out_w"].T + w["out_b"] - x for s, x in zip(dec, xs, strict=True)]
    for e, s in zip(errors, dec, strict=True):
        d["out_w"] += 2 * e.T @ s[8]
        d["out_b"] += 2 * e.sum(axis=0)
    dxs, dh, dc = _back(w, d, "dec", dec, [2 * e @ w["out_w"] for e in errors], zero, zero)
    # The code is the decoder's input at every step and its first state.
    _back(w, d, "enc", enc, [zero] * length, dh + sum(dxs), dc)
    return float(sum((e * e).sum() for e in errors)), total


class Adam:
    def __init__(self, size: int, rate: float = RATE) -> None:
        self.rate, self.m, self.v, self.t = rate, np.zeros(size), np.zeros(size), 0

    def step(self, flat: np.ndarray, grad: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = BETA1 * self.m + (1 - BETA1) * grad
        self.v = BETA2 * self.v + (1 - BETA2) * grad * grad
        return flat - self.rate * (self.m / (1 - BETA1**self.t)) / (np.sqrt(self.v / (1 - BETA2**self.t)) + EPSILON)


def plan(n_sequences: int, batch: int, workers: int, epochs: int, seed: int) -> tuple[int, list[list[list[int]]]]:
    """(number of shards, the shards of every step of every epoch)."""
    steps = max(1, round(n_sequences / batch))
    rng = np.random.default_rng(seed + 1)
    return steps * workers, [[sorted(x) for x in rng.permutation(steps * workers).reshape(steps, workers).tolist()] for _ in range(epochs)]


def sequences(features: DataFrame, order: list[str], length: int) -> DataFrame:
    """v: every run of `length` consecutive rows of a ticker, flattened; ticker and the order's values name it."""
    w = Window.partitionBy("ticker").orderBy(*order)
    row = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in FEATURES))
    rows = features.select("ticker", *order, F.flatten(F.collect_list(row).over(w.rowsBetween(1 - length, 0))).alias("v"), F.row_number().over(w).alias("rn"))
    return rows.where(F.col("rn") >= length).drop("rn")


def norms_of(runs: DataFrame, length: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of sequences, and mean and deviation of each feature over all their rows: one over all sequences, so that inner rows weigh as often as they are in one."""
    k = len(FEATURES)

    def mean_of(c: int, less: float | None = None) -> Column:
        """The mean over all sequences of a feature's mean in one, or of the squares around a value."""
        of = F.filter("v", lambda _, i: i % k == c)
        if less is not None:
            of = F.transform(of, lambda x: (x - less) * (x - less))
        return F.avg(F.aggregate(of, F.lit(0.0), lambda total, x: total + x) / length)

    row = runs.agg(F.count(F.lit(1)), *(mean_of(c) for c in range(k))).first()
    n, mean = row[0], np.array([x or 0.0 for x in row[1:]])
    row = runs.agg(*(mean_of(c, m) for c, m in enumerate(mean.tolist()))).first()
    return n, mean, np.sqrt([x or 0.0 for x in row]) + 1e-8


def fit_lstm(features: DataFrame, order: list[str], length: int = SETTINGS.sequence_length, hidden: int = SETTINGS.hidden, batch: int = 32, epochs: int = 30, workers: int = 4, seed: int = SETTINGS.seed, rate: float = RATE) -> tuple[Autoencoder, list[float]]:
    """(the autoencoder with its norms, the mean squared error of every epoch)."""
    spark = features.sparkSession
    path = scratch(spark, "sequences")
    sequences(features, order, length).write.parquet(path)
    runs = spark.read.parquet(path)
    n, mean, std = norms_of(runs, length)
    if not n:
        return Autoencoder(None, mean, std, length), []
    shards, epochs_steps = plan(n, batch, workers, epochs, seed)
    shard = F.pmod(F.xxhash64("ticker", *order, F.lit(seed)), F.lit(shards)).cast("int")
    dealt = scratch(spark, "shards")
    runs.select("v", shard.alias("shard")).repartition("shard").write.partitionBy("shard").parquet(dealt)
    there = {r["shard"] for r in spark.read.parquet(dealt).select("shard").distinct().collect()}
    d = len(FEATURES)
    flat = first_weights(d, hidden, seed)
    adam, losses = Adam(len(flat), rate), []

    def step(of: list[int], now: np.ndarray) -> tuple[int, float, np.ndarray]:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count, loss, total = 0, 0.0, np.zeros_like(now)
            for b in batches:
                z = (b.column(0).flatten().to_numpy().reshape(-1, length, d) - mean) / std
                for k in range(0, len(z), AT_ONCE):
                    error, grad = gradient(now, z[k : k + AT_ONCE], hidden)
                    loss, total = loss + error, total + grad
                count += len(z)
            yield pa.RecordBatch.from_pydict({"n": pa.array([count], pa.int64()), "loss": pa.array([loss]), "grad": pa.array([total.tolist()], pa.list_(pa.float64()))})

        files = [f"{dealt}/shard={k}" for k in of if k in there]
        if not files:
            return 0, 0.0, np.zeros_like(now)
        parts = spark.read.schema("v array<double>").parquet(*files).mapInArrow(work, "n long, loss double, grad array<double>").toArrow()  # a row a task
        grads = parts.column("grad").combine_chunks().flatten().to_numpy().reshape(parts.num_rows, -1)
        return sum(parts.column("n").to_pylist()), sum(parts.column("loss").to_pylist()), grads.sum(axis=0)

    for steps in epochs_steps:
        error = 0.0
        for of in steps:
            count, loss, grad = step(of, flat)
            if count:
                flat = adam.step(flat, grad / (count * length * d))
                error += loss
        losses.append(error / (n * length * d))
    return Autoencoder(LstmWeights(named(flat, d, hidden)), mean, std, length), losses


def save_lstm(spark: SparkSession, model: Autoencoder, path: str) -> None:
    """Weights and norms as one text file in any store that Spark writes."""
    said = {"weights": {k: v.tolist() for k, v in model.weights.a.items()} if model.weights else None, "mean": model.mean.tolist(), "std": model.std.tolist(), "length": model.length}
    spark.createDataFrame([(json.dumps(said),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_lstm(spark: SparkSession, path: str) -> Autoencoder:
    said = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    return Autoencoder(LstmWeights(said["weights"]) if said["weights"] else None, said["mean"], said["std"], said["length"])
