from __future__ import annotations

import numpy as np
import pytest

from tidewater.config import FEATURES
from tidewater.operators import lstm, sequence
from tidewater.operators.detectors.autoencoder import Autoencoder, LstmWeights

H = 5


def table(spark, n=70, tickers=("A", "B")):
    rng = np.random.default_rng(0)
    rows = [(t, i, float(np.sin(i / 3) * 0.01), None if i == 9 else float(1000.0 + 300 * np.cos(i / 2) + rng.normal()), 0.1 * (i % 4), float(rng.normal() * 0.05)) for t in tickers for i in range(n)]
    return spark.createDataFrame(rows, "ticker string, window_end long, price_change_rate double, total_volume double, avg_sentiment double, sentiment_shift double")


def test_gradient_is_that_of_small_steps():
    rng = np.random.default_rng(1)
    z, flat = rng.normal(size=(3, 4, 2)), lstm.first_weights(2, H, 3)
    loss, grad = lstm.gradient(flat, z, H)
    for k in rng.choice(len(flat), 60, replace=False):
        up, down = flat.copy(), flat.copy()
        up[k] += 1e-6
        down[k] -= 1e-6
        assert grad[k] == pytest.approx((lstm.gradient(up, z, H)[0] - lstm.gradient(down, z, H)[0]) / 2e-6, rel=1e-4, abs=1e-6)
    rebuilt = LstmWeights(lstm.named(flat, 2, H)).rebuilt
    assert loss == pytest.approx(sum(((x - rebuilt(x)) ** 2).sum() for x in z))


def by_hand(w, z):
    """An LSTM autoencoder number by number."""
    from math import exp, tanh

    s = lambda x: 1 / (1 + exp(-x))

    def cell(name, x, h, c):
        a = [sum(w[f"{name}_x"][r][k] * v for k, v in enumerate(x)) + sum(w[f"{name}_h"][r][k] * v for k, v in enumerate(h)) + w[f"{name}_b"][r] for r in range(4 * len(h))]
        n = len(h)
        c = [s(a[n + k]) * c[k] + s(a[k]) * tanh(a[2 * n + k]) for k in range(n)]
        return [s(a[3 * n + k]) * tanh(c[k]) for k in range(n)], c

    h, c = [0.0] * H, [0.0] * H
    for x in z:
        h, c = cell("enc", x, h, c)
    code, out = h, []
    for _ in z:
        h, c = cell("dec", code, h, c)
        out.append([sum(w["out_w"][r][k] * v for k, v in enumerate(h)) + w["out_b"][r] for r in range(len(z[0]))])
    return out


def test_inference_number_by_number():
    rng = np.random.default_rng(2)
    weights = lstm.named(lstm.first_weights(2, H, 4) * 3, 2, H)
    z = rng.normal(size=(6, 2))
    assert np.allclose(LstmWeights(weights).rebuilt(z), by_hand({k: v.tolist() for k, v in weights.items()}, z.tolist()), atol=1e-12)


def plain_fit(rows, length, hidden, batch, epochs, workers, seed, shard_of):
    """One process, all sequences in memory."""
    d = len(FEATURES)
    runs = [(t, o, np.array([x[2] for x in group[i : i + length]])) for t, group in rows.items() for i in range(len(group) - length + 1) for o in [group[i + length - 1][1]]]
    every = np.concatenate([v for *_, v in runs])
    mean, std = every.mean(axis=0), every.std(axis=0) + 1e-8
    shards, steps = lstm.plan(len(runs), batch, workers, epochs, seed)
    dealt = {k: [] for k in range(shards)}
    for t, o, v in runs:
        dealt[shard_of[t, o] % shards].append((v - mean) / std)
    flat, losses = lstm.first_weights(d, hidden, seed), []
    m = v2 = 0
    t = 0
    for epoch in steps:
        error = 0
        for of in epoch:
            z = np.array([x for k in of for x in dealt[k]])
            if not len(z):
                continue
            loss, grad = lstm.gradient(flat, z, hidden)
            grad, error, t = grad / z.size, error + loss, t + 1
            m, v2 = 0.9 * m + 0.1 * grad, 0.999 * v2 + 0.001 * grad**2
            flat = flat - 1e-3 * (m / (1 - 0.9**t)) / (np.sqrt(v2 / (1 - 0.999**t)) + 1e-8)
        losses.append(error / (len(runs) * length * d))
    return Autoencoder(LstmWeights(lstm.named(flat, d, hidden)), mean, std, length), losses


def test_the_fit_is_that_of_one_process_and_loads_again(spark, tmp_path):
    from pyspark.sql import functions as F

    df = table(spark)
    model, losses = lstm.fit_lstm(df, ["window_end"], length=6, hidden=8, batch=40, epochs=6, workers=3, rate=1e-3)
    rows = {}
    for r in df.orderBy("ticker", "window_end").collect():
        rows.setdefault(r["ticker"], []).append((None, r["window_end"], [r[c] or 0.0 for c in FEATURES]))
    n = 130
    shards = lstm.plan(n, 40, 3, 6, 42)[0]
    shard_of = {(r["ticker"], r["window_end"]): r["k"] for r in df.select("ticker", "window_end", F.pmod(F.xxhash64("ticker", "window_end", F.lit(42)), F.lit(shards)).alias("k")).collect()}
    twin, expected = plain_fit(rows, 6, 8, 40, 6, 3, 42, shard_of)
    assert np.allclose(losses, expected, atol=1e-9) and losses[-1] < losses[0] and all(a > b for a, b in zip(losses, losses[1:], strict=False))
    path = f"file://{tmp_path}/lstm"
    lstm.save_lstm(spark, model, path)
    score = lambda m: {(r["ticker"], r["window_end"]): r["lstm_ae"] for r in sequence.replay(df, ["window_end"], autoencoder=m).collect()}
    one, two, three = score(model), score(twin), score(lstm.load_lstm(spark, path))
    assert one == three and all(abs(one[k] - two[k]) < 1e-6 for k in one)
    assert {k: v for k, v in one.items() if k[1] < 6} == {(t, i): 0.0 for t in "AB" for i in range(6)} and min(one.values()) < 0


def test_an_odd_sequence_scores_worse(spark):
    df = table(spark, 60, ("A",))
    model, losses = lstm.fit_lstm(df, ["window_end"], length=4, hidden=16, batch=60, epochs=60, workers=1, rate=1e-2)
    assert losses[-1] < 0.6 * losses[0]
    usual = [[r[c] or 0.0 for c in FEATURES] for r in df.orderBy("window_end").limit(4).collect()]
    model.buffer.extend(usual)
    normal = model.score({})
    model.buffer.extend([[0.5, 90_000.0, -1.0, 1.0]] * 4)
    assert model.score({}) == -1.0 < normal <= 0


def test_nothing_to_fit(spark):
    model, losses = lstm.fit_lstm(table(spark, 3), ["window_end"])
    assert model.weights is None and losses == []
