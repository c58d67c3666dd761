from __future__ import annotations

import random
from dataclasses import replace

import numpy as np

from tidewater.config import FEATURES, SETTINGS
from tidewater.operators import sequence
from tidewater.operators.detectors.adwin import Adwin, DriftMonitor
from tidewater.operators.detectors.autoencoder import Autoencoder, LstmWeights, fit_linear
from tidewater.operators.detectors.ewma import Ewma
from tidewater.operators.detectors.hst import HalfSpaceTrees
from tidewater.operators.detectors.iforest import IsolationForest

USUAL = {"price_change_rate": 0.01, "total_volume": 100.0, "avg_sentiment": 0.1, "sentiment_shift": 0.0}
ODD = {"price_change_rate": 0.5, "total_volume": 100_000.0, "avg_sentiment": -0.9, "sentiment_shift": -0.8}


def test_ewma():
    e = Ewma()
    assert e.score(USUAL) == 0.0
    for i in range(30):
        e.update(USUAL | {"total_volume": 100.0 + i % 3})
    assert -1 <= e.score(ODD) < e.score(USUAL) <= 0
    mean, var = e.state[0]
    assert abs(mean - 0.01) < 1e-12 and var < 1e-20


def test_half_space_trees():
    h = HalfSpaceTrees()
    assert h.score(ODD) == 0.0
    for _ in range(60):
        h.update(USUAL)
    assert -1 <= h.score(ODD) <= h.score(USUAL) <= 0 and h.seen == 60


def test_isolation_forest_is_the_same_again_and_survives_json():
    x = np.random.default_rng(42).normal(size=(200, 4))
    a, b = IsolationForest(trees=50).fit(x), IsolationForest(trees=50).fit(x)
    probe = np.array([[0.1] * 4, [100.0] * 4])
    near, far = a.scores(probe)
    assert near == 0.0 and -1 <= far < 0
    assert (a.scores(x) == b.scores(x)).all() and (IsolationForest.from_json(a.to_json()).scores(x) == a.scores(x)).all()
    assert a.predict(dict(zip(USUAL, [100.0] * 4, strict=True)))[1]
    assert IsolationForest().score(USUAL) == 0.0


def test_autoencoders():
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(200, 4))
    model = fit_linear(rows, [rows])
    fresh = Autoencoder(model.weights, model.mean, model.std)
    for r in rows[:11]:
        fresh.update(dict(zip(USUAL, r, strict=True)))
    assert fresh.score(USUAL) == 0.0
    fresh.update(dict(zip(USUAL, rows[11], strict=True)))
    calm = fresh.score(USUAL)
    for _ in range(3):
        fresh.update(ODD)
    assert -1 <= fresh.score(USUAL) < calm <= 0
    n = 8
    arrays = {"enc_x": rng.normal(size=(4 * n, 4)), "enc_h": rng.normal(size=(4 * n, n)), "enc_b": np.zeros(4 * n), "dec_x": rng.normal(size=(4 * n, n)), "dec_h": rng.normal(size=(4 * n, n)), "dec_b": np.zeros(4 * n), "out_w": rng.normal(size=(4, n)), "out_b": np.zeros(4)}
    assert LstmWeights(arrays).rebuilt(rows[:12]).shape == (12, 4)


def test_adwin_sees_a_shift_and_nothing_else():
    rng = np.random.default_rng(1)
    a = Adwin()
    assert not any(a.update(x) for x in rng.normal(0, 1, 1000))
    assert any(a.update(x) for x in rng.normal(4, 1, 200))
    assert a.width < 1100 and abs(a.total / a.width) > 0.5
    assert DriftMonitor().update(USUAL) == []


def test_blocks_of_half_space_trees_score_as_one_model(spark):
    rng = random.Random(7)
    rows = [(f"T{i % 3}", i, *(0.9 if rng.random() < 0.03 else 0.3 for _ in range(4)), i < 30) for i in range(431)]
    rows[100] = (*rows[100][:4], None, *rows[100][5:])
    model, expected = HalfSpaceTrees(window=20), {}
    for t, i, *x, warm in sorted(rows):
        row = dict(zip(FEATURES, x, strict=True))
        expected[t, i] = 0.0 if warm else model.score(row)
        model.update(row)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "ticker string, at long, " + ", ".join(f"{f} double" for f in FEATURES) + ", warm boolean").repartition(5)
    for windows in (1, 3, 64):
        found = sequence.with_hst(df, ["ticker", "at"], replace(SETTINGS, hst_window=20), warm="warm", windows=windows).collect()
        assert {(r["ticker"], r["at"]): r["hst"] for r in found} == expected and len(found) == len(rows)
    assert len({r["hst"] for r in found}) > 10
    assert sequence.with_hst(df.limit(0), ["ticker", "at"]).collect() == []
