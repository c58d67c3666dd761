from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.config import SETTINGS
from tidewater.functions import scalars as S
from tidewater.operators import enrich, evaluate, features, inject, order, seen, sequence, training
from tidewater.operators.detectors.hst import HalfSpaceTrees
from tidewater.operators.detectors.iforest import IsolationForest
from tidewater.operators.ensemble import ensemble_score
from tidewater.sources import readers, sinks, tables
from tidewater.streaming import pipeline


def one(df):
    return df.first().asDict()


def test_scalars(spark):
    row = spark.range(1).select(
        S.price_change_rate(F.lit(100.0), F.lit(105.0)).alias("up"),
        S.price_change_rate(F.lit(0.0), F.lit(105.0)).alias("zero"),
        S.volume_surge_ratio(F.lit(300), F.lit(100.0)).alias("ratio"),
        S.volume_surge_ratio(F.lit(300), F.lit(0.0)).alias("none"),
        S.sentiment_shift(F.lit(0.5), F.lit(0.2)).alias("shift"),
        S.signed_sentiment(F.lit("NEGATIVE"), F.lit(0.85)).alias("neg"),
        S.signed_sentiment(F.lit("neutral"), F.lit(0.6)).alias("neu"),
        S.age_label(F.lit(119)).alias("s"),
        S.age_label(F.lit(120)).alias("m"),
        S.freshness(F.lit(None).cast("double")).alias("fresh"),
    )
    assert one(row) == {"up": 0.05, "zero": 0.0, "ratio": 3.0, "none": 0.0, "shift": 0.3, "neg": -0.85, "neu": 0.0, "s": "119s ago", "m": "2m ago", "fresh": "NO DATA"}


@pytest.mark.parametrize(("change", "volume", "shift", "expected"), [(0.05, 100, 0.0, "large price move (5.00%)"), (0.0, 2_000_000, 0.0, "high volume (2,000,000)"), (0.0, 1, -0.5, "sentiment shift (-0.50)"), (0.0, 1, 0.0, "anomaly score=-0.4000"), (0.02, 1_000_000, 0.3, "anomaly score=-0.4000")])
def test_reasons(spark, change, volume, shift, expected):
    df = spark.createDataFrame([(change, volume, shift, -0.4)], "price_change_rate double, total_volume long, sentiment_shift double, score double")
    assert one(df.select(S.anomaly_reason("score").alias("r")))["r"] == expected


def test_ensemble(spark):
    df = spark.range(1)
    value = lambda *a: one(df.select(ensemble_score(*a).alias("x")))["x"]
    assert value({"a": F.lit(-0.8), "b": F.lit(-0.2)}, {"a": 0.6, "b": 0.4}) == pytest.approx(-0.56)
    assert value({"a": F.lit(-0.8), "b": F.lit(-0.2)}) == pytest.approx(-0.5)
    assert value({"a": F.lit(-0.8), "lstm_ae": F.lit(0.0)}, {"a": 0.5, "lstm_ae": 0.5}) == pytest.approx(-0.8)
    assert value({"lstm_ae": F.lit(0.0)}) == 0.0


def test_enrichment_split(spark):
    rows = spark.createDataFrame([("T", 100), ("U", 100)], "ticker string, window_end long")
    news = spark.createDataFrame([("T", i, i, 50 if i > 10 else 0) for i in range(1, 21)] + [("T", 101, 99, -100)], "ticker string, ts long, event_id long, score_c long")
    got = {r["ticker"]: (r["avg_sentiment"], r["sentiment_shift"], r["headline_count"]) for r in enrich.enrich(rows, news).collect()}
    assert got == {"T": (0.5, 0.5, 10), "U": (0.0, 0.0, 0)}


def test_sliding_features_skip_the_last_window(spark):
    rows = spark.createDataFrame([("T", i, i, 1_000_000 + 10_000 * i, 100.0 + i, 10) for i in range(7)], "ticker string, ts long, event_id long, close_e4 long, close double, volume long")
    got = features.sliding_features(rows).orderBy("ts").collect()
    assert [(r["ts"], r["avg_close"], r["total_volume"]) for r in got] == [(4, 102.0, 50), (5, 103.0, 50)]


@pytest.mark.parametrize(("found", "truth", "tolerance", "expected"), [([5, 10], [5, 10], 0, [(5, 5), (10, 10)]), ([7], [5], 2, [(7, 5)]), ([8], [5], 2, []), ([5, 6], [6], 2, [(5, 6)]), ([10], [9, 11], 2, [(10, 9)]), ([], [3], 2, []), ([1 << 20], [(1 << 20) - 1], 2, [(1 << 20, (1 << 20) - 1)])])
def test_matching(spark, found, truth, tolerance, expected):
    frame = lambda name, xs: spark.createDataFrame([(x,) for x in xs], f"{name} long")
    assert sorted(tuple(r) for r in evaluate.matches(frame("d", found), frame("g", truth), tolerance).select("d", "g").collect()) == expected


def test_metrics_of_nothing(spark):
    none = lambda name: spark.createDataFrame([], f"{name} long")
    row = one(evaluate.metrics(none("d"), none("g"), 10))
    assert row["precision"] == row["recall"] == row["f1"] == 0.0


def test_injection_is_the_same_again(spark):
    rows = spark.range(100).select(F.col("id").cast("string").alias("row_id"), F.lit("T").alias("ticker"), F.col("id").alias("window_end"), F.lit(0.01).alias("price_change_rate"), F.lit(10.0).alias("total_volume"), F.lit(0.0).alias("avg_sentiment"), F.lit(0.0).alias("sentiment_shift"))
    a = inject.inject_points(rows)
    assert a.where("anomaly_type is not null").count() == 5
    assert sorted(a.collect()) == sorted(inject.inject_points(rows.repartition(7)).collect())
    block = inject.inject_drift(a, "T", "window_end").where("anomaly_type = 'subtle_drift'")
    places = sorted(r["window_end"] for r in block.collect())
    assert all((r["price_change_rate"], r["total_volume"], r["avg_sentiment"], r["sentiment_shift"]) == (0.01 + 0.02, 15.0, -0.2, 0.0) for r in block.collect())
    assert len(places) == inject.drift_length("T") == places[-1] - places[0] + 1 and places[0] >= 50


def test_lengths_of_drift_blocks():
    drawn = {inject.drift_length(f"T{k}") for k in range(300)}
    assert drawn == set(range(10, 21)) and inject.drift_length("T1", 1) == inject.drift_length("T1", 1)


def test_positions(spark):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x"))
    assert all(r["x"] == r["position"] for r in inject.positions(rows, ["x"]).collect())


def test_positions_of_many_rows(spark):
    """Bounds of ranges are sampled; places are still 0 to n - 1, each once, in order."""
    rows = spark.range(0, 400_000, 1, 7).select(((F.col("id") * 48271) % 400_009).alias("x"))
    got = inject.positions(rows, ["x"]).agg(F.count("position"), F.countDistinct("position"), F.min("position"), F.max("position")).first()
    assert tuple(got) == (400_000, 400_000, 0, 399_999)


@pytest.mark.parametrize("few", [1 << 20, 7, 1])
@pytest.mark.parametrize("values", [[], [3], [5, 5, 5, 5], list(range(500)), [x * x * (-1) ** x for x in range(300)], [-(1 << 63), (1 << 63) - 1, 0, 0, 7] * 5])
def test_values_by_place(spark, values, few):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v long").repartition(3)
    for place in {0, 1, len(values) // 2, len(values) - 1, len(values)}:
        assert order.value_at(df, "v", place, few) == (sorted(values)[place] if 0 <= place < len(values) else None)


def plain_matches(found, truth, tolerance):
    free, out = set(truth), []
    for d in sorted(set(found)):
        for g in (g for k in range(tolerance + 1) for g in (d - k, d + k)):
            if g in free:
                free.remove(g)
                out.append((d, g))
                break
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_matches_over_the_edges_of_buckets(spark, seed):
    rng = random.Random(seed)
    found, truth = ([rng.randrange(400) for _ in range(n)] for n in (80, 60))
    frame = lambda name, xs: spark.createDataFrame([(x,) for x in xs], f"{name} long")
    for bucket in (1, 3, 16, 1000):
        got = evaluate.matches(frame("d", found), frame("g", truth), 2, bucket)
        assert sorted(tuple(r) for r in got.select("d", "g").collect()) == plain_matches(found, truth, 2)


def test_a_forest_of_nothing():
    forest = IsolationForest().fit(np.empty((0, 4)))
    assert not forest.fitted and forest.scores(np.ones((3, 4))).tolist() == [0, 0, 0]


def test_bounded_memory_of_titles():
    assert readers.bounded_first_seen(["a", "b", "a", "c", "a", "d", "a"], 2) == [True, True, False, True, True, True, False]


def test_retry():
    calls, waits = [], []

    def fetch():
        calls.append(1)
        raise OSError

    assert readers.with_retry(fetch, sleep=waits.append) is None and len(calls) == 3 and waits == [5, 10]
    assert readers.with_retry(lambda x: x + 1, 1) == 2


def test_tables_and_summary(spark, tmp_path):
    paths = sinks.init_tables(spark, f"file://{tmp_path}/t")
    assert set(paths) == {"price_ticks", "sentiment_scores", "feature_vectors", "anomaly_alerts", "model_versions", "drift_events"}
    assert sinks.init_tables(spark, f"file://{tmp_path}/t") == paths
    assert spark.read.parquet(paths["model_versions"]).count() == 0
    assert '"rows": [{"id": 0}]' in sinks.write_summary(spark, {"rows": spark.range(1)}, f"file://{tmp_path}/s")


def features_frame(spark, n=80):
    rows = [(t, i, 0.05 if i % 17 == 3 else -0.04 if i % 17 == 4 else 0.001, 100.0 + (900 if i % 23 == 0 else i % 7), 0.0, -0.5 if i % 29 == 4 else 0.0) for t in ("A", "B") for i in range(n)]
    return spark.createDataFrame(rows, "ticker string, window_end long, price_change_rate double, total_volume double, avg_sentiment double, sentiment_shift double")


def test_stream_scores_like_the_batch(spark, tmp_path):
    """Rows arrive in three files; the state goes on in the store, also over a restart from the checkpoint."""
    rows = features_frame(spark)
    schema = rows.schema
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kept = tables.open_tables(spark, f"file://{tmp_path}/tables")
    for k in range(3):
        rows.where((F.col("window_end") >= 30 * k) & (F.col("window_end") < 30 * (k + 1))).coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
        pipeline.run_available(pipeline.scored(stream), tables.scored_batch(kept), f"file://{tmp_path}/checkpoint")
    # A second stream, from its own start: the same keys.
    pipeline.run_available(pipeline.scored(stream), tables.scored_batch(kept), f"file://{tmp_path}/another-checkpoint")
    assert len(kept["feature_vectors"].version().applied) == 2
    vectors = kept["feature_vectors"].read()
    got = {(r["ticker"], r["end"]): (r["ewma"], r["cep"], r["cep_match"]) for r in vectors.withColumn("end", F.unix_millis("window_end")).collect()}
    assert vectors.count() == 160 and kept["anomaly_alerts"].read().count() == vectors.where("is_anomaly").count()
    want = {(r["ticker"], r["window_end"]): (r["ewma"], r["cep"], r["cep_match"]) for r in sequence.replay(rows, ["window_end"]).collect()}
    assert got == want and len(got) == 160
    assert any(v[2] == "flash_reversal" for v in got.values())


def test_the_stream_has_half_space_trees_and_autoencoder_of_each_key(spark):
    rows = features_frame(spark)
    coder = training.fit_autoencoder(rows, ["window_end"])
    got = {(r["ticker"], r["window_end"]): r for r in pipeline.scored(rows, autoencoder=coder).collect()}
    want = {(r["ticker"], r["window_end"]): r["lstm_ae"] for r in sequence.replay(rows, ["window_end"], autoencoder=coder).collect()}
    assert {k: r["lstm_ae"] for k, r in got.items()} == want and any(want.values())
    for ticker in ("A", "B"):
        model = HalfSpaceTrees()
        for row in rows.where(F.col("ticker") == ticker).orderBy("window_end").collect():
            assert got[ticker, row["window_end"]]["hst"] == model.score(row.asDict())
            model.update(row.asDict())
    r = got["A", 79]
    w = {n: x for n, x in SETTINGS.weights.items() if n in ("ewma", "hst", "lstm_ae")}
    assert abs(r["anomaly_score"] - sum(w[n] * r[n] for n in w) / sum(w.values())) < 1e-9 or r["lstm_ae"] == 0


def test_order_inside_a_key_does_not_depend_on_how_rows_are_dealt(spark):
    rows = features_frame(spark, 40)
    a = sorted(map(str, sequence.replay(rows, ["window_end"]).collect()))
    assert a == sorted(map(str, sequence.replay(rows.repartition(5).orderBy(F.desc("window_end")), ["window_end"]).collect()))


def noisy_frame(spark, n=150):
    rng = random.Random(11)
    rows = [(t, i, rng.choice([0.0, 0.001, 0.03, -0.04]), float(rng.choice([100, 110, 400])), 0.0, rng.choice([0.0, 0.0, -0.5, 0.4]), i < 20) for t in ("A", "B", "C") for i in range(n if t == "B" else 25)]
    return spark.createDataFrame(rows, "ticker string, window_end long, price_change_rate double, total_volume double, avg_sentiment double, sentiment_shift double, warm boolean")


@pytest.mark.parametrize(("block", "halo", "warm"), [(16, 0, None), (7, 7, "warm"), (64, 40, None)])
def test_blocks_score_like_one_pass(spark, block, halo, warm):
    """Guessed states that are wrong are run again; with averages that forget within a few rows most guesses are right."""
    from dataclasses import replace

    rows = noisy_frame(spark)
    coder = training.fit_autoencoder(rows, ["window_end"], 4)
    for s in (SETTINGS, replace(SETTINGS, ewma_span=2, baseline_span=2)):
        args = {"s": s, "autoencoder": coder, "warm": warm}
        one = sequence.replay(rows, ["window_end"], **args)
        want = {(r["ticker"], r["window_end"]): r.asDict() for r in one.collect()}
        got = {(r["ticker"], r["window_end"]): r.asDict() for r in sequence.replay(rows, ["window_end"], **args, block=block, halo=halo).collect()}
        assert got == want and len(got) == (200 if warm is None else 140)
        if warm is None:  # and like the plain loop over each ticker
            for ticker in "ABC":
                key = sequence.Key(s, coder)
                for row in rows.where(F.col("ticker") == ticker).orderBy("window_end").collect():
                    r = want[ticker, row["window_end"]]
                    ewma, coded, *rest = key.step(row.asDict())
                    assert [r["ewma"], *(r[c] for c in ("cep", "cep_match", "events", "severities", "drifted", "baseline"))] == [ewma, *rest]
                    assert r["lstm_ae"] == pytest.approx(coded, abs=1e-12)


def test_states_of_kernels_come_back(spark):
    rows = [r.asDict() for r in noisy_frame(spark).where("ticker = 'B'").orderBy("window_end").collect()]
    key = sequence.Key(drift=False)
    for k, row in enumerate(rows):
        other = sequence.Key(drift=False).resume(key.state())
        assert other.state() == key.state()
        if k % 10 == 0:
            one, two = (sequence.Key(drift=False).resume(key.state()) for _ in range(2))
            for later in rows[k : k + 15]:
                assert one.step(later) == two.step(later)
        assert other.step(row) == key.step(row) and other.state() == key.state()


def test_rounding_is_that_of_python(spark):
    """A million values with ties, near ties, ends of ranges and what isn't finite."""
    import math

    rng = np.random.default_rng(6)
    k = rng.integers(-(10**8), 10**8, 250_000)
    values = np.concatenate([k / 1e4 + 0.00005, (2 * k + 1) / 2 / 1e4, k / 2.0 ** rng.integers(1, 30, len(k)), np.ldexp(rng.normal(size=len(k)), rng.integers(-30, 60, len(k)))])
    values = [*values.tolist(), 0.0, -0.0, 0.5, 2.5, 1.005, 2.675, 1e300, -1e300, math.inf, -math.inf, float(2**52) / 1e4, float(2**53) / 1e4, float(2**53 - 1) / 1e4, 5e-324, -0.00004]
    df = spark.createDataFrame(__import__("pandas").DataFrame({"x": values}))
    for digits in (0, 2, 4, 6):
        got = df.select("x", S.rounded("x", digits).alias("y")).toPandas()
        assert len(got) == len(values) and all(y == round(x, digits) for x, y in zip(got["x"].tolist(), got["y"].tolist(), strict=True))
        assert not any(math.copysign(1, y) < 0 for y in got["y"].tolist() if y == 0)
    assert df.select(S.rounded(F.lit(None).cast("double"), 4).alias("y")).where("y is not null").count() == 0


@pytest.mark.parametrize(("block", "halo", "most"), [(40, 1, 15), (64, 60, 15), (1000, 10, 40)])
def test_a_bounded_memory_in_blocks(spark, block, halo, most):
    rng = random.Random(block)
    titles = [f"t{int(60 * rng.random() ** 2)}" for _ in range(300)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(titles)] + [(300, None, "x")], "at long, title string, fresh_title string").repartition(5)
    got = seen.seen_lately(df, ["at"], most=most, block=block, halo=halo)
    assert got.columns == ["at", "title", "fresh_title", "fresh"]
    assert [r["fresh"] for r in got.orderBy("at").collect()] == readers.bounded_first_seen(titles, most)
    assert seen.seen_lately(df.where("at < 0"), ["at"]).count() == 0


def test_a_memory_that_keeps_its_start_takes_few_rounds(spark):
    """Few titles are never pushed out, so no rows before a block tell in which order they came: 38 blocks, all guessed wrong."""
    from pathlib import Path

    rng = random.Random(5)
    titles = [f"t{rng.randrange(10 + i // 40)}" for i in range(300)]
    df = spark.createDataFrame(list(enumerate(titles)), "at long, title string").repartition(3)
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = len(list(folder.glob("*/wrong-*")))
    got = seen.seen_lately(df, ["at"], most=18, block=8, halo=4)
    assert [r["fresh"] for r in got.orderBy("at").collect()] == readers.bounded_first_seen(titles, 18)
    assert 2 <= len(list(folder.glob("*/wrong-*"))) - before <= 5


def test_a_memory_leaves_other_columns_as_they_are(spark):
    rows = [(k, None if k % 3 else (1 << 62) + k, f"t{k % 7}") for k in range(40)]
    df = spark.createDataFrame(rows, "at long, other long, title string")
    memory = spark.createDataFrame([(bytearray(b'["t3", "t0"]'),)], "memory binary")
    got, after = seen.remembered(df, ["at"], most=5, block=8, halo=4, memory=memory)
    known = {"t3": None, "t0": None}
    want = readers.bounded_first_seen([r[2] for r in rows], 5, known)
    assert [tuple(r) for r in got.orderBy("at").collect()] == [(*r, fresh) for r, fresh in zip(rows, want, strict=True)]
    assert [bytes(r["memory"]) for r in after.collect()] == [__import__("json").dumps(list(known)).encode()]
