"""Whole runs: backtest, comparison of methods, retraining.  What a command line would take are arguments."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.config import SETTINGS, Settings
from tidewater.operators import evaluate, features, inject, sequence, training
from tidewater.operators.cep.detector import CepDetector
from tidewater.operators.detectors.autoencoder import Autoencoder
from tidewater.operators.detectors.ewma import Ewma
from tidewater.operators.detectors.hst import HalfSpaceTrees
from tidewater.operators.ensemble import ensemble_score
from tidewater.scratch import stored
from tidewater.sources import sinks


def split_and_inject(rows: DataFrame, order: list[str], s: Settings = SETTINGS, drift_ticker: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(training rows, test rows with planted anomalies); `row_id` names a row."""
    parts = features.temporal_split(rows, order, s.train_ratio).withColumn("row_id", F.concat_ws("@", "ticker", *(F.col(c).cast("string") for c in order)))
    parts = parts.withColumn("total_volume", F.col("total_volume").cast("double"))
    test = inject.inject_points(parts.where("not is_train"), s.injection_rate, s.seed)
    return parts.where("is_train"), inject.inject_drift(test, drift_ticker, order[0]) if drift_ticker else test


def scored_with_all(train: DataFrame, test: DataFrame, order: list[str], s: Settings = SETTINGS) -> DataFrame:
    """The test rows with every detector's score, the ensemble's, `is_anomaly` and `is_truth`, after a warm-up on each ticker's last training rows."""
    forest, coder = training.fit_iforest(train, seed=s.seed), training.fit_autoencoder(train, order, s.sequence_length)
    warm = features.last_rows(train, s.warmup_rows, order).withColumn("anomaly_type", F.lit(None).cast("string"))
    both = stored(warm.unionByName(test), "replay")
    names = both.columns
    out = sequence.replay(both, order, s, autoencoder=coder, warm="is_train").select(*names, "ewma", "lstm_ae", "cep", "cep_match", "drifted")
    hst = sequence.with_hst(both, ["ticker", *order], s, warm="is_train").where("not is_train").select("row_id", "hst")
    out = sequence.with_iforest(out.join(hst, "row_id"), forest)
    scores = {n: F.col(n) for n in s.weights}
    out = out.withColumns({"score": ensemble_score(scores, s.weights), "is_truth": F.col("anomaly_type").isNotNull(), "detector_scores": F.create_map(*(x for n in s.weights for x in (F.lit(n), F.col(n))))})
    return out.withColumn("is_anomaly", F.col("score") < s.threshold)


def measured(scored: DataFrame, order: list[str], flag: str, s: Settings = SETTINGS) -> DataFrame:
    """The metrics of a flag column against the truth, indices running over the tickers one after the other."""
    rows = stored(inject.positions(scored.select("ticker", *order, flag, "is_truth"), ["ticker", *order]), "positions")
    return evaluate.metrics(rows.where(flag).select(F.col("position").alias("d")), rows.where("is_truth").select(F.col("position").alias("g")), rows.count(), s.tolerance)


def backtest(rows: DataFrame, order: list[str], s: Settings = SETTINGS, drift_ticker: str | None = None, report: str | None = None) -> dict[str, DataFrame]:
    """scored, metrics, separation, by_detector, drift; with `report` also a JSON summary there."""
    train, test = split_and_inject(rows, order, s, drift_ticker)
    scored = stored(scored_with_all(train, test, order, s), "scored")
    parts = {"scored": scored, "metrics": measured(scored, order, "is_anomaly", s), "separation": evaluate.separation(scored), "by_detector": evaluate.by_detector(scored, s.threshold), "drift": scored.select("ticker", *order, F.explode("drifted").alias("feature"))}
    if report:
        sinks.write_summary(rows.sparkSession, {k: v for k, v in parts.items() if k != "scored"}, report)
    return parts


def drawn_ticker(rows: DataFrame, s: Settings = SETTINGS) -> str | None:
    """The ticker for the drift block: the one whose seeded hash is smallest."""
    return rows.agg(F.min_by("ticker", F.struct(F.xxhash64("ticker", F.lit(s.seed)), "ticker"))).first()[0]


def compare_methods(rows: DataFrame, order: list[str], s: Settings = SETTINGS, drift_ticker: str | None = None) -> DataFrame:
    """The ensemble, the patterns with lone events, and the patterns alone, on the same planted anomalies and the same drift block.

    A row a method: the metrics, and ms_mean, ms_median, ms_p99 and ms_max of scoring a window.
    """
    train, test = split_and_inject(rows, order, s, drift_ticker or drawn_ticker(rows, s))
    train, test = stored(train, "train"), stored(test, "test")
    scored = stored(scored_with_all(train, test, order, s), "scored")
    scored = scored.withColumns({"full": F.col("cep") < s.cep_threshold, "alone": (F.col("cep") < s.cep_threshold) & ~F.coalesce(F.col("cep_match"), F.lit("")).startswith("point:")})
    forest, coder = training.fit_iforest(train, seed=s.seed), training.fit_autoencoder(train, order, s.sequence_length)

    def ensemble() -> sequence.Together:
        return sequence.Together(Ewma(s.ewma_span), HalfSpaceTrees(s.hst_trees, s.hst_height, s.hst_window, s.seed), forest, Autoencoder(coder.weights, coder.mean, coder.std, coder.length))

    methods = (("ml_ensemble", "is_anomaly", ensemble), ("cep_full", "full", None), ("cep_automata", "alone", lambda: CepDetector(s, point_severity=0.0)))
    out = None
    for name, flag, make in methods:
        times = evaluate.latency_stats(sequence.timed_replay(test, order, s, make).select("latency_ms"))
        one = evaluate.beside(measured(scored, order, flag, s), times.select(*(F.col(c).alias(f"ms_{c}") for c in times.columns))).withColumn("method", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def retrain(spark: SparkSession, rows: DataFrame, registry: DataFrame, folder: str, name: str = "isolation_forest", s: Settings = SETTINGS) -> DataFrame:
    """Fits a new version, saves it and an active copy, and returns the registry with it; the caller writes that in one step."""
    model = training.fit_iforest(rows, seed=s.seed)
    summary = training.training_summary(rows, model).first()
    path = training.save_model(spark, model, folder, training.next_version(registry, name))
    entry = {"model_name": name, "trained_at": datetime.now(UTC), "sample_count": summary["samples"], "anomaly_rate": summary["anomaly_rate"], "score_mean": summary["score_mean"], "score_std": summary["score_std"], "model_path": path}
    return training.registered(registry, entry)
