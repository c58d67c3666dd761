"""Queries of detectors, complex events, evaluation, training and streams."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.config import FEATURES, SETTINGS
from tidewater.functions import scalars as S
from tidewater.operators import enrich, evaluate, event_study, inject, sequence, training
from tidewater.operators import features as feature_ops
from tidewater.operators.cep.detector import CepDetector, primitive_events
from tidewater.operators.ensemble import ensemble_score
from tidewater.plans import backtest, dashboard
from tidewater.schemas import TABLES
from tidewater.scratch import scratch, stored
from tidewater.session import table
from tidewater.sources import market
from tidewater.streaming import pipeline

from .base import CEP, ENRICHED_SQL, FEATURES_SQL, R2, R4, R6, SCORED_SQL, enriched, feats, flagged, query, ticks
from .relational import GREEDY_SQL, VERSIONS_SQL, daily, study_events, versions

ALPHA = "(2::DOUBLE / 21::DOUBLE)"
#: Rows numbered per ticker, with the volume baseline that was known before each.
FOLDED_SQL = f"""{ENRICHED_SQL}, seqd AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY window_end) AS rn FROM enriched),
fold AS (SELECT ticker, rn, CAST(total_volume AS DOUBLE) AS m FROM seqd WHERE rn = 1 UNION ALL
  SELECT s.ticker, s.rn, {ALPHA} * s.total_volume + (1 - {ALPHA}) * f.m FROM fold f JOIN seqd s ON s.ticker = f.ticker AND s.rn = f.rn + 1),
ev AS (SELECT s.*, coalesce(f.m, 0::DOUBLE) AS baseline, CAST(price_change_rate >= 0.02::DOUBLE AS INTEGER) AS up, CAST(price_change_rate <= -0.02::DOUBLE AS INTEGER) AS down,
  CAST(coalesce(s.rn >= 4 AND f.m > 0 AND s.total_volume / f.m >= 1.5::DOUBLE, FALSE) AS INTEGER) AS surge,
  CAST(sentiment_shift <= -0.3::DOUBLE OR avg_sentiment <= -0.5::DOUBLE AS INTEGER) AS fell, CAST(sentiment_shift >= 0.3::DOUBLE AS INTEGER) AS rose
  FROM seqd s LEFT JOIN fold f ON f.ticker = s.ticker AND f.rn = s.rn - 1),
cum AS (SELECT *, sum(up + down) OVER w AS c_jump, sum(down) OVER w AS c_down, sum(surge) OVER w AS c_surge, sum(fell) OVER w AS c_fell FROM ev WINDOW w AS (PARTITION BY ticker ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT ticker, rn, window_end, price_change_rate, up, down, surge, fell, rose, baseline, coalesce(c_jump, 0) AS c_jump, coalesce(c_down, 0) AS c_down, coalesce(c_surge, 0) AS c_surge, coalesce(c_fell, 0) AS c_fell FROM cum)"""


def hourly(s: SparkSession, d: str) -> DataFrame:
    """Features of one-hour windows: long enough sequences for drift to show."""
    rows = feature_ops.tumbling_features(ticks(s, d), 60)
    return enrich.enrich(rows, market.news(s, d)).withColumn("total_volume", F.col("total_volume").cast("double"))


def replayed(s: SparkSession, d: str, **kwargs) -> DataFrame:
    return sequence.replay(enriched(s, d), ["window_end"], CEP, drift=False, **kwargs)


#: The kernel's state after each row, and the score of the next one.
EWMA_SQL = (
    f"""{ENRICHED_SQL}, x AS (SELECT ticker, window_end, price_change_rate AS x1, CAST(total_volume AS DOUBLE) AS x2, avg_sentiment AS x3, sentiment_shift AS x4, row_number() OVER (PARTITION BY ticker ORDER BY window_end) AS rn FROM enriched),
e AS (SELECT ticker, rn, x1 AS m1, 0::DOUBLE AS v1, x2 AS m2, 0::DOUBLE AS v2, x3 AS m3, 0::DOUBLE AS v3, x4 AS m4, 0::DOUBLE AS v4 FROM x WHERE rn = 1 UNION ALL SELECT x.ticker, x.rn, """
    + ", ".join(f"{ALPHA} * x{i} + (1 - {ALPHA}) * m{i}, (1 - {ALPHA}) * (v{i} + {ALPHA} * ((x{i} - m{i}) * (x{i} - m{i})))" for i in range(1, 5))
    + " FROM e JOIN x ON x.ticker = e.ticker AND x.rn = e.rn + 1), ew AS (SELECT x.ticker, x.window_end, CASE WHEN m1 IS NULL THEN 0::DOUBLE ELSE 0 - least(greatest("
    + ", ".join(f"abs(x{i} - m{i}) / (CASE WHEN v{i} > 1e-10 THEN sqrt(v{i}) ELSE 1e-10 END)" for i in range(1, 5))
    + "), 8::DOUBLE) / 8::DOUBLE END AS ewma FROM x LEFT JOIN e ON e.ticker = x.ticker AND e.rn = x.rn - 1)"
)


@query("det01_ewma", f"WITH RECURSIVE {EWMA_SQL} SELECT ticker, window_end, ewma FROM ew")
def _(s, d):
    return replayed(s, d).select("ticker", "window_end", "ewma")


@query("det02_half_space_trees")
def _(s, d):
    return sequence.with_hst(enriched(s, d), ["window_end", "ticker"]).select("ticker", "window_end", "hst")


@query("det03_trn01_isolation_forest")
def _(s, d):
    rows = enriched(s, d)
    return sequence.with_iforest(rows, training.fit_iforest(rows)).select("ticker", "window_end", "isolation_forest")


@query("det04_trn02_autoencoder")
def _(s, d):
    rows = enriched(s, d)
    return sequence.replay(rows, ["window_end"], CEP, autoencoder=training.fit_autoencoder(rows, ["window_end"]), drift=False).select("ticker", "window_end", "lstm_ae")


@query("det05_ensemble", f"WITH {SCORED_SQL} SELECT ticker, window_end, anomaly_score, is_anomaly FROM flagged")
def _(s, d):
    return flagged(s, d).select("ticker", "window_end", "anomaly_score", "is_anomaly")


@query("det06_07_dsh17_drift")
def _(s, d):
    """The last fifth of the windows is shifted: the data don't drift by themselves."""
    rows = inject.shift_last_fifth(hourly(s, d), ["window_end", "ticker"])
    return dashboard.drift_timeline(sequence.replay(rows, ["window_end"], CEP))


def full_scores(s: SparkSession, d: str) -> DataFrame:
    """All detectors, the ensemble and its flag."""
    rows = enriched(s, d)
    names = rows.columns
    out = sequence.replay(rows, ["window_end"], CEP, autoencoder=training.fit_autoencoder(rows, ["window_end"]), drift=False).select(*names, "ewma", "lstm_ae", "cep", "cep_match")
    out = sequence.with_iforest(sequence.with_hst(out, ["window_end", "ticker"]), training.fit_iforest(rows))
    scores = {n: F.col(n) for n in SETTINGS.weights}
    out = out.withColumn("anomaly_score", ensemble_score(scores, SETTINGS.weights)).withColumn("is_anomaly", F.col("anomaly_score") < SETTINGS.threshold)
    return out.withColumn("detector_scores", F.create_map(*(x for n in SETTINGS.weights for x in (F.lit(n), F.col(n)))))


@query("det08_full_scorer")
def _(s, d):
    return full_scores(s, d).withColumn("reason", S.anomaly_reason("anomaly_score")).select("ticker", "window_end", "anomaly_score", "is_anomaly", "reason")


@query("det10_without_sequence_model")
def _(s, d):
    w = event_study.WEIGHTS
    return full_scores(s, d).select("ticker", "window_end", ensemble_score({n: F.col(n) for n in w}, w).alias("anomaly_score"))


@query("cep01_03_primitive_events", f"WITH RECURSIVE {FOLDED_SQL} SELECT ticker, window_end, array_to_string(list_sort(list_filter([CASE WHEN up = 1 THEN 'price_jump_up' WHEN down = 1 THEN 'price_jump_down' END, CASE WHEN fell = 1 THEN 'sentiment_drop' WHEN sentiment_shift >= 0.3::DOUBLE THEN 'sentiment_spike' END], lambda x: x IS NOT NULL)), '+') AS events FROM ev")
def _(s, d):
    return enriched(s, d).select("ticker", "window_end", F.array_join(primitive_events(F.lit(False)), "+").alias("events"))


@query("cep02_04_volume_baseline", f"WITH RECURSIVE {FOLDED_SQL} SELECT ticker, window_end, baseline, surge = 1 AS surge FROM ev")
def _(s, d):
    return replayed(s, d).select("ticker", "window_end", "baseline", F.array_contains("events", "volume_surge").alias("surge"))


#: What every pattern needs of the rows before, in closed form; the repeat (`acc`) row by row: n surges so far in the
#: one match there can be (-1: none), its age, and whether it was completed.
PATTERNS_SQL = f"""{FOLDED_SQL},
p AS (SELECT e.*, lag(up, 1, 0) OVER w AS up1, lag(down, 1, 0) OVER w AS down1, lag(surge, 2, 0) OVER w AS surge2, lag(CASE WHEN down = 1 AND abs(price_change_rate) > 0.03::DOUBLE THEN 1 ELSE 0 END, 2, 0) OVER w AS steep2,
  (up = 1 OR down = 1) AND EXISTS (SELECT 1 FROM b x WHERE x.ticker = e.ticker AND x.rn BETWEEN e.rn - 2 AND e.rn AND x.surge = 1 AND x.c_jump = e.c_jump) AS breakout,
  down = 1 AND EXISTS (SELECT 1 FROM b x WHERE x.ticker = e.ticker AND x.rn BETWEEN e.rn - 3 AND e.rn AND x.fell = 1 AND x.c_down = e.c_down) AS selloff,
  down = 1 AND EXISTS (SELECT 1 FROM b v JOIN b x ON x.ticker = v.ticker AND x.rn BETWEEN v.rn AND v.rn + 4 AND x.fell = 1 AND x.c_fell = v.c_fell WHERE v.ticker = e.ticker AND v.surge = 1 AND x.rn BETWEEN e.rn - 2 AND e.rn AND x.c_down = e.c_down) AS panic
  FROM b e WINDOW w AS (PARTITION BY ticker ORDER BY rn)),
q AS (SELECT *, (up1 = 1 AND down = 1) OR (down1 = 1 AND up = 1) AS flash, sum(CAST(selloff AS INTEGER)) OVER (PARTITION BY ticker ORDER BY rn) - CAST(selloff AS INTEGER) AS c_selloff FROM p),
acc AS (SELECT ticker, rn, CASE WHEN surge = 1 AND up + down = 0 THEN 0 ELSE -1 END AS n, 0 AS age, surge = 1 AND up + down > 0 AS fired FROM b WHERE rn = 1 UNION ALL
  SELECT x.ticker, x.rn, CASE WHEN a.n < 0 OR a.age >= 2 THEN CASE WHEN surge = 1 AND up + down = 0 THEN 0 ELSE -1 END WHEN surge = 1 THEN a.n + 1 WHEN a.n >= 3 AND up + down > 0 THEN -1 ELSE a.n END,
  CASE WHEN a.n < 0 OR a.age >= 2 OR surge = 1 THEN 0 ELSE a.age + 1 END, CASE WHEN a.n < 0 OR a.age >= 2 THEN surge = 1 AND up + down > 0 ELSE surge = 0 AND a.n >= 3 AND up + down > 0 END
  FROM acc a JOIN b x ON x.ticker = a.ticker AND x.rn = a.rn + 1),
pat AS (SELECT e.ticker, e.window_end, breakout AS volume_led_breakout, selloff AS news_driven_selloff, flash AS flash_reversal, panic AS panic_compound, surge2 = 1 AND up1 = 0 AND up = 0 AS failed_breakout, steep2 = 1 AND up1 = 0 AND up = 0 AS sustained_selloff,
  surge = 1 AND EXISTS (SELECT 1 FROM q x WHERE x.ticker = e.ticker AND x.rn BETWEEN e.rn - 5 AND e.rn AND x.flash AND x.c_surge = e.c_surge) AS reversal_confirmed,
  selloff AND EXISTS (SELECT 1 FROM q x WHERE x.ticker = e.ticker AND x.rn BETWEEN e.rn - 10 AND e.rn AND x.breakout AND x.c_selloff = e.c_selloff) AS pump_and_dump, acc.fired AS sustained_accumulation FROM q e JOIN acc ON acc.ticker = e.ticker AND acc.rn = e.rn)"""


@query("cep06_to_16_patterns", f"WITH RECURSIVE {PATTERNS_SQL} SELECT * FROM pat")
def _(s, d):
    names = ("volume_led_breakout", "news_driven_selloff", "flash_reversal", "panic_compound", "failed_breakout", "sustained_selloff", "reversal_confirmed", "pump_and_dump", "sustained_accumulation")
    return replayed(s, d).select("ticker", "window_end", *(F.col("severities")[n].isNotNull().alias(n) for n in names))


#: The winning pattern and its severity: the highest of the base patterns, the first of equal ones; meta patterns win ties.
WINNER_SQL = f"""{PATTERNS_SQL}, won AS (SELECT ticker, window_end, CASE WHEN pump_and_dump THEN 'pump_and_dump' WHEN panic_compound THEN 'panic_compound' WHEN reversal_confirmed THEN 'reversal_confirmed'
  WHEN news_driven_selloff THEN 'news_driven_selloff' WHEN sustained_accumulation THEN 'sustained_accumulation' WHEN volume_led_breakout THEN 'volume_led_breakout' WHEN flash_reversal THEN 'flash_reversal'
  WHEN failed_breakout THEN 'failed_breakout' WHEN sustained_selloff THEN 'sustained_selloff' END AS pattern FROM pat),
lone AS (SELECT ticker, window_end, concat_ws('+', CASE WHEN down = 1 THEN 'price_jump_down' WHEN up = 1 THEN 'price_jump_up' END, CASE WHEN fell = 1 THEN 'sentiment_drop' WHEN rose = 1 THEN 'sentiment_spike' END, CASE WHEN surge = 1 THEN 'volume_surge' END) AS events FROM b),
best AS (SELECT ticker, window_end, pattern, events, CASE WHEN pattern IN ('pump_and_dump', 'panic_compound') THEN -1::DOUBLE WHEN pattern = 'reversal_confirmed' THEN -0.95::DOUBLE WHEN pattern IN ('news_driven_selloff', 'sustained_accumulation') THEN -0.9::DOUBLE
  WHEN pattern = 'volume_led_breakout' THEN -0.85::DOUBLE WHEN pattern = 'flash_reversal' THEN -0.8::DOUBLE WHEN pattern IS NOT NULL THEN -0.5::DOUBLE ELSE 0::DOUBLE END AS alone FROM won JOIN lone USING (ticker, window_end)),
winner AS (SELECT *, CASE WHEN pattern IS NULL AND events <> '' THEN -0.55::DOUBLE ELSE alone END AS cep, coalesce(pattern, CASE WHEN events <> '' THEN 'point:' || events END) AS cep_match FROM best)"""


@query("cep17_19_winner_and_score", f"WITH RECURSIVE {WINNER_SQL} SELECT ticker, window_end, cep, cep_match, cep < -0.5::DOUBLE AS is_anomaly FROM winner")
def _(s, d):
    return replayed(s, d).select("ticker", "window_end", "cep", "cep_match", (F.col("cep") < SETTINGS.cep_threshold).alias("is_anomaly"))


@query("det09_cep20_automata_only", f"WITH RECURSIVE {WINNER_SQL} SELECT ticker, window_end, alone AS score, pattern AS cep_match FROM winner")
def _(s, d):
    rows = replayed(s, d, make_cep=lambda: CepDetector(CEP, point_severity=0.0))
    return rows.select("ticker", "window_end", ensemble_score({"cep": F.col("cep")}, {"cep": 1.0}).alias("score"), "cep_match")


# Evaluation.

LABEL_COUNTS = "(SELECT count(*) FILTER (WHERE quality = 0) AS dn, count(*) FILTER (WHERE toxic = 1) AS g, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS tp, count(*) AS n FROM labels)"


@query(
    "evl01_metrics",
    f"""SELECT dn AS detections, tp, dn - tp AS fp, g - tp AS fn, {R4("p")} AS precision, {R4("r")} AS recall, {R4("CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END")} AS f1,
{R6('(dn - tp) / (n - g)')} AS fp_rate, 0::DOUBLE AS latency_mean, 0::DOUBLE AS latency_median FROM (SELECT *, tp / dn AS p, tp / g AS r FROM {LABEL_COUNTS})""",
)
def _(s, d):
    rows = table(s, d, "labels")
    return evaluate.metrics(rows.where("quality = 0").select(F.col("doc_id").alias("d")), rows.where("toxic = 1").select(F.col("doc_id").alias("g")), rows.count(), 0)


@query(
    "evl02_tolerant_metrics",
    f"""WITH RECURSIVE {GREEDY_SQL}, m AS (SELECT d, g, abs(d - g) AS latency FROM greedy WHERE g IS NOT NULL),
c AS (SELECT (SELECT count(*) FROM det) AS d, (SELECT count(*) FROM truth) AS g, (SELECT count(*) FROM labels) AS n, count(*) AS tp, avg(latency) AS mean, median(latency) AS middle FROM m),
r AS (SELECT *, CASE WHEN d > 0 THEN tp / d ELSE 0 END AS p, CASE WHEN g > 0 THEN tp / g ELSE 0 END AS q FROM c)
SELECT d AS detections, tp, d - tp AS fp, g - tp AS fn, {R4("p")} AS precision, {R4("q")} AS recall, {R4("CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END")} AS f1, {R6("(d - tp) / (n - g)")} AS fp_rate,
coalesce({R2('mean')}, 0) AS latency_mean, coalesce({R2('middle')}, 0) AS latency_median FROM r""",
)
def _(s, d):
    rows = table(s, d, "labels")
    return evaluate.metrics(rows.where("quality = 0").select(F.col("doc_id").alias("d")), rows.where("toxic = 1").select(F.col("doc_id").alias("g")), rows.count())


@query("evl03_recall_by_type", f"SELECT lang AS anomaly_type, count(*) AS total, count(*) FILTER (WHERE quality = 0) AS matched, {R4('count(*) FILTER (WHERE quality = 0) / count(*)')} AS recall FROM labels JOIN documents USING (doc_id) WHERE toxic = 1 GROUP BY 1")
def _(s, d):
    rows = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", F.col("lang").alias("anomaly_type")), "doc_id").withColumnRenamed("doc_id", "g")
    truth = rows.where("toxic = 1").select("g", "anomaly_type")
    return evaluate.recall_by_type(truth, rows.where("toxic = 1 and quality = 0").select("g"))


@query(
    "evl04_by_detector",
    f"""WITH {SCORED_SQL}, u AS (SELECT is_truth, 'price' AS detector, price AS score FROM flagged UNION ALL SELECT is_truth, 'volume', volume FROM flagged UNION ALL SELECT is_truth, 'lstm_ae', lstm_ae FROM flagged),
c AS (SELECT detector, count(*) FILTER (WHERE score < -0.3::DOUBLE AND is_truth) AS tp, count(*) FILTER (WHERE score < -0.3::DOUBLE AND NOT is_truth) AS fp, count(*) FILTER (WHERE NOT score < -0.3::DOUBLE AND is_truth) AS fn FROM u GROUP BY 1),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS q FROM c)
SELECT detector, tp, fp, fn, {R4("p")} AS precision, {R4("q")} AS recall, {R4("CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END")} AS f1 FROM r""",
)
def _(s, d):
    return evaluate.by_detector(flagged(s, d), -0.3)


@query(
    "evl05_separation",
    f"""WITH {SCORED_SQL} SELECT {R4("ma")} AS mean_a, {R4("sqrt(va)")} AS std_a, {R4("mn")} AS mean_n, {R4("sqrt(vn)")} AS std_n, {R4("abs(mn - ma) / sqrt((va + vn) / 2)")} AS cohens_d
FROM (SELECT avg(anomaly_score) FILTER (WHERE is_truth) AS ma, var_pop(anomaly_score) FILTER (WHERE is_truth) AS va, avg(anomaly_score) FILTER (WHERE NOT is_truth) AS mn, var_pop(anomaly_score) FILTER (WHERE NOT is_truth) AS vn FROM flagged)""",
)
def _(s, d):
    return evaluate.separation(flagged(s, d), "anomaly_score")


def injected(s: SparkSession, d: str) -> DataFrame:
    rows = enriched(s, d).withColumn("row_id", F.concat_ws("@", "ticker", F.col("window_end").cast("string"))).withColumn("total_volume", F.col("total_volume").cast("double"))
    return inject.inject_drift(inject.inject_points(rows), "T1", "window_end")


@query("evl07_injection")
def _(s, d):
    return injected(s, d).select("ticker", "window_end", *FEATURES, "anomaly_type")


@query("evl08_drift_block", f"WITH {ENRICHED_SQL} SELECT ticker, window_end, hit, CASE WHEN hit THEN price_change_rate + 0.02::DOUBLE ELSE price_change_rate END AS price_change_rate, CASE WHEN hit THEN total_volume * 1.5::DOUBLE ELSE CAST(total_volume AS DOUBLE) END AS total_volume, CASE WHEN hit THEN avg_sentiment - 0.2::DOUBLE ELSE avg_sentiment END AS avg_sentiment, CAST(sentiment_shift AS DOUBLE) AS sentiment_shift FROM (SELECT *, r >= n // 2 AND r < n // 2 + {inject.drift_length('T1')} AND ticker = 'T1' AS hit FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY window_end) - 1 AS r, count(*) OVER (PARTITION BY ticker) AS n FROM enriched))")
def _(s, d):
    rows = enriched(s, d).withColumns({"total_volume": F.col("total_volume").cast("double"), "anomaly_type": F.lit(None).cast("string")})
    return inject.inject_drift(rows, "T1", "window_end").select("ticker", "window_end", F.col("anomaly_type").isNotNull().alias("hit"), *FEATURES)


@query("evl09_replay_after_warmup")
def _(s, d):
    rows = feature_ops.temporal_split(injected(s, d), ["window_end"])
    last = feature_ops.last_rows(rows.where("is_train"), SETTINGS.warmup_rows, ["window_end"])
    rows = last.unionByName(rows.where("not is_train"))
    return sequence.replay(rows, ["window_end"], CEP, warm="is_train", drift=False).select("ticker", "window_end", "ewma", "cep", "cep_match", "anomaly_type")


@query("evl10_timed_replay")
def _(s, d):
    return evaluate.latency_stats(sequence.timed_replay(enriched(s, d), ["window_end"], CEP).select("latency_ms"))


@query("evl12_drift_test")
def _(s, d):
    rows = hourly(s, d)
    start = int(0.8 * rows.count())
    rows = inject.shift_last_fifth(rows, ["window_end", "ticker"])
    drifts = sequence.replay(rows, ["position"], CEP).select("position", "drifted")
    return evaluate.first_drift(drifts, start)


@query("evl13_method_comparison")
def _(s, d):
    rows = injected(s, d)
    scored = sequence.replay(rows, ["window_end"], CEP, drift=False).select(*rows.columns, "ewma", "cep")
    only = sequence.replay(rows, ["window_end"], CEP, make_cep=lambda: CepDetector(CEP, point_severity=0.0), drift=False).select("row_id", F.col("cep").alias("automata"))
    scored = scored.join(only, "row_id")
    position = stored(inject.positions(stored(scored, "scored"), ["ticker", "window_end"]), "positions")
    n = position.count()
    out = None
    for name, threshold in (("ewma", SETTINGS.threshold), ("cep", SETTINGS.cep_threshold), ("automata", SETTINGS.cep_threshold)):
        one = evaluate.metrics(position.where(F.col(name) < threshold).select(F.col("position").alias("d")), position.where("anomaly_type is not null").select(F.col("position").alias("g")), n).withColumn("method", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("evl14_event_study")
def _(s, d):
    return event_study.event_study(daily(s, d), study_events(s), replace(SETTINGS, hst_window=20))


@query("trn01_training_summary")
def _(s, d):
    rows = enriched(s, d)
    return training.training_summary(rows, training.fit_iforest(rows))


@query("trn02_normalisation", f"WITH {ENRICHED_SQL} SELECT " + ", ".join(f"{R4(f'{g}({c})')} AS {n}_{c}" for c in FEATURES for n, g in (("mean", "avg"), ("std", "stddev_pop"))) + " FROM enriched")
def _(s, d):
    rows = training.normalisation(enriched(s, d))
    return rows.select(*(S.rounded(c, 4).alias(c) for c in rows.columns))


@query("trn03_registry", f"WITH {VERSIONS_SQL} SELECT model_name, CAST(version AS BIGINT) AS version, trained_at, sample_count, model_name <> 'model-A' AS is_active FROM versions UNION ALL SELECT 'model-A', max(version) + 1, 999, 42, TRUE FROM versions WHERE model_name = 'model-A'")
def _(s, d):
    rows = training.registered(versions(s, d), {"model_name": "model-A", "trained_at": 999, "sample_count": 42})
    return rows.withColumn("version", F.col("version").cast("long"))


# Streams.


@query("str01_03_stream_windows", f"WITH {FEATURES_SQL} SELECT ticker, window_start, total_volume, tick_count, first_close, last_close FROM feats WHERE window_end <= (SELECT max(ts) FROM ticks) - 30000")
def _(s, d):
    """Ticks as files of a stream: each window comes out once, when the watermark has passed its end."""
    source, out, state = scratch(s, "ticks"), scratch(s, "windows"), scratch(s, "checkpoint")
    rows = ticks(s, d).withColumn("time", S.from_epoch_millis("ts"))
    rows.write.parquet(source)
    stream = pipeline.windowed(s.readStream.schema(rows.schema).parquet(source), market.WINDOW_HOURS * 60)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    done = s.read.schema(stream.schema).parquet(out)
    return done.select("ticker", S.to_epoch_millis("window_start").alias("window_start"), "total_volume", "tick_count", S.rounded("first_close", 4).alias("first_close"), S.rounded("last_close", 4).alias("last_close"))


@query("str04_stateful_scoring", f"WITH RECURSIVE {WINNER_SQL}, {EWMA_SQL.removeprefix(ENRICHED_SQL + ', ')} SELECT ticker, window_end, ewma, cep, cep_match FROM winner JOIN ew USING (ticker, window_end)")
def _(s, d):
    """The stream's stateful operator on a batch: the same kernels as the replay."""
    return pipeline.scored(enriched(s, d), s=CEP).select("ticker", "window_end", "ewma", "cep", "cep_match")


@query("str04_stream_ensemble")
def _(s, d):
    """All four detectors in the stream's operator, their ensemble, its flag and its reason."""
    rows = enriched(s, d)
    out = pipeline.scored(rows, forest=training.fit_iforest(rows), autoencoder=training.fit_autoencoder(rows, ["window_end"]))
    return out.select("ticker", "window_end", *SETTINGS.weights, "anomaly_score", "is_anomaly", "reason")


# Whole runs.


@query("run_backtest")
def _(s, d):
    return backtest.backtest(enriched(s, d), ["window_end"], CEP, "T1")["metrics"]


@query("run_compare_methods")
def _(s, d):
    return backtest.compare_methods(enriched(s, d), ["window_end"], CEP)


@query("run_retrain")
def _(s, d):
    registry = s.createDataFrame([], TABLES["model_versions"][0])
    for _ in range(2):
        registry = backtest.retrain(s, enriched(s, d), registry, scratch(s, "models"))
    return registry.drop("trained_at", "model_path")
