"""Queries of the relational part: scans, sinks, filters, joins, aggregates, frames, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions import scalars as S
from tidewater.operators import enrich, evaluate, features, sequence, training
from tidewater.plans import dashboard
from tidewater.scratch import scratch
from tidewater.session import table
from tidewater.sources import market, readers, sinks
from tidewater.sources.market import BARS_SQL, NEWS_SQL, TICKS_SQL

from .base import ASOF, ENRICHED_SQL, FEATURES_SQL, R4, R6, SCORED_SQL, enriched, feats, flagged, longs, query, ticks

# Scans, sinks, projections and filters.


@query("src01_latest_bar", f"WITH {TICKS_SQL} SELECT ticker, arg_max(ts, ts * 1000000 + event_id) AS ts, arg_max(close, ts * 1000000 + event_id) AS close, arg_max(volume, ts * 1000000 + event_id) AS volume FROM ticks GROUP BY 1")
def _(s, d):
    bars = ticks(s, d).select("ticker", F.col("ts").alias("time"), "event_id", "close", "volume")
    return readers.latest_bar(bars, "event_id").withColumnRenamed("time", "ts")


@query("src02_news_items", "SELECT event_id, event_type || ' ' || CAST(user_id AS VARCHAR) AS title, CASE WHEN event_id % 3 = 0 THEN 'wire' WHEN event_id % 3 = 1 THEN 'desk' ELSE 'unknown' END AS publisher FROM events WHERE event_type IN ('error', 'signup') AND event_id % 7 <> 0")
def _(s, d):
    title = F.when(F.col("event_id") % 7 == 0, "  ").otherwise(F.concat_ws(" ", "event_type", F.col("user_id").cast("string")))
    nested = F.to_json(F.struct(F.struct(title.alias("title"), F.struct(F.lit("wire").alias("displayName")).alias("provider")).alias("content")))
    flat = F.to_json(F.struct(title.alias("title"), F.when(F.col("event_id") % 3 == 1, "desk").alias("provider")))
    raw = table(s, d, "events").where(F.col("event_type").isin("error", "signup")).select("event_id", F.when(F.col("event_id") % 3 == 0, nested).otherwise(flat).alias("item"))
    return readers.news_items(raw).drop("item")


@query("src05_parsed_prices", f"WITH {TICKS_SQL} SELECT ticker, close, coalesce(volume, -1) AS volume, event_id % 10 = 0 AS corrupt FROM (SELECT CASE WHEN event_id % 10 = 0 THEN NULL ELSE ticker END AS ticker, CASE WHEN event_id % 10 = 0 THEN NULL ELSE close END AS close, CASE WHEN event_id % 10 = 0 THEN NULL ELSE volume END AS volume, event_id FROM ticks)")
def _(s, d):
    good = F.to_json(F.struct("ticker", F.lit("2024-01-01T00:00:00Z").alias("timestamp"), "close", "volume"))
    rows = readers.prices(ticks(s, d).select(F.when(F.col("event_id") % 10 == 0, "{broken").otherwise(good).alias("value")))
    return rows.select("ticker", "close", F.coalesce("volume", F.lit(-1)).alias("volume"), F.col("_corrupt").isNotNull().alias("corrupt"))


@query("src06_ohlcv_scan", f"WITH {TICKS_SQL} SELECT ticker, ts, close AS open, close, volume FROM ticks WHERE ticker IN ('T0', 'T1') AND ts >= 1704153600000 AND ts < 1706140800000 UNION ALL SELECT ticker, ts, close AS open, close, volume FROM ticks WHERE ticker = 'T2'")
def _(s, d):
    """Bars from a file, by tickers and from one day to another, beside those of another ticker."""
    path = scratch(s, "bars")
    ticks(s, d).select("ticker", S.from_epoch_millis("ts").alias("Datetime"), F.col("close").alias("open"), "close", "volume").write.parquet(path)
    rows = readers.union_bars([readers.ohlcv(s, path, ["T0", "T1"], "2024-01-02", "2024-01-25"), readers.ohlcv(s, path, ["T2"])])
    return rows.select("ticker", S.to_epoch_millis("timestamp").alias("ts"), "open", "close", "volume")


@query("src07_daily_range", f"WITH {BARS_SQL} SELECT * FROM bars WHERE ticker = '1-URGENT' AND day >= 9000 AND day < 9500")
def _(s, d):
    return market.daily_bars(s, d).where("ticker = '1-URGENT' and day >= 9000 and day < 9500")


SLIDING_SQL = f"""{TICKS_SQL}, framed AS (SELECT *, row_number() OVER t AS rn, count(*) OVER (PARTITION BY ticker) AS n, first_value(close) OVER w AS f, CAST(sum(close_e4) OVER w AS BIGINT) AS s, CAST(sum(volume) OVER w AS BIGINT) AS v
  FROM ticks WINDOW t AS (PARTITION BY ticker ORDER BY ts, event_id), w AS (PARTITION BY ticker ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
slid AS (SELECT ticker, ts, event_id, {R4("CAST(s AS DOUBLE) / 5 / 10000::DOUBLE")} AS avg_close, CASE WHEN f = 0 THEN 0::DOUBLE ELSE {R6("(close - f) / f")} END AS price_change_rate, v AS total_volume FROM framed WHERE rn >= 5 AND rn < n)"""


@query("src08_win01_fea06_sliding_features", f"WITH {SLIDING_SQL} SELECT * FROM slid")
def _(s, d):
    return features.sliding_features(ticks(s, d))


@query("fea07_seeded_sentiment")
def _(s, d):
    return features.with_seeded_sentiment(features.sliding_features(ticks(s, d)))


@query("src09_parameterised_sql", f"WITH {FEATURES_SQL} SELECT ticker, count(*) AS n, CAST(sum(total_volume) AS BIGINT) AS volume FROM feats WHERE ticker = 'T1' AND total_volume > 100 GROUP BY 1")
def _(s, d):
    return s.sql("SELECT ticker, count(*) AS n, sum(total_volume) AS volume FROM {f} WHERE ticker = :ticker AND total_volume > :least GROUP BY 1", args={"ticker": "T1", "least": 100}, f=feats(s, d))


@query("src10_model_round_trip")
def _(s, d):
    rows = enriched(s, d)
    path = training.save_model(s, training.fit_iforest(rows), scratch(s, "model"), 1)
    return sequence.with_iforest(rows.select("ticker", "window_end", "price_change_rate", "total_volume", "avg_sentiment", "sentiment_shift"), training.load_model(s, path))


@query("snk01_keyed_messages", f"""WITH {TICKS_SQL} SELECT ticker AS key, '{{"ticker":"' || ticker || '","ts":' || CAST(ts AS VARCHAR) || ',"volume":' || CAST(volume AS VARCHAR) || '}}' AS value FROM ticks""")
def _(s, d):
    return sinks.messages(ticks(s, d).select("ticker", "ts", "volume"))


@query("snk02_table_by_day", f"WITH {NEWS_SQL} SELECT ticker, ts, score FROM news WHERE ts >= 1704153600000 AND ts < 1704240000000")
def _(s, d):
    path = scratch(s, "sentiment_scores")
    rows = market.news(s, d).withColumn("time", S.from_epoch_millis("ts"))
    sinks.append(rows, path, "time")
    return s.read.parquet(path).where("day = date'2024-01-02'").select("ticker", "ts", "score")


@query("snk06_csv", f"WITH {FEATURES_SQL} SELECT ticker, window_end, total_volume FROM feats")
def _(s, d):
    path = scratch(s, "csv")
    sinks.write_csv(feats(s, d).select("ticker", "window_end", "total_volume"), path)
    return s.read.schema("ticker string, window_end long, total_volume long").option("header", True).csv(path)


@query("prj01_projection", f"WITH {FEATURES_SQL} SELECT ticker, window_end, avg_close FROM feats")
def _(s, d):
    return feats(s, d).select("ticker", "window_end", "avg_close")


@query("prj02_enrich_and_rename", f"WITH {FEATURES_SQL} SELECT ticker AS symbol, window_end AS at, total_volume AS volume, 0::DOUBLE AS avg_sentiment FROM feats")
def _(s, d):
    return feats(s, d).select("ticker", "window_end", "total_volume").withColumn("avg_sentiment", F.lit(0.0)).toDF("symbol", "at", "volume", "avg_sentiment")


@query("flt01_equality_or_all", f"WITH {FEATURES_SQL} SELECT 'T3' AS chosen, ticker, window_end FROM feats WHERE ticker = 'T3' UNION ALL SELECT 'All', ticker, window_end FROM feats")
def _(s, d):
    rows = feats(s, d).select("ticker", "window_end")
    pick = lambda t: dashboard.one_ticker(rows, t).select(F.lit(t).alias("chosen"), "ticker", "window_end")
    return pick("T3").unionByName(pick("All"))


@query("flt02_membership", f"WITH {FEATURES_SQL} SELECT ticker, window_end, avg_close FROM feats WHERE ticker IN ('T0', 'T4')")
def _(s, d):
    return feats(s, d).where(F.array_contains(F.array(F.lit("T0"), F.lit("T4")), F.col("ticker"))).select("ticker", "window_end", "avg_close")


@query("flt03_relative_time", f"WITH {NEWS_SQL} SELECT ticker, ts, event_id FROM news WHERE ts > {ASOF} - 72 * 3600000")
def _(s, d):
    return market.news(s, d).where(dashboard.since("ts", 72, F.lit(ASOF))).select("ticker", "ts", "event_id")


@query("flt04_not_null", "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def _(s, d):
    return table(s, d, "documents").select("doc_id").join(table(s, d, "labels"), "doc_id", "left").where(F.col("quality").isNotNull()).select("doc_id", "quality")


@query("flt05_anomaly_predicate", f"WITH {SCORED_SQL} SELECT ticker, window_end, anomaly_score FROM flagged WHERE is_anomaly")
def _(s, d):
    return flagged(s, d).where("is_anomaly").select("ticker", "window_end", "anomaly_score")


@query("flt06_to_09_guards", f"WITH {ENRICHED_SQL} SELECT ticker, window_end, price_change_rate > 0.01::DOUBLE AS gt, price_change_rate < -0.01::DOUBLE AS lt, total_volume >= 500 AS gte, abs(price_change_rate) > 0.03::DOUBLE AS abs_gt, FALSE AS missing FROM enriched")
def _(s, d):
    rows = enriched(s, d).withColumn("nothing", F.lit(None).cast("double"))
    return rows.select("ticker", "window_end", S.feature_gt("price_change_rate", 0.01).alias("gt"), S.feature_lt("price_change_rate", -0.01).alias("lt"), S.feature_gte("total_volume", 500).alias("gte"), S.feature_abs_gt("price_change_rate", 0.03).alias("abs_gt"), S.feature_gt("nothing", 0.0).alias("missing"))


@query("flt10_first_seen", "SELECT event_type || ' ' || CAST(user_id AS VARCHAR) AS title, min(event_id) AS event_id FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1")
def _(s, d):
    rows = table(s, d, "events").where(F.col("event_type").isin("error", "signup")).select(F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("title"), "event_id")
    return features.first_seen(rows, "title", ["event_id"])


# Joins.


@query("jon01_asof_enrichment", f"WITH {ENRICHED_SQL} SELECT ticker, window_end, avg_sentiment, sentiment_shift, headline_count FROM enriched")
def _(s, d):
    return enriched(s, d).select("ticker", "window_end", "avg_sentiment", "sentiment_shift", "headline_count")


#: Each detection in order takes the first truth that is near enough and not taken; truths taken long before don't matter.
GREEDY_SQL = """det AS (SELECT d, row_number() OVER (ORDER BY d) AS rn FROM (SELECT DISTINCT doc_id AS d FROM labels WHERE quality = 0)), truth AS (SELECT DISTINCT doc_id AS g FROM labels WHERE toxic = 1),
near AS (SELECT det.d, det.rn, coalesce(list(g ORDER BY abs(g - det.d), g) FILTER (WHERE g IS NOT NULL), []) AS gs FROM det LEFT JOIN truth ON g BETWEEN det.d - 2 AND det.d + 2 GROUP BY 1, 2),
greedy AS (SELECT 0::BIGINT AS rn, NULL::BIGINT AS d, NULL::BIGINT AS g, []::BIGINT[] AS taken UNION ALL
  SELECT rn, d, free[1], list_filter(list_append(taken, free[1]), lambda x: x >= d - 2)
  FROM (SELECT n.rn, n.d, m.taken, list_filter(n.gs, lambda x: NOT list_contains(m.taken, x)) AS free FROM greedy m JOIN near n ON n.rn = m.rn + 1))"""


@query("jon02_evl01_tolerant_matches", f"WITH RECURSIVE {GREEDY_SQL} SELECT d, g FROM greedy WHERE g IS NOT NULL")
def _(s, d):
    rows = table(s, d, "labels")
    return evaluate.matches(rows.where("quality = 0").select(F.col("doc_id").alias("d")), rows.where("toxic = 1").select(F.col("doc_id").alias("g")))


VERSIONS_SQL = "versions AS (SELECT 'model-' || l_returnflag AS model_name, CAST(row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipmonth) AS INTEGER) AS version, l_shipmonth AS trained_at, n AS sample_count FROM (SELECT l_returnflag, date_diff('month', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS l_shipmonth, count(*) AS n FROM lineitem GROUP BY 1, 2))"


def versions(s: SparkSession, d: str) -> DataFrame:
    """A registry of models: one a return flag, a version a month of shipping."""
    month = (F.year("l_shipdate") - 1970) * 12 + F.month("l_shipdate") - 1
    rows = table(s, d, "lineitem").groupBy("l_returnflag", month.cast("long").alias("trained_at")).agg(F.count(F.lit(1)).alias("sample_count"))
    version = F.row_number().over(Window.partitionBy("l_returnflag").orderBy("trained_at"))
    return rows.select(F.concat(F.lit("model-"), "l_returnflag").alias("model_name"), version.alias("version"), "trained_at", "sample_count", F.lit(True).alias("is_active"))


@query("jon03_latest_version", f"WITH {VERSIONS_SQL} SELECT model_name, max(version) AS version, arg_max(trained_at, version) AS trained_at, arg_max(sample_count, version) AS sample_count FROM versions GROUP BY 1")
def _(s, d):
    return training.latest(versions(s, d)).drop("is_active")


DAILY_SQL = f"""{BARS_SQL}, daily AS (SELECT ticker, day, close, CASE WHEN prev = 0 THEN 0::DOUBLE ELSE {R6("(close - prev) / prev")} END AS price_change_rate, volume AS total_volume, 0::DOUBLE AS avg_sentiment, 0::DOUBLE AS sentiment_shift
  FROM (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY day) AS prev FROM bars) WHERE prev IS NOT NULL)"""
EVENTS_SQL = "wanted AS (SELECT * FROM (VALUES ('1-URGENT', 9200), ('2-HIGH', 9300), ('5-LOW', 9400)) AS v(ticker, event_day))"


def daily(s: SparkSession, d: str) -> DataFrame:
    return features.daily_features(market.daily_bars(s, d))


def study_events(s: SparkSession) -> DataFrame:
    return s.createDataFrame([("1-URGENT", 9200), ("2-HIGH", 9300), ("5-LOW", 9400)], "ticker string, day int")


ANCHOR_SQL = f"""WITH {DAILY_SQL}, {EVENTS_SQL}, numbered AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY day) AS rn FROM daily),
near AS (SELECT ticker, event_day, arg_min(rn, abs(day - event_day) * 100000 + rn) AS place FROM numbered JOIN wanted USING (ticker) GROUP BY 1, 2),
band AS (SELECT n.ticker, n.event_day, d.day, d.price_change_rate, row_number() OVER (PARTITION BY n.ticker, n.event_day ORDER BY abs(d.price_change_rate) DESC, d.rn) AS r FROM near n JOIN numbered d ON d.ticker = n.ticker AND d.rn BETWEEN n.place - 2 AND n.place + 2)"""


@query("jon04_event_anchor", f"{ANCHOR_SQL} SELECT ticker, CAST(event_day AS BIGINT) AS event_day, CAST(day AS BIGINT) AS day, price_change_rate FROM band WHERE r = 1")
def _(s, d):
    return longs(enrich.anchored(daily(s, d), study_events(s)), "event_day", "day")


@query("jon05_semi_and_anti", "SELECT doc_id, 'labelled' AS part FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'rest' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(s, d):
    docs, labels = table(s, d, "documents").select("doc_id"), table(s, d, "labels").select("doc_id")
    return docs.join(labels, "doc_id", "left_semi").withColumn("part", F.lit("labelled")).unionByName(docs.join(labels, "doc_id", "left_anti").withColumn("part", F.lit("rest")))


# Aggregates.


@query("agg01_02_fea05_window_features", f"WITH {FEATURES_SQL} SELECT * FROM feats")
def _(s, d):
    return feats(s, d)


@query("fea05_five_minute_windows", f"WITH {TICKS_SQL} SELECT ticker, ts - ts % 300000 AS window_start, count(*) AS tick_count, CAST(sum(volume) AS BIGINT) AS total_volume FROM ticks GROUP BY 1, 2")
def _(s, d):
    return features.tumbling_features(ticks(s, d)).select("ticker", "window_start", "tick_count", "total_volume")


@query("agg03_filtered_counts", f"WITH {NEWS_SQL} SELECT ticker, max(ts) AS latest, count(*) FILTER (WHERE score_c < 0) AS negative FROM news GROUP BY 1")
def _(s, d):
    return s.sql("SELECT ticker, max(ts) AS latest, count(*) FILTER (WHERE score_c < 0) AS negative FROM {n} GROUP BY ticker", n=market.news(s, d))


@query("agg04_global_counts", f"WITH {NEWS_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE label = 'positive') AS positive FROM news")
def _(s, d):
    return market.news(s, d).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("label") == "positive").alias("positive"))


@query("agg05_dsh07_hourly_rate", f"WITH {SCORED_SQL} SELECT window_end - window_end % 3600000 AS hour, count(*) AS total, CAST(sum(CASE WHEN is_anomaly THEN 1 ELSE 0 END) AS BIGINT) AS anomalies, sum(CASE WHEN is_anomaly THEN 1 ELSE 0 END) / count(*) AS rate FROM flagged WHERE window_end > {ASOF} - 240 * 3600000 GROUP BY 1")
def _(s, d):
    return dashboard.hourly_rate(flagged(s, d), 240, ASOF)


ALERTS_SQL = f"{SCORED_SQL}, alerts AS (SELECT ticker, window_end AS ts, anomaly_score AS score FROM flagged WHERE is_anomaly)"


def alerts(s: SparkSession, d: str) -> DataFrame:
    return flagged(s, d).where("is_anomaly").select("ticker", F.col("window_end").alias("ts"), F.col("anomaly_score").alias("score"))


@query("agg06_dsh03_recent_alerts", f"WITH {ALERTS_SQL} SELECT ticker, ts, score, CASE WHEN score < -0.4::DOUBLE THEN 'high' ELSE 'normal' END AS severity, (SELECT count(*) FROM alerts) AS total, (SELECT count(*) FROM alerts WHERE score < -0.4::DOUBLE) AS high, (SELECT count(*) FROM alerts WHERE score >= -0.4::DOUBLE) AS normal FROM alerts ORDER BY ts DESC, ticker LIMIT 50")
def _(s, d):
    return dashboard.recent_alerts(alerts(s, d), high=-0.4)


@query("agg07_dsh15_label_mix", f"WITH {NEWS_SQL} SELECT ticker, count(*) FILTER (WHERE label = 'positive') AS positive, count(*) FILTER (WHERE label = 'negative') AS negative, count(*) FILTER (WHERE label = 'neutral') AS neutral, CAST(sum(score_c) AS DOUBLE) / count(*) / 100::DOUBLE AS mean_score FROM news GROUP BY 1")
def _(s, d):
    return dashboard.label_mix(market.news(s, d))


@query("agg08_count_by_type", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("agg09_population_moments", f"WITH {NEWS_SQL} SELECT ticker, {R4('avg(score_c)')} AS mean, {R4('stddev_pop(score_c)')} AS std, {R4('var_pop(score_c)')} AS var FROM news GROUP BY 1")
def _(s, d):
    return market.news(s, d).groupBy("ticker").agg(S.rounded(F.avg("score_c"), 4).alias("mean"), S.rounded(F.stddev_pop("score_c"), 4).alias("std"), S.rounded(F.var_pop("score_c"), 4).alias("var"))


@query("agg10_median", f"WITH {TICKS_SQL} SELECT ticker, median(volume) AS median FROM ticks GROUP BY 1")
def _(s, d):
    return ticks(s, d).groupBy("ticker").agg(F.median("volume").alias("median"))


@query("agg11_evl11_latency_stats", f"WITH {TICKS_SQL}, l AS (SELECT volume AS v, row_number() OVER (ORDER BY volume) AS r, count(*) OVER () AS n FROM ticks) SELECT {R4('avg(v)')} AS mean, {R4('median(v)')} AS median, {R4('max(v)')} AS max, {R4('max(v) FILTER (WHERE r = least(n - 1, CAST(floor(0.99::DOUBLE * n) AS BIGINT)) + 1)')} AS p99 FROM l")
def _(s, d):
    return evaluate.latency_stats(ticks(s, d), "volume")


@query("agg12_arg_extremes", f"WITH {DAILY_SQL} SELECT ticker, arg_min(day, close) AS lowest, arg_max(day, close) AS highest FROM daily GROUP BY 1")
def _(s, d):
    return longs(daily(s, d).groupBy("ticker").agg(F.min_by("day", F.struct("close", "day")).alias("lowest"), F.max_by("day", F.struct("close", -F.col("day"))).alias("highest")), "lowest", "highest")


@query("agg13_distinct", "SELECT DISTINCT event_type, user_id % 5 AS k FROM events")
def _(s, d):
    return table(s, d, "events").select("event_type", (F.col("user_id") % 5).alias("k")).distinct()


@query("agg14_vote_share", f"WITH {SCORED_SQL} SELECT ticker, window_end, (CAST(price < -0.3::DOUBLE AS INTEGER) + CAST(volume < -0.3::DOUBLE AS INTEGER) + CAST(lstm_ae < -0.3::DOUBLE AS INTEGER)) / 3::DOUBLE AS agreement FROM flagged")
def _(s, d):
    return dashboard.vote_shares(flagged(s, d))


# Frames, order, sets.


@query("win02_fea08_daily_returns", f"WITH {DAILY_SQL} SELECT * FROM daily")
def _(s, d):
    return daily(s, d)


@query("win03_last_rows", f"WITH {FEATURES_SQL} SELECT ticker, window_end FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY window_end DESC) AS r FROM feats) WHERE r <= 50")
def _(s, d):
    return features.last_rows(feats(s, d), 50, ["window_end"]).select("ticker", "window_end")


@query("win04_sequences", f"WITH {FEATURES_SQL}, q AS (SELECT ticker, window_end, CAST(sum(total_volume * pos) OVER w AS BIGINT) AS x, CAST(sum(total_volume) OVER w AS BIGINT) AS y, row_number() OVER (PARTITION BY ticker ORDER BY window_start) AS rn FROM (SELECT *, 1 AS pos FROM feats) WINDOW w AS (PARTITION BY ticker ORDER BY window_start ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) SELECT ticker, window_end, y AS total, CAST(12 AS BIGINT) AS n FROM q WHERE rn >= 12")
def _(s, d):
    rows = features.sequences(feats(s, d), "total_volume")
    return rows.select("ticker", "window_end", F.aggregate("sequence", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size("sequence").cast("long").alias("n"))


@query("win05_buffers", f"WITH {FEATURES_SQL} SELECT ticker, window_end, CAST(count(*) OVER w AS BIGINT) AS n, CAST(coalesce(sum(total_volume) OVER w, 0) AS BIGINT) AS total FROM feats WINDOW w AS (PARTITION BY ticker ORDER BY window_start ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)")
def _(s, d):
    rows = features.buffers(feats(s, d), "total_volume")
    return rows.select("ticker", "window_end", F.size("buffer").cast("long").alias("n"), F.aggregate("buffer", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("win06_neighbourhood", f"WITH {DAILY_SQL}, numbered AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY day) AS rn FROM daily), anchors AS (SELECT * FROM numbered WHERE abs(price_change_rate) >= 0.05::DOUBLE) SELECT a.ticker, a.day AS anchor, CAST(n.rn - a.rn AS BIGINT) AS offset_rows, n.day, n.price_change_rate FROM anchors a JOIN numbered n ON n.ticker = a.ticker AND n.rn BETWEEN a.rn - 2 AND a.rn + 2")
def _(s, d):
    rows = daily(s, d)
    near = features.neighbourhood(rows, rows.where(F.abs("price_change_rate") >= 0.05).select("ticker", F.col("day").alias("at")), "day")
    return longs(near.select("ticker", F.col("at").alias("anchor"), F.col("offset").alias("offset_rows"), "day", "price_change_rate"), "offset_rows")


@query("win07_evl06_temporal_split", f"WITH {FEATURES_SQL} SELECT ticker, window_end, row_number() OVER (PARTITION BY ticker ORDER BY window_end) <= floor(count(*) OVER (PARTITION BY ticker) * 0.7::DOUBLE) AS is_train FROM feats")
def _(s, d):
    return features.temporal_split(feats(s, d), ["window_end"]).select("ticker", "window_end", "is_train")


@query("srt01_04_order_and_top", f"WITH {NEWS_SQL} SELECT ticker, ts, event_id, score_c FROM news ORDER BY score_c DESC, event_id LIMIT 20")
def _(s, d):
    return market.news(s, d).select("ticker", "ts", "event_id", "score_c").orderBy(F.desc("score_c"), "event_id").limit(20)


@query("srt05_event_order", "SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), '+') AS kinds FROM events GROUP BY 1")
def _(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), "+").alias("kinds"))


@query("set01_union_all", "SELECT doc_id AS id FROM documents UNION ALL SELECT page_id AS id FROM pages")
def _(s, d):
    return table(s, d, "documents").select(F.col("doc_id").alias("id")).unionByName(table(s, d, "pages").select(F.col("page_id").alias("id")))


@query("set02_event_sets", "WITH e AS (SELECT user_id, list(DISTINCT event_type) FILTER (WHERE event_id % 2 = 0) AS a, list(DISTINCT event_type) FILTER (WHERE event_id % 2 = 1) AS b FROM events GROUP BY 1) SELECT user_id, array_to_string(list_sort(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))), '+') AS either, array_to_string(list_sort(list_intersect(coalesce(a, []), coalesce(b, []))), '+') AS both_, array_to_string(list_sort(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x))), '+') AS first_only FROM e")
def _(s, d):
    odd = F.col("event_id") % 2 == 1
    e = table(s, d, "events").groupBy("user_id").agg(F.collect_set(F.when(~odd, F.col("event_type"))).alias("a"), F.collect_set(F.when(odd, F.col("event_type"))).alias("b"))
    text = lambda c: F.array_join(F.array_sort(c), "+")
    return e.select("user_id", text(F.array_union("a", "b")).alias("either"), text(F.array_intersect("a", "b")).alias("both_"), text(F.array_except("a", "b")).alias("first_only"))


@query("set03_index_sets", "SELECT doc_id, 'hit' AS part FROM labels WHERE toxic = 1 AND quality = 0 UNION ALL SELECT doc_id, 'missed' FROM labels WHERE toxic = 1 AND quality <> 0 UNION ALL SELECT doc_id, 'false' FROM labels WHERE toxic <> 1 AND quality = 0")
def _(s, d):
    rows = table(s, d, "labels")
    truth, found = rows.where("toxic = 1").select("doc_id"), rows.where("quality = 0").select("doc_id")
    part = lambda df, name: df.withColumn("part", F.lit(name))
    return part(found.intersect(truth), "hit").unionByName(part(truth.join(found, "doc_id", "left_anti"), "missed")).unionByName(part(found.exceptAll(truth), "false"))
