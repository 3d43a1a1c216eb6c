"""Sentiment, on-chain flows and joins in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodemark.operators import rolling
from lodemark.operators import rollups as roll
from lodemark.operators import temporal

from .registry import query
from .tables import candles, onchain_events, onchain_transactions, sentiment_scores, system_metrics, ticks

AS_OF = "2024-01-29 12:00:00"
T = f"TIMESTAMP '{AS_OF}'"


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


@query(
    """SELECT symbol, date_trunc('hour', ts) AS ts, count(*) AS n, round(avg(sentiment_score), 6) AS avg_score, round(stddev_pop(sentiment_score), 6) AS std_score, round(avg(CASE WHEN sentiment_score > 0.66 THEN 1.0::DOUBLE ELSE 0 END), 6) AS bullish,
    round(avg(CASE WHEN sentiment_score < 0.34 THEN 1.0::DOUBLE ELSE 0 END), 6) AS bearish, round(avg(CASE WHEN sentiment_score BETWEEN 0.34 AND 0.66 THEN 1.0::DOUBLE ELSE 0 END), 6) AS neutral FROM sentiment_scores GROUP BY 1, 2""",
    "sentiment_scores",
)
def sentiment_hourly(spark, sf_dir):
    return roll.sentiment_hourly(sentiment_scores(spark, sf_dir))


@query(
    f"""SELECT symbol, w.window, count(*) AS n, round(avg(sentiment_score), 6) AS avg_score, round(stddev_pop(sentiment_score), 6) AS std_score, round(avg(CASE WHEN sentiment_label = 'BULLISH' THEN 1.0::DOUBLE ELSE 0 END), 6) AS bullish,
    round(avg(CASE WHEN sentiment_label IN ('BEARISH', 'FUD') THEN 1.0::DOUBLE ELSE 0 END), 6) AS bearish, round(avg(CASE WHEN sentiment_label = 'NEUTRAL' THEN 1.0::DOUBLE ELSE 0 END), 6) AS neutral, round(avg(sentiment_score * coalesce(confidence, 0.5)), 6) AS weighted
    FROM sentiment_scores, (VALUES ('1h', INTERVAL 1 HOUR), ('4h', INTERVAL 4 HOUR), ('24h', INTERVAL 24 HOUR), ('7d', INTERVAL 168 HOUR)) w("window", width) WHERE ts >= {T} - width AND ts <= {T} GROUP BY 1, 2""",
    "sentiment_scores",
)
def sentiment_trailing_windows(spark, sf_dir):
    return roll.sentiment_trailing(sentiment_scores(spark, sf_dir), as_of())


@query(
    f"""WITH w("window", s) AS (VALUES ('15m', 900), ('1h', 3600), ('4h', 14400), ('24h', 86400)), x AS (SELECT *, greatest(epoch_us({T}) - epoch_us(ts), 0) / 1e6 AS age, 1.0::DOUBLE + id % 3 AS vw FROM sentiment_scores WHERE ts <= {T}),
    m AS (SELECT symbol, "window", sum(sentiment_score * greatest(vw, 0.1) * greatest(confidence, 0.1) / (1 + age / s)) / sum(greatest(vw, 0.1) * greatest(confidence, 0.1) / (1 + age / s)) AS m FROM x, w WHERE age <= s GROUP BY 1, 2)
    SELECT g.symbol, g.window, round(coalesce(m, 0.5), 6) AS score FROM (SELECT DISTINCT symbol, "window" FROM sentiment_scores, w) g LEFT JOIN m USING (symbol, "window")""",
    "sentiment_scores",
)
def sentiment_decay_flat(spark, sf_dir):
    scores = sentiment_scores(spark, sf_dir).withColumn("volume_weight", 1.0 + F.col("id") % 3)
    return roll.decayed_flat(scores, as_of(), {"15m": 900, "1h": 3600, "4h": 14400, "24h": 86400})


@query(
    f"""WITH x AS (SELECT *, greatest(epoch_us({T}) - epoch_us(ts), 0) / 1e6 / 3600 AS age, CASE sentiment_label WHEN 'BULLISH' THEN 0.9::DOUBLE WHEN 'NEUTRAL' THEN 0.5 WHEN 'BEARISH' THEN 0.2 ELSE 0.1 END AS v,
      CASE source_type WHEN 'news' THEN 1.0::DOUBLE WHEN 'reddit' THEN 0.7 WHEN 'onchain' THEN 0.9 ELSE 0.5 END AS sw FROM sentiment_scores WHERE ts <= {T}),
    y AS (SELECT symbol, v, confidence * sw / (1 + age) * pow(least(greatest(id % 7000, 1), 5000), 0.2) AS w FROM x), z AS (SELECT symbol, round(sum(v * w) / nullif(sum(w), 0), 6) AS score FROM y GROUP BY 1)
    SELECT symbol, score, CASE WHEN score >= 0.66 THEN 'BULLISH' WHEN score <= 0.34 THEN 'BEARISH' ELSE 'NEUTRAL' END AS label FROM z""",
    "sentiment_scores",
)
def sentiment_decay_weighted(spark, sf_dir):
    return roll.decayed_weighted(sentiment_scores(spark, sf_dir).withColumn("upvotes", F.col("id") % 7000), as_of())


@query(
    """SELECT symbol, round(sum(sentiment_score * confidence) / nullif(sum(confidence), 0), 6) AS weighted, count(*) FILTER (sentiment_label = 'BULLISH') AS bullish, count(*) FILTER (sentiment_label = 'BEARISH') AS bearish,
    count(*) FILTER (sentiment_label = 'NEUTRAL') AS neutral, count(*) FILTER (sentiment_label = 'FUD') AS fud, (SELECT sentiment_label FROM (SELECT sentiment_label, count(*) AS c FROM sentiment_scores x WHERE x.symbol = s.symbol GROUP BY 1) ORDER BY c DESC, sentiment_label LIMIT 1) AS dominant
    FROM sentiment_scores s GROUP BY 1""",
    "sentiment_scores",
)
def label_histogram(spark, sf_dir):
    scores = sentiment_scores(spark, sf_dir)
    counts = {k.lower(): F.count_if(F.col("sentiment_label") == k) for k in ("BULLISH", "BEARISH", "NEUTRAL", "FUD")}
    out = scores.groupBy("symbol").agg(F.round(F.try_divide(F.sum(F.col("sentiment_score") * F.col("confidence")), F.sum("confidence")), 6).alias("weighted"), *(v.alias(k) for k, v in counts.items()))
    best = F.greatest(*counts)
    dominant = F.when(F.col("bearish") == best, "BEARISH").when(F.col("bullish") == best, "BULLISH").when(F.col("fud") == best, "FUD").otherwise("NEUTRAL")
    return out.withColumn("dominant", dominant)


@query(
    f"""SELECT symbol, round(avg(sentiment_score) FILTER (ts >= {T} - INTERVAL 24 HOUR), 6) AS ma_24h, round(avg(sentiment_score), 6) AS ma_7d, round(stddev_pop(sentiment_score) FILTER (ts >= {T} - INTERVAL 24 HOUR), 6) AS vol_24h,
    arg_max(sentiment_score, {{t: ts, i: id}}) AS current, round(arg_max(sentiment_score, {{t: ts, i: id}}) - avg(sentiment_score) FILTER (ts >= {T} - INTERVAL 24 HOUR), 6) AS velocity,
    count(*) FILTER (source_type = 'news') AS news, count(*) FILTER (source_type = 'reddit') AS reddit, count(*) FILTER (source_type = 'onchain') AS onchain FROM sentiment_scores WHERE ts <= {T} AND ts >= {T} - INTERVAL 7 DAY GROUP BY 1""",
    "sentiment_scores",
)
def sentiment_features(spark, sf_dir):
    s, day = F.col("sentiment_score"), F.col("ts") >= as_of() - F.expr("INTERVAL 24 HOURS")
    rows = sentiment_scores(spark, sf_dir).filter((F.col("ts") <= as_of()) & (F.col("ts") >= as_of() - F.expr("INTERVAL 7 DAYS")))
    current = F.max_by(s, F.struct("ts", "id"))
    return rows.groupBy("symbol").agg(
        F.round(F.avg(F.when(day, s)), 6).alias("ma_24h"), F.round(F.avg(s), 6).alias("ma_7d"), F.round(F.stddev_pop(F.when(day, s)), 6).alias("vol_24h"), current.alias("current"), F.round(current - F.avg(F.when(day, s)), 6).alias("velocity"),
        *(F.count_if(F.col("source_type") == k).alias(k) for k in ("news", "reddit", "onchain")),
    )


@query(
    """SELECT s.symbol, round(corr(s.sentiment_score, c.close), 6) AS corr, count(*) AS n FROM (SELECT *, date_trunc('hour', ts) AS h FROM sentiment_scores) s JOIN candles_1h c ON c.symbol = s.symbol AND c.ts = s.h GROUP BY 1""",
    "sentiment_scores", "candles_1h",
)
def sentiment_price_corr(spark, sf_dir):
    joined = temporal.bucket_join(sentiment_scores(spark, sf_dir).select("symbol", "ts", "sentiment_score"), candles(spark, sf_dir).select("symbol", "ts", "close"), ["symbol"], how="inner")
    return joined.groupBy("symbol").agg(F.round(F.corr("sentiment_score", "close"), 6).alias("corr"), F.count("*").alias("n"))


@query(
    """WITH s AS (SELECT symbol, date_trunc('hour', ts) AS h, round(avg(sentiment_score), 6) AS score FROM sentiment_scores GROUP BY 1, 2), w AS (SELECT symbol, date_trunc('hour', ts) AS h, count(*) AS n FROM onchain_events WHERE is_whale GROUP BY 1, 2)
    SELECT c.symbol, c.ts, c.close, coalesce(s.score, 0.5) AS sentiment, coalesce(w.n, 0) AS whales FROM candles_15m c LEFT JOIN s ON s.symbol = c.symbol AND s.h = date_trunc('hour', c.ts) LEFT JOIN w ON w.symbol = c.symbol AND w.h = date_trunc('hour', c.ts)""",
    "candles_15m", "sentiment_scores", "onchain_events",
)
def training_frame_join(spark, sf_dir):
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")
    scores = sentiment_scores(spark, sf_dir).groupBy("symbol", hour).agg(F.round(F.avg("sentiment_score"), 6).alias("score"))
    whales = onchain_events(spark, sf_dir).filter("is_whale").groupBy("symbol", hour).agg(F.count("*").alias("n"))
    bars = candles(spark, sf_dir, "15m").select("symbol", "ts", "close")
    out = temporal.bucket_join(temporal.bucket_join(bars, scores, ["symbol"]), whales, ["symbol"])
    return out.select("symbol", "ts", "close", F.coalesce("score", F.lit(0.5)).alias("sentiment"), F.coalesce("n", F.lit(0)).alias("whales"))


@query(
    f"""SELECT symbol, round(sum(CASE WHEN flow_direction = 'to_exchange' THEN amount_usd ELSE 0 END) - sum(CASE WHEN flow_direction = 'from_exchange' THEN amount_usd ELSE 0 END), 2) AS net_flow, CAST(sum(is_whale::INT) AS BIGINT) AS whales
    FROM onchain_events WHERE ts > {T} - INTERVAL 24 HOUR AND ts <= {T} GROUP BY 1""",
    "onchain_events",
)
def net_exchange_flow(spark, sf_dir):
    return roll.net_flow(onchain_events(spark, sf_dir), as_of())


@query(f"SELECT symbol, round((max(price) - min(price)) / nullif(min(price), 0), 6) AS move FROM ticks WHERE ts > {T} - INTERVAL 12 HOUR AND ts <= {T} GROUP BY 1", "ticks")
def range_move_12h(spark, sf_dir):
    return roll.range_move(ticks(spark, sf_dir), as_of(), 12)


@query("SELECT t.event_id, t.symbol, t.ts, c.close AS r_close, c.ts AS r_ts FROM ticks t ASOF LEFT JOIN candles_1h c ON t.symbol = c.symbol AND t.ts >= c.ts", "ticks", "candles_1h")
def asof_backward(spark, sf_dir):
    return temporal.asof_join(ticks(spark, sf_dir).select("event_id", "symbol", "ts"), candles(spark, sf_dir).select("symbol", "ts", "close"), ["symbol"]).select("event_id", "symbol", "ts", "r_close", "r_ts")


@query(
    """WITH b AS (SELECT s.id, s.symbol, s.ts, c.ts AS bt, c.close AS bc FROM tick_signals s ASOF LEFT JOIN candles_1h c ON s.symbol = c.symbol AND s.ts >= c.ts),
    f AS (SELECT b.*, c.ts AS ft, c.close AS fc FROM b ASOF LEFT JOIN candles_1h c ON b.symbol = c.symbol AND b.ts <= c.ts)
    SELECT id, symbol, ts, coalesce(CASE WHEN bt IS NOT NULL AND (ft IS NULL OR ts - bt <= ft - ts) THEN bc ELSE fc END, 0) AS price FROM f""",
    "tick_signals", "candles_1h",
)
def nearest_price(spark, sf_dir):
    from .tables import tick_signals

    out = temporal.nearest_join(tick_signals(spark, sf_dir).select("id", "symbol", "ts"), candles(spark, sf_dir).select("symbol", "ts", "close"), ["symbol"])
    return out.select("id", "symbol", "ts", F.coalesce("r_close", F.lit(0.0)).alias("price"))


@query(
    "SELECT symbol, flow_direction, count(*) AS n, count(*) FILTER (is_whale) AS whales, round(sum(amount_usd), 2) AS total FROM onchain_transactions GROUP BY 1, 2", "onchain_transactions"
)
def onchain_summary(spark, sf_dir):
    return onchain_transactions(spark, sf_dir).groupBy("symbol", "flow_direction").agg(F.count("*").alias("n"), F.count_if("is_whale").alias("whales"), F.round(F.sum("amount_usd"), 2).alias("total"))


@query(
    "SELECT tx_id, ts, amount_usd FROM onchain_transactions QUALIFY row_number() OVER (PARTITION BY tx_id ORDER BY l_partkey, l_suppkey, amount_usd) = 1", "onchain_transactions"
)
def onchain_keep_first(spark, sf_dir):
    from lodemark.operators.relational import keep_first

    return keep_first(onchain_transactions(spark, sf_dir), ["tx_id"], "l_partkey", "l_suppkey", "amount_usd").select("tx_id", "ts", "amount_usd")


@query(
    """SELECT tx_id, CASE WHEN amount_usd < 250000 AND NOT is_whale THEN 'NEUTRAL' WHEN flow_direction = 'to_exchange' THEN 'BEARISH' WHEN flow_direction = 'from_exchange' THEN 'BULLISH' ELSE 'NEUTRAL' END AS impact, count(*) AS n
    FROM onchain_transactions GROUP BY 1, 2""",
    "onchain_transactions",
)
def onchain_impact(spark, sf_dir):
    from lodemark.functions.labels import onchain_impact as impact

    label, _ = impact(F.col("amount_usd"), F.col("is_whale"), F.col("flow_direction"))
    return onchain_transactions(spark, sf_dir).groupBy("tx_id", label.alias("impact")).agg(F.count("*").alias("n"))


@query("SELECT service_name, date_trunc('hour', ts) AS ts, count(*) AS n, round(avg(latency_ms), 6) AS mean_ms, max(latency_ms) AS max_ms FROM system_metrics GROUP BY 1, 2", "system_metrics")
def telemetry_hourly(spark, sf_dir):
    return system_metrics(spark, sf_dir).groupBy("service_name", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.count("*").alias("n"), F.round(F.avg("latency_ms"), 6).alias("mean_ms"), F.max("latency_ms").alias("max_ms"))


@query(
    "SELECT event_id, service_name, ts, count(*) OVER (PARTITION BY service_name ORDER BY ts RANGE BETWEEN INTERVAL 2 HOUR PRECEDING AND CURRENT ROW) AS recent FROM system_metrics QUALIFY recent >= 4", "system_metrics"
)
def error_rate_alert(spark, sf_dir):
    rows = system_metrics(spark, sf_dir).select("event_id", "service_name", "ts")
    return rolling.trailing_count(rows, ["service_name"], 2 * 3600).filter("recent >= 4")
