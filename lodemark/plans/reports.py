"""Reports over signals, runs and trades; longer features; training records of all sources."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodemark.functions import features, text
from lodemark.functions import indicators as ind
from lodemark.operators import metrics
from lodemark.operators.rolling import change, over
from lodemark.operators.temporal import nearest_join

from .market import W, _ema_sql, f
from .registry import query, rounded
from .risk import DD
from .tables import backtest_trades, candles, coin_configs, equity_curve, news_articles, onchain_transactions, price_predictions, sentiment_scores, ticks, trading_signals

CAPITAL = 10_000.0


@query(
    """WITH c AS (SELECT * FROM trading_signals WHERE closed_at IS NOT NULL), g AS (SELECT 'coin' AS kind, symbol AS key, pnl_pct FROM c UNION ALL SELECT 'timeframe', interval, pnl_pct FROM c UNION ALL SELECT 'risk_level', coalesce(risk_level, 'UNKNOWN'), pnl_pct FROM c)
    SELECT kind, key, count(*) AS total_trades, round(avg(pnl_pct), 6) AS avg_return, round(avg(CASE WHEN pnl_pct > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS win_rate FROM g GROUP BY 1, 2""",
    "trading_signals",
)
def signal_performance(spark, sf_dir):
    """Closed signals by coin, timeframe and risk level, in one pass."""
    meta = F.from_json("metadata", "risk_level string, closed_at string, pnl_pct string")
    rows = trading_signals(spark, sf_dir).withColumn("m", meta).filter("m.closed_at IS NOT NULL").select("symbol", "interval", F.coalesce("m.risk_level", F.lit("UNKNOWN")).alias("risk"), F.col("m.pnl_pct").cast("double").alias("pnl"))
    groups = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("key")) for k, c in (("coin", "symbol"), ("timeframe", "interval"), ("risk_level", "risk")))))
    rows = rows.select(groups.alias("g"), "pnl").select("g.*", "pnl").groupBy("kind", "key")
    return rows.agg(F.count("*").alias("total_trades"), F.round(F.avg("pnl"), 6).alias("avg_return"), F.round(F.avg(F.when(F.col("pnl") > 0, 1.0).otherwise(0.0)), 6).alias("win_rate"))


@query(
    """WITH r AS (SELECT symbol, side, strftime(exit_time, '%Y-%m') AS month, max(exit_time) AS created_at, round(sum(pnl_pct), 9) AS total_return, coalesce(avg(pnl_pct) / nullif(round(stddev_samp(pnl_pct), 12), 0) * sqrt(252), 0) AS sharpe, abs(least(min(pnl_pct), 0)) AS drawdown FROM backtest_trades GROUP BY 1, 2, 3)
    SELECT count(*) AS run_count, round(avg(total_return), 6) AS avg_return, max(total_return) AS best_return, round(avg(sharpe), 6) AS avg_sharpe, round(avg(drawdown), 6) AS avg_drawdown FROM r WHERE created_at >= TIMESTAMP '1996-01-01'""",
    "backtest_trades",
)
def recent_runs(spark, sf_dir):
    """Runs (here: of a symbol, side and month) that ended since a date."""
    sharpe = F.coalesce(F.try_divide(F.avg("pnl_pct"), F.nullif(F.round(F.stddev_samp("pnl_pct"), 12), F.lit(0.0))) * F.sqrt(F.lit(252.0)), F.lit(0.0))
    runs = backtest_trades(spark, sf_dir).groupBy("symbol", "side", F.date_format("exit_time", "yyyy-MM").alias("month"))
    runs = runs.agg(F.max("exit_time").alias("created_at"), F.round(F.sum("pnl_pct"), 9).alias("total_return"), sharpe.alias("sharpe"), F.abs(F.least(F.min("pnl_pct"), F.lit(0.0))).alias("drawdown")).filter(F.col("created_at") >= F.lit("1996-01-01").cast("timestamp_ntz"))
    return runs.agg(F.count("*").alias("run_count"), F.round(F.avg("total_return"), 6).alias("avg_return"), F.max("total_return").alias("best_return"), F.round(F.avg("sharpe"), 6).alias("avg_sharpe"), F.round(F.avg("drawdown"), 6).alias("avg_drawdown"))


@query(
    f"""WITH m AS (SELECT side, strftime(exit_time, '%Y-%m') AS month, round(100 * sum(pnl) / {CAPITAL}, 6) AS r FROM backtest_trades GROUP BY 1, 2)
    SELECT side, arg_max(month, {{r: r, m: month}}) AS best_month, max(r) AS best_return, arg_min(month, {{r: r, m: month}}) AS worst_month, min(r) AS worst_return, round(coalesce(stddev_samp(r), 0), 4) AS consistency FROM m GROUP BY 1""",
    "backtest_trades",
)
def month_report(spark, sf_dir):
    """Best and worst month, and the spread of monthly returns on the capital, in percent."""
    return metrics.month_report(backtest_trades(spark, sf_dir), ["side"], CAPITAL)


@query(
    """SELECT side, round(coalesce(avg(pnl) FILTER (pnl > 0), 0), 4) AS avg_win, round(coalesce(avg(pnl) FILTER (pnl <= 0), 0), 4) AS avg_loss, coalesce(max(pnl) FILTER (pnl > 0), 0) AS largest_win, coalesce(min(pnl) FILTER (pnl <= 0), 0) AS largest_loss,
    round(count(*) / greatest(count(DISTINCT strftime(exit_time, '%Y-%m')), 1)::DOUBLE, 6) AS trades_per_month FROM backtest_trades GROUP BY 1""",
    "backtest_trades",
)
def trade_report(spark, sf_dir):
    return metrics.trade_report(backtest_trades(spark, sf_dir), ["side"])


@query(
    f"""WITH {DD}, e AS (SELECT *, lag(dd) OVER (ORDER BY ts) AS p FROM q), s AS (SELECT *, max(CASE WHEN dd > 0 AND coalesce(p, 0) = 0 THEN ts END) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS started FROM e),
    r AS (SELECT date_diff('second', started, ts) // 86400 AS days FROM s WHERE dd = 0 AND p > 0), a AS (SELECT round(avg(dd) FILTER (dd > 0), 6) AS mean_drawdown FROM q)
    SELECT mean_drawdown, (SELECT count(*) FROM r) AS recoveries, (SELECT round(coalesce(avg(days), 0), 6) FROM r) AS mean_days, (SELECT coalesce(median(days), 0)::DOUBLE FROM r) AS median_days FROM a""",
    "equity_curve",
)
def recoveries(spark, sf_dir):
    """Whole days from the start of each drawdown until a new peak."""
    return metrics.recoveries(equity_curve(spark, sf_dir).withColumn("run", F.lit(1)), ["run"]).drop("run")


@query(
    """SELECT symbol, min(entry_time) AS start_date, max(exit_time) AS end_date, count(*) FILTER (pnl > 0) AS wins, count(*) FILTER (pnl <= 0) AS losses, round(avg(pnl_pct), 6) AS mean_return FROM backtest_trades GROUP BY 1""",
    "backtest_trades",
)
def win_loss_report(spark, sf_dir):
    """The report of a run as one nested value, here read back into columns."""
    report = metrics.win_loss_report(backtest_trades(spark, sf_dir), ["symbol"])
    r = "report.summary"
    return report.select("symbol", F.col(f"{r}.period.start").alias("start_date"), F.col(f"{r}.period.end").alias("end_date"), "report.win_loss_distribution.*", F.col(f"{r}.mean_return").alias("mean_return"))


@query(
    """WITH p AS (SELECT ts, equity, max(equity) OVER (ORDER BY ts) AS peak, equity / nullif(lag(equity) OVER (ORDER BY ts), 0) - 1 AS r FROM equity_curve)
    SELECT round(coalesce(min((equity - peak) / nullif(peak, 0)), 0), 6) AS max_drawdown, round(coalesce(avg(r) / nullif(stddev_samp(r), 0) * sqrt(35040), 0), 4) AS sharpe FROM p""",
    "equity_curve",
)
def flat_run_metrics(spark, sf_dir):
    """Drawdown as a negative share, and Sharpe ratio of the curve's changes at 35,040 periods a year."""
    return metrics.flat_metrics(equity_curve(spark, sf_dir).withColumn("run", F.lit(1)), ["run"]).drop("run")


@query(
    """WITH s AS (SELECT model_name, round(avg(CASE WHEN status = 'O' THEN 1.0::DOUBLE ELSE 0 END), 9) AS score FROM price_predictions WHERE actual_price IS NOT NULL GROUP BY 1), p AS (SELECT score AS prod FROM s WHERE model_name = '1-URGENT')
    SELECT model_name, score, prod, round(CASE WHEN prod > 0 THEN (score - prod) / prod ELSE 1.0 END, 6) AS improvement, CASE WHEN (CASE WHEN prod > 0 THEN (score - prod) / prod ELSE 1.0 END) > 0.05 THEN 'replace' ELSE 'keep_production' END AS recommendation FROM s, p WHERE model_name <> '1-URGENT'""",
    "price_predictions",
)
def model_promotion(spark, sf_dir):
    """Each model beside the one in production: replaced by a score that is more than 5 % higher."""
    hit = F.when(F.col("status") == "O", 1.0).otherwise(0.0)
    scores = price_predictions(spark, sf_dir).filter("actual_price IS NOT NULL").groupBy("model_name").agg(F.round(F.avg(hit), 9).alias("score"))
    prod = scores.filter("model_name = '1-URGENT'").select(F.col("score").alias("prod"))
    gain = F.when(F.col("prod") > 0, (F.col("score") - F.col("prod")) / F.col("prod")).otherwise(1.0)
    rows = scores.filter("model_name <> '1-URGENT'").join(F.broadcast(prod))  # one row
    return rows.withColumns({"improvement": F.round(gain, 6), "recommendation": F.when(gain > 0.05, "replace").otherwise("keep_production")})


@query(
    f"""WITH r AS (SELECT *, CASE WHEN close > 0 AND lag(close) OVER ({W}) > 0 THEN ln(close / lag(close) OVER ({W})) ELSE 0 END AS r FROM candles_15m)
    SELECT symbol, ts, round({f(672, 'stddev_samp', 'r')}, 6) AS volatility_672, round(close / nullif(lag(close, 672) OVER ({W}), 0) - 1, 6) AS roc_672, round((close - {f(672, 'avg', 'close')}) / nullif(round({f(672, 'stddev_samp', 'close')}, 9), 0), 6) AS zscore_672 FROM r""",
    "candles_15m",
)
def price_features_week(spark, sf_dir):
    """The seven-day horizon: 672 bars of 15 minutes."""
    cols = ["volatility_672", "roc_672", "zscore_672"]
    return rounded(ind.with_price_features(candles(spark, sf_dir, "15m"), (672,)).select("symbol", "ts", *cols), *cols)


@query(
    _ema_sql(
        f""", h AS (SELECT symbol, ts, round(e12 - e26 - sig, 9) AS hist FROM e), d AS (SELECT symbol, ts, close, close - lag(close) OVER ({W}) AS d FROM candles_4h), gl AS (SELECT *, CASE WHEN d > 0 THEN d ELSE 0 END AS g, CASE WHEN d < 0 THEN -d ELSE 0 END AS l FROM d),
    t AS (SELECT symbol, ts, 100 - 100 / (1 + {f(14, 'avg', 'g')} / nullif({f(14, 'avg', 'l')}, 0)) - 100 * (close / nullif(lag(close, 14) OVER ({W}), 0) - 1) AS drift, 4 * {f(20, 'stddev_samp', 'close')} / nullif({f(20, 'avg', 'close')}, 0) AS width FROM gl)
    SELECT symbol, ts, round(hist - lag(hist) OVER ({W}), 6) AS macd_hist_slope, round(drift, 6) AS rsi_divergence, round(width, 6) AS bb_width FROM h JOIN t USING (symbol, ts)"""
    ),
    "candles_4h",
)
def technical_features(spark, sf_dir):
    """Slope of the MACD histogram, drift of the RSI against the price, width of the bands."""
    w = over("symbol")
    bars = ind.with_bollinger(ind.with_rsi(ind.with_macd(candles(spark, sf_dir, "4h")), 14, "rsi"))
    made = {
        "macd_hist_slope": F.round("macd_hist", 9) - F.lag(F.round("macd_hist", 9)).over(w),
        "rsi_divergence": F.col("rsi") - 100 * change(w, 14, F.col("close")),
        "bb_width": F.try_divide(F.col("bb_upper") - F.col("bb_lower"), F.nullif("bb_middle", F.lit(0.0))),
    }
    return rounded(bars.select("symbol", "ts", *(c.alias(n) for n, c in made.items())), *made)


@query(
    f"""WITH x AS (SELECT symbol, ts, close, coalesce(close / nullif(lag(close, 1) OVER ({W}), 0) - 1, 0) AS return_1, lead(close) OVER ({W}) AS target FROM candles_1h), v AS (SELECT *, {f(20, 'stddev_samp', 'return_1')} AS vol FROM x),
    s AS (SELECT symbol, ts, round(avg(sentiment_score), 6) AS score FROM sentiment_scores GROUP BY 1, 2)
    SELECT v.symbol, v.ts, v.target, coalesce(s.score, 0.5) AS sentiment_score FROM (SELECT * FROM v WHERE vol IS NOT NULL AND target IS NOT NULL) v ASOF LEFT JOIN s ON v.symbol = s.symbol AND v.ts >= s.ts""",
    "candles_1h", "sentiment_scores",
)
def flat_frame_sentiment(spark, sf_dir):
    """The flat feature frame with the last sentiment before each bar; 0.5 where there is none."""
    scores = sentiment_scores(spark, sf_dir).groupBy("symbol", "ts").agg(F.round(F.avg("sentiment_score"), 6).alias("sentiment_score"))
    return features.with_sentiment(features.flat_frame(candles(spark, sf_dir)), scores).select("symbol", "ts", "target", "sentiment_score")


@query(
    """WITH d AS (SELECT symbol, date_trunc('day', ts)::TIMESTAMP AS day, round(sum(size) FILTER (user_id % 2 = 0) / nullif(sum(size), 0)::DOUBLE, 6) AS ratio FROM ticks GROUP BY 1, 2)
    SELECT symbol, day, ratio, CASE WHEN ratio > 0.55 THEN 'buyers' WHEN ratio < 0.45 THEN 'sellers' ELSE 'even' END AS bucket FROM d""",
    "ticks",
)
def taker_ratio(spark, sf_dir):
    """Share of the volume that takers bought (here: even users), by day, and its bucket."""
    rows = ticks(spark, sf_dir).groupBy("symbol", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"))
    rows = rows.agg(F.round(F.try_divide(F.sum(F.when(F.col("user_id") % 2 == 0, F.col("size"))), F.nullif(F.sum("size"), F.lit(0))), 6).alias("ratio"))
    return rows.withColumn("bucket", F.when(F.col("ratio") > 0.55, "buyers").when(F.col("ratio") < 0.45, "sellers").otherwise("even"))


@query("SELECT id, symbol, signal FROM trading_signals WHERE is_active AND (closed_at IS NULL OR closed_at >= TIMESTAMP '1996-06-01 00:30:00' - INTERVAL 1 HOUR)", "trading_signals")
def active_or_recent(spark, sf_dir):
    """Active signals that haven't been executed, or within the last hour."""
    done = F.get_json_object("metadata", "$.closed_at").cast("timestamp_ntz")
    as_of = F.lit("1996-06-01 00:30:00").cast("timestamp_ntz")
    return trading_signals(spark, sf_dir).filter(F.col("is_active") & (done.isNull() | (done >= as_of - F.expr("INTERVAL 1 HOUR")))).select("id", "symbol", "signal")


@query(
    """SELECT id, list_filter([CASE WHEN id % 30 / 10.0 > 1.8 THEN 'volatility' END, CASE WHEN (id % 41 - 20) / 100.0 < -0.08 THEN 'falling' END, CASE WHEN id % 11 = 0 THEN 'exchange_news' END, CASE WHEN id % 13 = 0 THEN 'regulation' END, CASE WHEN risk_level = '1-URGENT' THEN 'high_risk' END], lambda x: x IS NOT NULL) AS warnings FROM trading_signals""",
    "trading_signals",
)
def risk_warnings(spark, sf_dir):
    """Names of the warnings that hold for each signal. Volatility above 1.8, a fall of 8 % in an hour."""
    from lodemark.operators.signals import named

    i = F.col("id")
    held = {"volatility": i % 30 / F.lit(10.0) > 1.8, "falling": (i % 41 - 20) / F.lit(100.0) < -0.08, "exchange_news": i % 11 == 0, "regulation": i % 13 == 0, "high_risk": F.get_json_object("metadata", "$.risk_level") == "1-URGENT"}
    return trading_signals(spark, sf_dir).select("id", named(held).alias("warnings"))


@query(
    """WITH b AS (SELECT t.event_id, t.symbol, t.ts, t.size * 2000 AS amount, c.ts AS b_ts, c.close AS b FROM ticks t ASOF LEFT JOIN candles_1d c ON t.symbol = c.symbol AND t.ts >= c.ts), n AS (SELECT b.*, c.ts AS f_ts, c.close AS f FROM b ASOF LEFT JOIN candles_1d c ON b.symbol = c.symbol AND b.ts < c.ts),
    p AS (SELECT event_id, round(amount * coalesce(d.close, CASE WHEN b_ts IS NOT NULL AND (f_ts IS NULL OR n.ts - b_ts <= f_ts - n.ts) THEN b ELSE f END, 0), 2) AS amount_usd
      FROM n LEFT JOIN candles_1d d ON d.symbol = n.symbol AND d.ts = date_trunc('day', n.ts)) SELECT event_id, amount_usd, amount_usd >= 1000000 AS is_whale FROM p""",
    "ticks", "candles_1d",
)
def whale_transfers(spark, sf_dir):
    """Transfers in dollars at the close of their day, else at the nearest day's, 0 without any; whales move a million or more."""
    days = candles(spark, sf_dir, "1d").select("symbol", "ts", "close")
    rows = ticks(spark, sf_dir).select("event_id", "symbol", "ts", (F.col("size") * 2000).alias("amount"))
    rows = nearest_join(rows, days, ["symbol"], bin_seconds=30 * 86400).withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    rows = rows.join(days.select("symbol", F.col("ts").alias("day"), F.col("close").alias("own")), ["symbol", "day"], "left")
    usd = F.round(F.col("amount") * F.coalesce("own", "r_close", F.lit(0.0)), 2)
    return rows.select("event_id", usd.alias("amount_usd"), (usd >= 1_000_000).alias("is_whale"))


@query("SELECT c.symbol, round(coalesce(avg(s.sentiment_score), 0.5), 6) AS mean FROM coin_configs c LEFT JOIN sentiment_scores s USING (symbol) GROUP BY 1", "coin_configs", "sentiment_scores")
def heatmap(spark, sf_dir):
    means = sentiment_scores(spark, sf_dir).groupBy("symbol").agg(F.avg("sentiment_score").alias("m"))
    return coin_configs(spark, sf_dir).join(means, "symbol", "left").select("symbol", F.round(F.coalesce("m", F.lit(0.5)), 6).alias("mean"))


@query("SELECT o_orderkey AS id, o_orderdate AS iso, o_orderdate AS plain, o_orderdate AS millis, strftime(o_orderdate, '%Y-%m') AS month, true AS bad FROM orders")
def parsed_times(spark, sf_dir):
    """One time as ISO 8601 with Z, without a zone (then UTC), and in milliseconds, read back; and text that is no time."""
    from .tables import load

    rows, at = load(spark, sf_dir, "orders"), F.col("o_orderdate")
    iso, plain = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format(at, "yyyy-MM-dd HH:mm:ss")
    millis = F.unix_millis(at.cast("timestamp")).cast("string")
    back = {"iso": text.parsed_time(iso), "plain": text.parsed_time(plain), "millis": text.parsed_time(millis)}
    return rows.select(F.col("o_orderkey").alias("id"), *(c.cast("timestamp_ntz").alias(n) for n, c in back.items()), F.date_format(back["iso"], "yyyy-MM").alias("month"), text.parsed_time(F.lit("soon")).isNull().alias("bad"))


@query("SELECT event_id, round_even(size / 8.0, 2)::DOUBLE AS even, round(size / 8.0, 2)::DOUBLE AS half_up FROM ticks", "ticks")
def half_even(spark, sf_dir):
    """Half-way values to the even neighbour, beside rounding them up."""
    v = (F.col("size") / F.lit(8.0)).cast("decimal(18,6)")
    return ticks(spark, sf_dir).select("event_id", F.bround(v, 2).cast("double").alias("even"), F.round(v, 2).cast("double").alias("half_up"))


def _line(prompt: str, answer: str) -> str:
    return f"""'{{"text":"' || replace(replace(replace('<s>[INST] ' || {prompt} || ' [/INST] ' || {answer} || ' </s>', chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n') || '"}}'"""


@query(
    f"""WITH n AS (SELECT 'news' AS source, id::VARCHAR AS id, {_line("'News of ' || primary_symbol || ' by ' || coalesce(source_name, 'unknown')", "CASE WHEN contains(lower(content), 'that') THEN 'BULLISH' ELSE 'NEUTRAL' END")} AS line FROM news_articles WHERE length(content) >= 120),
    s AS (SELECT 'social', id::VARCHAR, {_line("'Post on ' || symbol || ' from ' || source_type", "sentiment_label")} FROM sentiment_scores WHERE source_type = 'reddit'),
    b AS (SELECT symbol, ts, close, lead(close) OVER ({W}) AS next FROM candles_1h), p AS (SELECT 'price', symbol || ' ' || strftime(ts, '%Y-%m-%d %H:%M:%S'), {_line("'Next candle of ' || symbol || ' after ' || strftime(ts, '%Y-%m-%d %H:%M:%S')", "CASE WHEN 100 * (next - close) / close > 0.25 THEN 'UP' WHEN 100 * (next - close) / close < -0.25 THEN 'DOWN' ELSE 'SIDEWAYS' END")} FROM b WHERE next IS NOT NULL AND close > 0),
    o AS (SELECT 'onchain', tx_id, {_line("'Transfer of ' || symbol || ' ' || flow_direction", "CASE WHEN amount_usd < 250000 AND NOT is_whale THEN 'NEUTRAL' WHEN flow_direction = 'to_exchange' THEN 'BEARISH' WHEN flow_direction = 'from_exchange' THEN 'BULLISH' ELSE 'NEUTRAL' END")} FROM onchain_transactions)
    SELECT * FROM n UNION ALL SELECT * FROM s UNION ALL SELECT * FROM p UNION ALL SELECT * FROM o""",
    "news_articles", "sentiment_scores", "candles_1h", "onchain_transactions",
)
def training_records(spark, sf_dir):
    """Records for fine-tuning from news, posts, candles and transfers: source, id and line, each kind with its own prompt and answer."""
    from lodemark.functions.labels import onchain_impact

    news = news_articles(spark, sf_dir).filter(F.length("content") >= 120)
    news = news.select(F.lit("news").alias("source"), F.col("id").cast("string").alias("id"), text.record(F.concat(F.lit("News of "), "primary_symbol", F.lit(" by "), F.coalesce("source_name", F.lit("unknown"))), F.when(F.lower("content").contains("that"), "BULLISH").otherwise("NEUTRAL")).alias("line"))
    posts = sentiment_scores(spark, sf_dir).filter("source_type = 'reddit'")
    posts = posts.select(F.lit("social").alias("source"), F.col("id").cast("string").alias("id"), text.record(F.concat(F.lit("Post on "), "symbol", F.lit(" from "), "source_type"), F.col("sentiment_label")).alias("line"))
    bars = candles(spark, sf_dir).select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "close", F.lead("close").over(over("symbol")).alias("next")).filter("next IS NOT NULL AND close > 0")
    move = 100 * (F.col("next") - F.col("close")) / F.col("close")
    bars = bars.select(F.lit("price").alias("source"), F.concat_ws(" ", "symbol", "at").alias("id"), text.record(F.concat(F.lit("Next candle of "), "symbol", F.lit(" after "), "at"), F.when(move > 0.25, "UP").when(move < -0.25, "DOWN").otherwise("SIDEWAYS")).alias("line"))
    impact, _ = onchain_impact(F.col("amount_usd"), F.col("is_whale"), F.col("flow_direction"))
    moved = onchain_transactions(spark, sf_dir).select(F.lit("onchain").alias("source"), F.col("tx_id").alias("id"), text.record(F.concat(F.lit("Transfer of "), "symbol", F.lit(" "), "flow_direction"), impact).alias("line"))
    return news.unionByName(posts).unionByName(bars).unionByName(moved)


@query(
    """WITH r AS (SELECT primary_symbol AS symbol, id, row_number() OVER (PARTITION BY primary_symbol ORDER BY ts DESC, id DESC) AS n FROM news_articles), h AS (SELECT symbol, 'Recent news: ' || string_agg('article ' || id, ', ' ORDER BY n) AS news FROM r WHERE n <= 3 GROUP BY 1),
    p AS (SELECT symbol, 'Live market: ' || symbol || ' at ' || CAST(round(arg_max(close, ts), 2) AS DECIMAL(18, 2)) AS price FROM candles_1h GROUP BY 1)
    SELECT c.symbol, coalesce(nullif(concat_ws(chr(10), news, price), ''), 'No live context.') AS context FROM coin_configs c LEFT JOIN h USING (symbol) LEFT JOIN p USING (symbol)""",
    "news_articles", "candles_1h", "coin_configs",
)
def prompt_context(spark, sf_dir):
    """What a prompt on each coin gets as context: its three latest articles and its price."""
    w = Window.partitionBy("primary_symbol").orderBy(F.desc("ts"), F.desc("id"))
    top = news_articles(spark, sf_dir).select("primary_symbol", "ts", "id").withColumn("n", F.row_number().over(w)).filter("n <= 3")  # a rank limit that Spark applies before the shuffle as well
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: F.concat(F.lit("article "), x["id"].cast("string"))), ", ")
    news = top.groupBy(F.col("primary_symbol").alias("symbol")).agg(F.concat(F.lit("Recent news: "), said).alias("news"))
    price = candles(spark, sf_dir).groupBy("symbol").agg(F.concat(F.lit("Live market: "), F.first("symbol"), F.lit(" at "), F.round(F.max_by("close", "ts"), 2).cast("decimal(18,2)").cast("string")).alias("price"))
    rows = coin_configs(spark, sf_dir).join(news, "symbol", "left").join(price, "symbol", "left")
    return rows.select("symbol", F.coalesce(F.nullif(F.concat_ws("\n", "news", "price"), F.lit("")), F.lit("No live context.")).alias("context"))


@query(
    """WITH b AS (SELECT symbol, ts, close FROM candles_1d), m AS (SELECT symbol, min(close) AS low, max(close) AS high FROM b GROUP BY 1)
    SELECT symbol, string_agg(substring('▁▂▃▄▅▆▇', CAST(coalesce(floor((close - low) * 6 / nullif(high - low, 0)), 0) AS INT) + 1, 1), '' ORDER BY ts) AS line FROM b JOIN m USING (symbol) GROUP BY 1""",
    "candles_1d",
)
def sparklines(spark, sf_dir):
    closes = F.transform(F.array_sort(F.collect_list(F.struct("ts", "close"))), lambda x: x["close"])
    return candles(spark, sf_dir, "1d").groupBy("symbol").agg(closes.alias("c")).select("symbol", text.sparkline(F.col("c")).alias("line"))


