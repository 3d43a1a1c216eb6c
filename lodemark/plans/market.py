"""Candles, indicators and features."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodemark.functions import indicators as ind
from lodemark.operators import relational as rel
from lodemark.operators.rolling import change, ema, full, over
from lodemark.operators.rollups import reroll

from .registry import query, rounded
from .tables import candles, load, ticks

W = "PARTITION BY symbol ORDER BY ts"


def f(n: int, agg: str, x: str) -> str:
    """SQL of a full window of n rows."""
    rows = f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {rows} = {n} THEN {agg}({x}) {rows} END"


def _candles(name: str, interval: str) -> None:
    def run(spark, sf_dir):
        return candles(spark, sf_dir, interval)

    run.__name__ = name
    query(f"SELECT * FROM candles_{interval}", f"candles_{interval}")(run)


for _name, _interval in (("ohlcv_hourly", "1h"), ("ohlcv_15m", "15m"), ("ohlcv_4h", "4h"), ("ohlcv_daily", "1d")):
    _candles(_name, _interval)


@query("SELECT * FROM candles_1h", "candles_1h")
def ohlcv_rollup_1h_from_15m(spark, sf_dir):
    return reroll(candles(spark, sf_dir, "15m"), "1 hour")


@query("SELECT symbol, ts, close FROM candles_1h QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1", "candles_1h")
def latest_candle_per_symbol(spark, sf_dir):
    return rel.latest(candles(spark, sf_dir).select("symbol", "ts", "close"), ["symbol"], "ts")


@query(
    """WITH latest AS (SELECT symbol, max(ts) AS ts, arg_max(close, ts) AS close FROM candles_1h GROUP BY 1),
    old AS (SELECT symbol, arg_max(close, ts) AS close FROM candles_1h WHERE ts <= TIMESTAMP '2024-01-29 23:00:00' GROUP BY 1)
    SELECT l.symbol, l.ts, l.close, o.close AS close_before, round(100 * (l.close - o.close) / nullif(o.close, 0), 6) AS change_pct FROM latest l LEFT JOIN old o USING (symbol)""",
    "candles_1h",
)
def asof_change_24h(spark, sf_dir):
    bars = candles(spark, sf_dir)
    now = bars.groupBy("symbol").agg(F.max("ts").alias("ts"), F.max_by("close", "ts").alias("close"))
    old = bars.filter(F.col("ts") <= F.lit("2024-01-29 23:00:00").cast("timestamp_ntz")).groupBy("symbol").agg(F.max_by("close", "ts").alias("close_before"))
    return now.join(old, "symbol", "left").withColumn("change_pct", F.round(F.try_divide(100 * (F.col("close") - F.col("close_before")), F.nullif("close_before", F.lit(0.0))), 6))


@query("SELECT * FROM candles_1h WHERE symbol = 'click' AND ts >= TIMESTAMP '2024-01-10' ORDER BY ts DESC LIMIT 50", "candles_1h")
def price_history_topn(spark, sf_dir):
    bars = candles(spark, sf_dir)
    return bars.filter((F.col("symbol") == "click") & (F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz"))).orderBy(F.desc("ts")).limit(50)


@query("SELECT symbol, ts, close FROM candles_15m QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 100", "candles_15m")
def last_n_bars(spark, sf_dir):
    return rel.last_n(candles(spark, sf_dir, "15m").select("symbol", "ts", "close"), ["symbol"], "ts", 100)


@query(f"SELECT symbol, ts, close, lead(close) OVER ({W}) AS next_close FROM candles_1h", "candles_1h")
def lead_next_close(spark, sf_dir):
    return candles(spark, sf_dir).select("symbol", "ts", "close", F.lead("close").over(over("symbol")).alias("next_close"))


@query(
    f"SELECT symbol, ts, round(close / nullif(lag(close, 1) OVER ({W}), 0) - 1, 6) AS return_1, round(close / nullif(lag(close, 5) OVER ({W}), 0) - 1, 6) AS return_5, round(close - lag(close) OVER ({W}), 6) AS diff_1 FROM candles_1h",
    "candles_1h",
)
def returns_lag(spark, sf_dir):
    w, close = over("symbol"), F.col("close")
    out = candles(spark, sf_dir).select("symbol", "ts", change(w, 1, close).alias("return_1"), change(w, 5, close).alias("return_5"), (close - F.lag("close").over(w)).alias("diff_1"))
    return rounded(out, "return_1", "return_5", "diff_1")


@query(f"SELECT symbol, ts, round({f(7, 'avg', 'close')}, 6) AS sma_7, round({f(25, 'avg', 'close')}, 6) AS sma_25, round({f(99, 'avg', 'close')}, 6) AS sma_99 FROM candles_1h", "candles_1h")
def sma_7_25_99(spark, sf_dir):
    w = over("symbol")
    return candles(spark, sf_dir).select("symbol", "ts", *(F.round(full(w, n, F.avg, F.col("close")), 6).alias(f"sma_{n}") for n in (7, 25, 99)))


@query(
    f"SELECT symbol, ts, round({f(20, 'avg', 'close')}, 6) AS bb_middle, round({f(20, 'avg', 'close')} + 2 * {f(20, 'stddev_samp', 'close')}, 6) AS bb_upper, round({f(20, 'avg', 'close')} - 2 * {f(20, 'stddev_samp', 'close')}, 6) AS bb_lower FROM candles_1h",
    "candles_1h",
)
def bollinger_20(spark, sf_dir):
    return rounded(ind.with_bollinger(candles(spark, sf_dir)).select("symbol", "ts", "bb_middle", "bb_upper", "bb_lower"), "bb_middle", "bb_upper", "bb_lower")


@query(
    f"SELECT symbol, ts, round(coalesce({f(20, 'avg', 'close')}, close), 6) AS bb_middle, round(coalesce({f(20, 'avg', 'close')}, close) + 2 * coalesce({f(20, 'stddev_samp', 'close')}, 0), 6) AS bb_upper FROM candles_1h",
    "candles_1h",
)
def bollinger_flat(spark, sf_dir):
    return rounded(ind.with_bollinger_flat(candles(spark, sf_dir)).select("symbol", "ts", "bb_middle", "bb_upper"), "bb_middle", "bb_upper")


def _rsi_sql(n: int, default: str = "") -> str:
    value = f"100 - 100 / (1 + {f(n, 'avg', 'g')} / nullif({f(n, 'avg', 'l')}, 0))"
    return f"""WITH d AS (SELECT symbol, ts, close - lag(close) OVER ({W}) AS d FROM candles_1h),
    gl AS (SELECT symbol, ts, CASE WHEN d > 0 THEN d ELSE 0 END AS g, CASE WHEN d < 0 THEN -d ELSE 0 END AS l FROM d)
    SELECT symbol, ts, round({f'coalesce({value}, {default})' if default else value}, 6) AS rsi FROM gl"""


@query(_rsi_sql(14), "candles_1h")
def rsi_14(spark, sf_dir):
    return rounded(ind.with_rsi(candles(spark, sf_dir), 14, "rsi").select("symbol", "ts", "rsi"), "rsi")


@query(_rsi_sql(21), "candles_1h")
def rsi_21(spark, sf_dir):
    return rounded(ind.with_rsi(candles(spark, sf_dir), 21, "rsi").select("symbol", "ts", "rsi"), "rsi")


@query(_rsi_sql(14, "50"), "candles_1h")
def rsi_flat(spark, sf_dir):
    return rounded(ind.with_rsi(candles(spark, sf_dir), 14, "rsi", 50.0).select("symbol", "ts", "rsi"), "rsi")


def _ema_sql(select: str, tail: str = "") -> str:
    return f"""WITH RECURSIVE r AS (SELECT symbol, ts, close, row_number() OVER ({W}) AS n FROM candles_4h),
    e AS (SELECT symbol, ts, n, close AS e12, close AS e26, close AS e50, 0.0::DOUBLE AS sig FROM r WHERE n = 1
      UNION ALL SELECT r.symbol, r.ts, r.n, e.e12 + 2.0 / 13 * (r.close - e.e12), e.e26 + 2.0 / 27 * (r.close - e.e26), e.e50 + 2.0 / 51 * (r.close - e.e50),
        e.sig + 0.2 * ((e.e12 + 2.0 / 13 * (r.close - e.e12)) - (e.e26 + 2.0 / 27 * (r.close - e.e26)) - e.sig)
      FROM e JOIN r ON r.symbol = e.symbol AND r.n = e.n + 1)
    {select}"""


@query(_ema_sql("SELECT symbol, ts, round(e12, 6) AS ema_12, round(e26, 6) AS ema_26, round(e50, 6) AS ema_50 FROM e"), "candles_4h")
def ema_12_26(spark, sf_dir):
    out = ema(candles(spark, sf_dir, "4h"), {f"ema_{n}": ("close", n) for n in (12, 26, 50)}, ["symbol"])
    return rounded(out.select("symbol", "ts", "ema_12", "ema_26", "ema_50"), "ema_12", "ema_26", "ema_50")


@query(_ema_sql("SELECT symbol, ts, round(e12 - e26, 6) AS macd, round(sig, 6) AS macd_signal, round(e12 - e26 - sig, 6) AS macd_hist FROM e"), "candles_4h")
def macd(spark, sf_dir):
    return rounded(ind.with_macd(candles(spark, sf_dir, "4h")).select("symbol", "ts", "macd", "macd_signal", "macd_hist"), "macd", "macd_signal", "macd_hist")


@query(f"SELECT symbol, ts, round({f(14, 'avg', '(high - low)')}, 6) AS atr_14 FROM candles_1h", "candles_1h")
def atr_14(spark, sf_dir):
    return rounded(ind.with_atr(candles(spark, sf_dir)).select("symbol", "ts", "atr_14"), "atr_14")


@query(
    f"""WITH d AS (SELECT *, CASE WHEN close > lag(close) OVER ({W}) THEN 1 ELSE -1 END AS up FROM candles_1h)
    SELECT symbol, ts, CAST(sum(volume * up) OVER ({W} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS obv FROM d""",
    "candles_1h",
)
def obv(spark, sf_dir):
    return ind.with_obv(candles(spark, sf_dir)).select("symbol", "ts", "obv")


@query(
    f"""SELECT symbol, ts, CASE WHEN volume <> 0 THEN round(sum((high + low + close) / 3 * volume) OVER ({W} ROWS UNBOUNDED PRECEDING) / sum(nullif(volume, 0)) OVER ({W} ROWS UNBOUNDED PRECEDING), 6) END AS vwap FROM candles_1h""",
    "candles_1h",
)
def vwap_cumulative(spark, sf_dir):
    return rounded(ind.with_vwap(candles(spark, sf_dir)).select("symbol", "ts", "vwap"), "vwap")


@query(
    f"SELECT symbol, ts, round(coalesce(sum(close * volume) OVER ({W} ROWS UNBOUNDED PRECEDING) / nullif(sum(volume) OVER ({W} ROWS UNBOUNDED PRECEDING), 0), close), 6) AS vwap FROM candles_1h",
    "candles_1h",
)
def vwap_close(spark, sf_dir):
    return rounded(ind.with_vwap(candles(spark, sf_dir), flat=True).select("symbol", "ts", "vwap"), "vwap")


@query(
    f"""WITH k AS (SELECT symbol, ts, 100 * (close - {f(14, 'min', 'low')}) / nullif({f(14, 'max', 'high')} - {f(14, 'min', 'low')}, 0) AS k FROM candles_1h)
    SELECT symbol, ts, round(k, 6) AS stoch_k, round({f(3, 'avg', 'k')}, 6) AS stoch_d FROM k""",
    "candles_1h",
)
def stochastic(spark, sf_dir):
    return rounded(ind.with_stochastic(candles(spark, sf_dir)).select("symbol", "ts", "stoch_k", "stoch_d"), "stoch_k", "stoch_d")


@query(
    f"""WITH tp AS (SELECT *, (high + low + close) / 3 AS tp FROM candles_1h), d AS (SELECT *, tp - lag(tp) OVER ({W}) AS d FROM tp),
    fl AS (SELECT symbol, ts, CASE WHEN d > 0 THEN tp * volume ELSE 0 END AS up, CASE WHEN d < 0 THEN tp * volume ELSE 0 END AS down FROM d)
    SELECT symbol, ts, round(100 - 100 / (1 + {f(14, 'sum', 'up')} / nullif({f(14, 'sum', 'down')}, 0)), 6) AS mfi_14 FROM fl""",
    "candles_1h",
)
def mfi_14(spark, sf_dir):
    return rounded(ind.with_mfi(candles(spark, sf_dir)).select("symbol", "ts", "mfi_14"), "mfi_14")


def _z(n: int) -> str:
    return f"round((close - {f(n, 'avg', 'close')}) / nullif(round({f(n, 'stddev_samp', 'close')}, 9), 0), 6) AS zscore_{n}"


@query(f"SELECT symbol, ts, {_z(4)}, {_z(16)}, {_z(96)} FROM candles_1h", "candles_1h")
def zscore_windows(spark, sf_dir):
    cols = ["zscore_4", "zscore_16", "zscore_96"]
    return rounded(ind.with_price_features(candles(spark, sf_dir)).select("symbol", "ts", *cols), *cols)


@query(
    f"""WITH r AS (SELECT *, CASE WHEN close > 0 AND lag(close) OVER ({W}) > 0 THEN ln(close / lag(close) OVER ({W})) ELSE 0 END AS r FROM candles_1h)
    SELECT symbol, ts, round(r, 6) AS log_return, round((high - low) / nullif(close, 0), 6) AS hl_range, round((close - open) / nullif(open, 0), 6) AS co_spread,
      {", ".join(f"round({f(n, 'stddev_samp', 'r')}, 6) AS volatility_{n}, round(close / nullif(lag(close, {n}) OVER ({W}), 0) - 1, 6) AS roc_{n}" for n in (4, 16, 96))} FROM r""",
    "candles_1h",
)
def price_features(spark, sf_dir):
    cols = ["log_return", "hl_range", "co_spread", *(f"{k}_{n}" for n in (4, 16, 96) for k in ("volatility", "roc"))]
    return rounded(ind.with_price_features(candles(spark, sf_dir)).select("symbol", "ts", *cols), *cols)


@query(
    f"""WITH a AS (SELECT symbol, ts, round({f(14, 'avg', '(high - low)')}, 6) AS atr_14 FROM candles_4h),
    h AS (SELECT symbol, ts, atr_14, list(atr_14) FILTER (atr_14 IS NOT NULL) OVER ({W} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS h FROM a)
    SELECT symbol, ts, atr_14, CASE WHEN len(h) = 100 THEN round((len(list_filter(h, lambda x: x < atr_14)) + (len(list_filter(h, lambda x: x = atr_14)) + 1) / 2.0::DOUBLE) / 100, 6) END AS atr_percentile FROM h""",
    "candles_4h",
)
def atr_percentile(spark, sf_dir):
    return rounded(ind.with_atr_percentile(candles(spark, sf_dir, "4h")).select("symbol", "ts", "atr_14", "atr_percentile"), "atr_percentile")


@query(
    f"""SELECT symbol, ts, round(v / nullif(lag(v) OVER ({W}), 0) - 1, 6) AS volume_change, round({f(20, 'avg', 'v')}, 6) AS volume_ma_20, round(v / nullif({f(20, 'avg', 'v')}, 0), 6) AS volume_ratio,
      round({f(20, 'stddev_samp', 'v')}, 6) AS volume_std_20, round(v / nullif({f(96, 'sum', 'v')}, 0), 6) AS volume_profile FROM (SELECT *, volume::DOUBLE AS v FROM candles_1h)""",
    "candles_1h",
)
def volume_features(spark, sf_dir):
    cols = ["volume_change", "volume_ma_20", "volume_ratio", "volume_std_20", "volume_profile"]
    return rounded(ind.with_volume_features(candles(spark, sf_dir)).select("symbol", "ts", *cols), *cols)


@query(
    """SELECT symbol, ts, round(sin(2 * pi() * hour(ts) / 24), 6) AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) AS hour_cos, round(sin(2 * pi() * (isodow(ts) - 1) / 7), 6) AS day_sin,
      round(cos(2 * pi() * (isodow(ts) - 1) / 7), 6) AS day_cos, CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM candles_1h""",
    "candles_1h",
)
def temporal_features(spark, sf_dir):
    cols = ["hour_sin", "hour_cos", "day_sin", "day_cos"]
    return rounded(ind.with_temporal_features(candles(spark, sf_dir)).select("symbol", "ts", *cols, "is_weekend"), *cols)


@query(
    f"""WITH m AS (SELECT symbol, ts, CASE WHEN abs((close - open) / nullif(open, 0)) > 0.03 THEN ts END AS moved FROM candles_15m)
    SELECT symbol, ts, round(date_diff('second', last_value(moved IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING), ts) / 3600.0::DOUBLE, 6) AS hours_since_move FROM m""",
    "candles_15m",
)
def hours_since_major_move(spark, sf_dir):
    return rounded(ind.with_last_major_move(candles(spark, sf_dir, "15m")).select("symbol", "ts", "hours_since_move"), "hours_since_move")


@query(
    f"""WITH a AS (SELECT symbol, ts, volume / nullif(trade_count, 0)::DOUBLE AS avg_size FROM candles_1d)
    SELECT symbol, ts, round(avg_size, 6) AS avg_size, coalesce(avg_size > avg(avg_size) OVER w + 2 * stddev_samp(avg_size) OVER w, false) AS is_whale_day
    FROM a WINDOW w AS ({W} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""",
    "candles_1d",
)
def whale_day_flag(spark, sf_dir):
    w = over("symbol").rowsBetween(-29, 0)
    out = candles(spark, sf_dir, "1d").select("symbol", "ts", F.try_divide(F.col("volume"), F.col("trade_count")).alias("avg_size"))
    flag = F.coalesce(F.col("avg_size") > F.avg("avg_size").over(w) + 2 * F.stddev_samp("avg_size").over(w), F.lit(False))
    return rounded(out.withColumn("is_whale_day", flag), "avg_size")


@query(
    f"""WITH n AS (SELECT symbol, ts, 100 * (lead(close) OVER ({W}) - close) / nullif(close, 0) AS c FROM candles_1h)
    SELECT symbol, ts, round(c, 4) AS change_pct, CASE WHEN c > 0.25 THEN 'UP' WHEN c < -0.25 THEN 'DOWN' ELSE 'SIDEWAYS' END AS label, round(least(0.92, 0.56 + least(abs(c), 8) / 20), 4) AS confidence FROM n WHERE c IS NOT NULL""",
    "candles_1h",
)
def next_candle_label(spark, sf_dir):
    from lodemark.functions.labels import next_move_label

    w = over("symbol")
    bars = candles(spark, sf_dir).withColumn("c", F.try_divide(100 * (F.lead("close").over(w) - F.col("close")), F.nullif("close", F.lit(0.0)))).filter("c IS NOT NULL")
    label, confidence = next_move_label(F.col("c"))
    return bars.select("symbol", "ts", F.round("c", 4).alias("change_pct"), label.alias("label"), F.round(confidence, 4).alias("confidence"))


@query(
    f"""WITH n AS (SELECT symbol, ts, close / nullif(lag(close) OVER ({W}), 0) - 1 AS c FROM candles_1d)
    SELECT symbol, ts, CASE WHEN c > 0.01 THEN 'Bullish' WHEN c < -0.01 THEN 'Bearish' ELSE 'Neutral' END AS trend FROM n""",
    "candles_1d",
)
def daily_trend_label(spark, sf_dir):
    c = change(over("symbol"), 1, F.col("close"))
    return candles(spark, sf_dir, "1d").select("symbol", "ts", F.when(c > 0.01, "Bullish").when(c < -0.01, "Bearish").otherwise("Neutral").alias("trend"))


@query(
    f"SELECT symbol, ts, CASE WHEN row_number() OVER ({W}) <= greatest(1, CAST(floor(0.8 * count(*) OVER (PARTITION BY symbol)) AS BIGINT)) THEN 'train' ELSE 'valid' END AS part FROM candles_1h",
    "candles_1h",
)
def train_valid_split(spark, sf_dir):
    return rel.chronological_split(candles(spark, sf_dir).select("symbol", "ts"), ["symbol"], "ts", 0.8)


@query(
    f"""WITH s AS (SELECT symbol, ts, close, count(*) OVER p AS n, avg(close) OVER p AS m, first_value(close) OVER p AS a, last_value(close) OVER p AS z FROM candles_1h WINDOW p AS ({W} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))
    SELECT symbol, ts, close AS target, round(m, 6) AS mean_close, a AS first_close, z AS last_close FROM s WHERE n = 60""",
    "candles_1h",
)
def sequence_windows(spark, sf_dir):
    rows = rel.sequences(candles(spark, sf_dir), ["symbol"], "ts", ["close", "high", "low"], 60)
    mean = F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x[0]) / 60
    return rows.select("symbol", "ts", F.col("close").alias("target"), F.round(mean, 6).alias("mean_close"), F.col("sequence")[0][0].alias("first_close"), F.col("sequence")[59][0].alias("last_close"))


@query(
    """SELECT symbol, ts, event_id, price, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS drk, ntile(4) OVER t AS quartile
    FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY price DESC, event_id), t AS (PARTITION BY symbol ORDER BY ts, event_id)""",
    "ticks",
)
def ranking_functions(spark, sf_dir):
    w, t = Window.partitionBy("symbol").orderBy(F.desc("price"), "event_id"), Window.partitionBy("symbol").orderBy("ts", "event_id")
    return ticks(spark, sf_dir).select("symbol", "ts", "event_id", "price", *(c.cast("long").alias(n) for n, c in (("rn", F.row_number().over(w)), ("rk", F.rank().over(w)), ("drk", F.dense_rank().over(w)), ("quartile", F.ntile(4).over(t)))))


@query(
    f"""WITH x AS (SELECT symbol, ts, close, coalesce(close / nullif(lag(close, 1) OVER ({W}), 0) - 1, 0) AS return_1, coalesce(close / nullif(lag(close, 5) OVER ({W}), 0) - 1, 0) AS return_5, lead(close) OVER ({W}) AS target FROM candles_1h),
    v AS (SELECT *, {f(20, 'stddev_samp', 'return_1')} AS vol FROM x)
    SELECT symbol, ts, close, round(return_1, 6) AS return_1, round(return_5, 6) AS return_5, round(vol, 6) AS volatility_20, target FROM v WHERE vol IS NOT NULL AND target IS NOT NULL""",
    "candles_1h",
)
def flat_feature_frame(spark, sf_dir):
    from lodemark.functions.features import flat_frame

    return rounded(flat_frame(candles(spark, sf_dir)), "return_1", "return_5", "volatility_20")


@query(
    f"""WITH s AS (SELECT symbol, ts, volume, CASE WHEN trade_count = 1 THEN NULL ELSE close END AS x FROM candles_1h),
    q AS (SELECT symbol, ts, last_value(x IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS a, avg(x) OVER (PARTITION BY symbol) AS m FROM s)
    SELECT symbol, ts, round(coalesce(a, m, 0), 6) AS filled FROM q""",
    "candles_1h",
)
def fill_chain(spark, sf_dir):
    bars = candles(spark, sf_dir).select("symbol", "ts", F.when(F.col("trade_count") != 1, F.col("close")).alias("x"))
    return rounded(rel.fill_chain(bars, ["symbol"], "ts", ["x"]).select("symbol", "ts", F.col("x").alias("filled")), "filled")


@query(
    """SELECT symbol, ts, close, round((close - avg(close) OVER (PARTITION BY symbol)) / nullif(stddev_pop(close) OVER (PARTITION BY symbol), 0), 6) AS scaled FROM candles_1d""",
    "candles_1d",
)
def standardise(spark, sf_dir):
    return rounded(rel.standardise(candles(spark, sf_dir, "1d").select("symbol", "ts", "close"), ["symbol"], {"scaled": "close"}), "scaled")


@query(
    """SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus) HAVING count(*) > 1""",
)
def cube_having(spark, sf_dir):
    return load(spark, sf_dir, "orders").cube("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).filter("n > 1")
