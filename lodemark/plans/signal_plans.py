"""Signals: snapshots, rules, lifecycle, gates and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodemark.functions.labels import outcome, risk_level
from lodemark.operators import relational as rel
from lodemark.operators import rollups as roll
from lodemark.operators import signals as sig

from .registry import query
from .sentiment import T, as_of
from .tables import candles, coin_configs, load, onchain_events, sentiment_scores, tick_signals, ticks, trading_signals

SNAP = f"""price AS (SELECT symbol, arg_max(close, ts) AS price, 100 * (arg_max(close, ts) - arg_max(close, ts) FILTER (ts <= {T} - INTERVAL 24 HOUR)) / nullif(arg_max(close, ts) FILTER (ts <= {T} - INTERVAL 24 HOUR), 0) AS change_24h,
  arg_max(high - low, ts) AS atr, arg_max(volume, ts) AS volume, avg(volume) AS mean_volume FROM candles_1h WHERE ts <= {T} GROUP BY 1),
mood AS (SELECT symbol, avg(sentiment_score) AS sentiment FROM sentiment_scores WHERE ts > {T} - INTERVAL 24 HOUR AND ts <= {T} GROUP BY 1),
chain AS (SELECT symbol, sum(CASE WHEN flow_direction = 'to_exchange' THEN amount_usd ELSE 0 END) - sum(CASE WHEN flow_direction = 'from_exchange' THEN amount_usd ELSE 0 END) AS net_flow, sum(is_whale::INT) AS whales FROM onchain_events WHERE ts > {T} - INTERVAL 24 HOUR AND ts <= {T} GROUP BY 1),
snap AS (SELECT c.symbol, coalesce(price, 0) AS price, round(coalesce(change_24h, 0), 6) AS change_24h, round(coalesce(atr, 0), 6) AS atr, round(coalesce(volume / nullif(mean_volume, 0), 1), 6) AS volume_ratio, round(coalesce(sentiment, 0.5), 6) AS sentiment,
  round(coalesce(net_flow, 0), 2) AS net_flow, CAST(coalesce(whales, 0) AS BIGINT) AS whales, least(1.0::DOUBLE, coalesce(whales, 0) / 10.0::DOUBLE) AS onchain_score FROM coin_configs c LEFT JOIN price USING (symbol) LEFT JOIN mood USING (symbol) LEFT JOIN chain USING (symbol))"""
SNAP_TABLES = ("candles_1h", "sentiment_scores", "onchain_events", "coin_configs")


def snapshot(spark, sf_dir):
    """One row for each configured symbol: latest price, moods and flows of a day, with defaults where a source has nothing."""
    bars = candles(spark, sf_dir).filter(F.col("ts") <= as_of())
    old = F.max_by("close", F.when(F.col("ts") <= as_of() - F.expr("INTERVAL 24 HOURS"), F.col("ts")))
    now = F.max_by("close", "ts")
    price = bars.groupBy("symbol").agg(now.alias("price"), F.try_divide(100 * (now - old), F.nullif(old, F.lit(0.0))).alias("change_24h"), F.max_by(F.col("high") - F.col("low"), "ts").alias("atr"), F.try_divide(F.max_by("volume", "ts"), F.avg("volume")).alias("volume_ratio"))
    recent = lambda df: df.filter((F.col("ts") > as_of() - F.expr("INTERVAL 24 HOURS")) & (F.col("ts") <= as_of()))
    mood = recent(sentiment_scores(spark, sf_dir)).groupBy("symbol").agg(F.avg("sentiment_score").alias("sentiment"))
    chain = roll.net_flow(onchain_events(spark, sf_dir), as_of())
    out = coin_configs(spark, sf_dir).select("symbol").join(price, "symbol", "left").join(mood, "symbol", "left").join(chain, "symbol", "left")
    default = lambda c, v, d=6: F.round(F.coalesce(c, F.lit(v)), d).alias(c)
    return out.select(
        "symbol", F.coalesce("price", F.lit(0.0)).alias("price"), default("change_24h", 0.0), default("atr", 0.0), default("volume_ratio", 1.0), default("sentiment", 0.5), default("net_flow", 0.0, 2), F.coalesce("whales", F.lit(0)).cast("long").alias("whales"),
        F.least(F.lit(1.0), F.coalesce("whales", F.lit(0)) / F.lit(10.0)).alias("onchain_score"),
    )


@query(f"WITH {SNAP} SELECT * FROM snap", *SNAP_TABLES)
def snapshot_features(spark, sf_dir):
    return snapshot(spark, sf_dir)


def _case(pairs):
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in pairs) + "], lambda x: x IS NOT NULL)"


FACTORS = f"""WITH {SNAP}, full_ AS (SELECT *, CASE WHEN change_24h > 0 THEN 'UP' WHEN change_24h < 0 THEN 'DOWN' ELSE 'SIDEWAYS' END AS direction, round(1 - sentiment / 4, 6) AS prediction_confidence, round(100 * sentiment, 6) AS rsi, change_24h AS macd_hist FROM snap),
f AS (SELECT symbol, len({_case([('s', 'sentiment > 0.7'), ('p', "direction = 'UP'"), ('c', 'prediction_confidence > 0.75')])}) AS bp, len({_case([('r', 'rsi < 30'), ('m', 'macd_hist > 0'), ('v', 'volume_ratio > 1.5'), ('o', 'net_flow < 0'), ('t', 'change_24h > 0')])}) AS bs,
  len({_case([('a', 'rsi > 80'), ('b', 'atr > 0.05 * price'), ('c', 'whales > 5'), ('d', 'change_24h < -10')])}) AS rk, len({_case([('s', 'sentiment < 0.3'), ('p', "direction = 'DOWN'")])}) AS sp,
  len({_case([('r', 'rsi > 70'), ('m', 'macd_hist < 0'), ('v', 'volume_ratio > 1.5'), ('o', 'net_flow > 0'), ('t', 'change_24h < 0')])}) AS ss FROM full_)
SELECT symbol, bp AS buy_primary, bs AS buy_support, sp AS sell_primary, ss AS sell_support, rk AS risks, CASE WHEN bp = 3 AND bs >= 2 AND rk = 0 THEN 'BUY' WHEN sp = 2 AND ss >= 2 THEN 'SELL' ELSE 'HOLD' END AS side FROM f"""


@query(FACTORS, *SNAP_TABLES)
def buy_sell_rules(spark, sf_dir):
    rows = snapshot(spark, sf_dir)
    c = F.col("change_24h")
    rows = rows.withColumns({"direction": F.when(c > 0, "UP").when(c < 0, "DOWN").otherwise("SIDEWAYS"), "prediction_confidence": F.round(1 - F.col("sentiment") / 4, 6), "rsi": F.round(100 * F.col("sentiment"), 6), "macd_hist": c})
    out = sig.factors(rows)
    return out.select("symbol", *(F.size(x).cast("long").alias(x) for x in ("buy_primary", "buy_support", "sell_primary", "sell_support", "risks")), "side")


@query(
    """SELECT id, round(least((0.3 * (id % 11) / 10.0::DOUBLE + 0.4 * confidence + 0.3 * (id % 7) / 6.0::DOUBLE) * greatest(0.2, (id % 6) / 5.0::DOUBLE) * 10, 10), 6) AS strength2,
    CASE WHEN id % 25 / 10.0::DOUBLE > 1.8 OR confidence < 0.55 THEN 'HIGH' WHEN id % 25 / 10.0::DOUBLE > 1.2 OR confidence < 0.75 THEN 'MEDIUM' ELSE 'LOW' END AS risk,
    round(CASE WHEN abs(entry_price - entry_price * 0.985) = 0 THEN 0 ELSE 10000 * 0.01 / abs(entry_price - entry_price * 0.985) END, 6) AS size FROM trading_signals""",
    "trading_signals",
)
def signal_strength(spark, sf_dir):
    rows, i = trading_signals(spark, sf_dir), F.col("id")
    value = sig.strength((i % 11) / F.lit(10.0), F.col("confidence"), (i % 7) / F.lit(6.0), i % 6)
    size = sig.position_size(F.lit(10000.0), F.lit(0.01), F.col("entry_price"), F.col("entry_price") * 0.985)
    return rows.select("id", F.round(value, 6).alias("strength2"), risk_level((i % 25) / F.lit(10.0), F.col("confidence")).alias("risk"), F.round(size, 6).alias("size"))


@query(
    """WITH t AS (SELECT id, signal, entry_price AS p, CASE WHEN id % 2 = 0 THEN entry_price * 1.03 END AS q FROM trading_signals), u AS (SELECT id, p, CASE WHEN signal = 'BUY' THEN coalesce(q, p * 1.02) ELSE coalesce(q, p * 0.98) END AS target,
    CASE WHEN signal = 'BUY' THEN p * 0.985 ELSE p * 1.015 END AS stop FROM t) SELECT id, round(target, 6) AS target, round(stop, 6) AS stop, round(abs(target - p) / nullif(abs(p - stop), 0), 4) AS risk_reward FROM u""",
    "trading_signals",
)
def price_targets(spark, sf_dir):
    p = F.col("entry_price")
    none = F.lit(None).cast("double")
    made = sig.price_targets(F.col("signal"), p, F.when(F.col("id") % 2 == 0, p * 1.03), none, none)
    return trading_signals(spark, sf_dir).select("id", *(F.round(v, 4 if k == "risk_reward" else 6).alias(k) for k, v in made.items()))


@query("SELECT id, symbol, signal, strength, confidence FROM trading_signals WHERE signal IN ('BUY', 'SELL') AND confidence >= 0.7 AND strength >= 6.5", "trading_signals")
def quality_gate(spark, sf_dir):
    return sig.quality_gate(trading_signals(spark, sf_dir)).select("id", "symbol", "signal", "strength", "confidence")


@query(
    """SELECT risk_level, count(*) AS n, count(*) FILTER (closed_at IS NOT NULL) AS closed, round(avg(pnl_pct) FILTER (closed_at IS NOT NULL), 6) AS mean_pnl, round(avg(CASE WHEN pnl_pct > 0 THEN 1.0::DOUBLE ELSE 0 END) FILTER (closed_at IS NOT NULL), 6) AS win_rate
    FROM trading_signals GROUP BY 1""",
    "trading_signals",
)
def signal_performance_json(spark, sf_dir):
    rows = trading_signals(spark, sf_dir).select(F.from_json("metadata", "risk_level string, closed_at string, pnl_pct string").alias("m"))
    rows = rows.select("m.risk_level", F.col("m.closed_at").cast("timestamp_ntz").alias("closed_at"), F.col("m.pnl_pct").cast("double").alias("pnl_pct"))
    closed = F.col("closed_at").isNotNull()
    return rows.groupBy("risk_level").agg(F.count("*").alias("n"), F.count_if(closed).alias("closed"), F.round(F.avg(F.when(closed, F.col("pnl_pct"))), 6).alias("mean_pnl"), F.round(F.avg(F.when(closed, F.when(F.col("pnl_pct") > 0, 1.0).otherwise(0.0))), 6).alias("win_rate"))


@query(
    "SELECT id, closed_at, pnl_pct, CASE WHEN pnl_pct > 0 THEN 'win' WHEN pnl_pct < 0 THEN 'loss' ELSE 'flat' END AS outcome FROM trading_signals WHERE closed_at IS NOT NULL ORDER BY closed_at DESC, id LIMIT 20", "trading_signals"
)
def recent_outcomes(spark, sf_dir):
    get = lambda k: F.get_json_object("metadata", f"$.{k}")
    rows = trading_signals(spark, sf_dir).select("id", get("closed_at").cast("timestamp_ntz").alias("closed_at"), get("pnl_pct").cast("double").alias("pnl_pct")).filter("closed_at IS NOT NULL")
    return rows.withColumn("outcome", outcome(F.col("pnl_pct"))).orderBy(F.desc("closed_at"), "id").limit(20)


@query("SELECT id, symbol, signal, ts FROM trading_signals WHERE is_active AND expires_at > TIMESTAMP '2000-01-01' QUALIFY row_number() OVER (PARTITION BY symbol, signal ORDER BY ts DESC, id DESC) = 1", "trading_signals")
def active_signals_latest(spark, sf_dir):
    rows = trading_signals(spark, sf_dir).filter(F.col("is_active") & (F.col("expires_at") > F.lit("2000-01-01").cast("timestamp_ntz")))
    return rel.latest(rows.select("id", "symbol", "signal", "ts"), ["symbol", "signal"], "ts", "id")


@query("SELECT id, symbol, signal, strength FROM trading_signals WHERE symbol = 'BUILDING' AND signal = 'BUY' AND confidence >= 0.2 ORDER BY strength DESC, id LIMIT 25 OFFSET 25", "trading_signals")
def signals_filtered_page(spark, sf_dir):
    where = rel.all_of(F.col("symbol") == "BUILDING", F.col("signal") == "BUY", None, F.col("confidence") >= 0.2)
    return rel.page(trading_signals(spark, sf_dir).filter(where).select("id", "symbol", "signal", "strength"), [F.desc("strength"), F.col("id")], 2, 25)


@query("SELECT symbol, is_enabled FROM coin_configs c WHERE EXISTS (SELECT 1 FROM tick_signals s WHERE s.symbol = c.symbol)", "coin_configs", "tick_signals")
def coins_with_signals_semi(spark, sf_dir):
    return coin_configs(spark, sf_dir).join(tick_signals(spark, sf_dir), "symbol", "left_semi").select("symbol", "is_enabled")


@query("SELECT symbol FROM coin_configs c WHERE is_enabled AND EXISTS (SELECT 1 FROM candles_1h x WHERE x.symbol = c.symbol) AND EXISTS (SELECT 1 FROM sentiment_scores x WHERE x.symbol = c.symbol) AND EXISTS (SELECT 1 FROM onchain_events x WHERE x.symbol = c.symbol AND is_whale)", "coin_configs", "candles_1h", "sentiment_scores", "onchain_events")
def completeness_gate(spark, sf_dir):
    out = coin_configs(spark, sf_dir).filter("is_enabled").select("symbol")
    for source in (candles(spark, sf_dir), sentiment_scores(spark, sf_dir), onchain_events(spark, sf_dir).filter("is_whale")):
        out = out.join(source.select("symbol"), "symbol", "left_semi")
    return out


@query(
    """WITH m AS (SELECT s.*, c.ts AS r_ts, c.close AS c, CASE WHEN s.signal = 'BUY' THEN CASE WHEN c.close >= s.price * 1.02 THEN 'take_profit' WHEN c.close <= s.price * (1 - 0.015) THEN 'stop_loss' END
      WHEN s.signal = 'SELL' THEN CASE WHEN c.close <= s.price * (1 - 0.02) THEN 'take_profit' WHEN c.close >= s.price * (1 + 0.015) THEN 'stop_loss' END END AS why
      FROM tick_signals s LEFT JOIN candles_1h c ON c.symbol = s.symbol AND c.ts BETWEEN s.ts + INTERVAL 1 SECOND AND s.ts + INTERVAL 24 HOUR),
    e AS (SELECT id, symbol, signal, price, arg_min(why, r_ts) FILTER (why IS NOT NULL) AS why, min(r_ts) FILTER (why IS NOT NULL) AS hit_ts, arg_min(c, r_ts) FILTER (why IS NOT NULL) AS hit_c, max(r_ts) AS last_ts, arg_max(c, r_ts) AS last_c FROM m GROUP BY ALL)
    SELECT id, CASE WHEN coalesce(hit_ts, last_ts) IS NULL THEN 'open' ELSE coalesce(why, 'timeout') END AS reason, coalesce(hit_ts, last_ts) AS closed_at,
    round(CASE WHEN price > 0 THEN (CASE WHEN signal = 'SELL' THEN -1 ELSE 1 END) * 100 * (coalesce(hit_c, last_c) - price) / price END, 6) AS pnl_pct FROM e""",
    "tick_signals", "candles_1h",
)
def signal_lifecycle(spark, sf_dir):
    return sig.lifecycle(tick_signals(spark, sf_dir), candles(spark, sf_dir)).select("id", "reason", "closed_at", "pnl_pct")


@query(
    """WITH RECURSIVE s AS (SELECT id, symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts, id) AS n FROM tick_signals), k AS (SELECT id, symbol, ts, n, ts AS last, true AS kept FROM s WHERE n = 1
    UNION ALL SELECT s.id, s.symbol, s.ts, s.n, CASE WHEN s.ts - k.last >= INTERVAL 1 HOUR THEN s.ts ELSE k.last END, s.ts - k.last >= INTERVAL 1 HOUR FROM k JOIN s ON s.symbol = k.symbol AND s.n = k.n + 1) SELECT id, symbol, ts FROM k WHERE kept""",
    "tick_signals",
)
def cooldown_filter(spark, sf_dir):
    return sig.cooldown(tick_signals(spark, sf_dir).select("id", "symbol", "ts"), ["symbol"], 3600)


@query(
    """WITH x AS (SELECT id, (id % 21 - 10) / 40.0::DOUBLE AS m, (id % 17) / 16.0::DOUBLE AS s, (id % 5) / 10.0::DOUBLE AS v FROM tick_signals), y AS (SELECT id, 2 * m + 1.5 * (s - 0.5) AS score, v FROM x)
    SELECT id, CASE WHEN score > 0.15 THEN 'BUY' WHEN score < -0.15 THEN 'SELL' ELSE 'HOLD' END AS side, round(score, 6) AS score, round(least(greatest(least(abs(score), 1) - 0.3 * least(greatest(v, 0), 1), 0), 1), 6) AS confidence FROM y""",
    "tick_signals",
)
def flat_signal(spark, sf_dir):
    i = F.col("id")
    made = sig.flat_signal((i % 21 - 10) / F.lit(40.0), (i % 17) / F.lit(16.0), (i % 5) / F.lit(10.0))
    return tick_signals(spark, sf_dir).select("id", made["side"].alias("side"), F.round(made["score"], 6).alias("score"), F.round(made["confidence"], 6).alias("confidence"))


@query("SELECT id, ts, strength FROM (SELECT *, strength / 10 AS confidence FROM tick_signals) WHERE confidence >= 0.5 AND strength >= 5 AND (NOT (hour(ts) >= 22 OR hour(ts) < 7) OR confidence >= 0.9)", "tick_signals")
def notification_gate(spark, sf_dir):
    return sig.notify_gate(tick_signals(spark, sf_dir).withColumn("confidence", F.col("strength") / 10), 0.5, 5.0, 22, 7).select("id", "ts", "strength")


@query(
    """SELECT s.id, count(p.id) AS peers, round(avg(p.pnl_pct), 6) AS mean_pnl FROM trading_signals s LEFT JOIN trading_signals p ON p.symbol = s.symbol AND p.signal = s.signal AND p.ts = s.ts AND p.id <> s.id GROUP BY 1""",
    "trading_signals",
)
def peer_comparison(spark, sf_dir):
    """Other signals of the same symbol, side and day: from sums by group, without pairing them."""
    rows = trading_signals(spark, sf_dir).select("id", "symbol", "signal", "ts", F.get_json_object("metadata", "$.pnl_pct").cast("double").alias("p"))
    sums = rows.groupBy("symbol", "signal", "ts").agg(F.count("*").alias("n"), F.sum("p").alias("s"))
    return rows.join(sums, ["symbol", "signal", "ts"]).select("id", (F.col("n") - 1).alias("peers"), F.round(F.try_divide(F.col("s") - F.col("p"), F.col("n") - 1), 6).alias("mean_pnl"))


@query(
    """WITH b AS (SELECT o_orderkey AS id, o_custkey AS k, o_totalprice AS v FROM orders WHERE o_orderstatus <> 'P' AND (o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0)), d AS (SELECT o_orderkey AS id, o_custkey AS k, o_totalprice * 2 AS v FROM orders WHERE o_orderstatus = 'P' OR o_orderkey % 3 = 0)
    SELECT coalesce(d.id, b.id) AS id, coalesce(b.k, d.k) AS k, coalesce(d.v, b.v) AS v FROM b FULL JOIN d ON b.id = d.id"""
)
def upsert_merge(spark, sf_dir):
    """Every order is in the base, in the delta, or in both: pending ones and odd multiples of three are new, other multiples of six are updated."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), "o_orderstatus")
    base, delta = o.filter("o_orderstatus <> 'P' AND (id % 3 <> 0 OR id % 2 = 0)"), o.filter("o_orderstatus = 'P' OR id % 3 = 0")
    return rel.upsert(base.drop("o_orderstatus"), delta.drop("o_orderstatus").withColumn("v", F.col("v") * 2), ["id"], update=["v"])


@query("SELECT CASE WHEN ts >= TIMESTAMP '2024-01-30' - INTERVAL 10 DAY THEN 'kept' ELSE 'archived' END AS part, count(*) AS n FROM ticks GROUP BY 1", "ticks")
def retention_split(spark, sf_dir):
    kept, old = rel.retention(ticks(spark, sf_dir), "ts", F.lit("2024-01-30").cast("timestamp_ntz"), 10)
    return kept.select(F.lit("kept").alias("part")).unionByName(old.select(F.lit("archived").alias("part"))).groupBy("part").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority AS model, o_orderkey AS id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY date_trunc('month', o_orderdate) DESC, o_orderkey DESC) = 1 AS is_active FROM orders")
def activate_latest(spark, sf_dir):
    """The last of each model, by month; many share the last month, and the greatest id of these is active."""
    rows = load(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("model"), F.col("o_orderkey").alias("id"), F.date_trunc("month", "o_orderdate").alias("month"))
    return rel.activate_latest(rows, ["model"], "month", tie="id").drop("month")


@query("SELECT CASE WHEN side_ok THEN 'valid' ELSE 'quarantine' END AS part, count(*) AS n FROM (SELECT coalesce(signal IN ('BUY', 'SELL') AND price >= 0.5, false) AS side_ok FROM tick_signals) GROUP BY 1", "tick_signals")
def domain_check(spark, sf_dir):
    good, bad = rel.valid(tick_signals(spark, sf_dir), F.col("signal").isin("BUY", "SELL") & (F.col("price") >= 0.5))
    return good.select(F.lit("valid").alias("part")).unionByName(bad.select(F.lit("quarantine").alias("part"))).groupBy("part").agg(F.count("*").alias("n"))
