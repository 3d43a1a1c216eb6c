"""Domain tables over the driver's tables: each as a DataFrame and as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemark.operators.rolling import running
from lodemark.operators.rollups import candles as roll_candles

BUCKETS = {"15m": "15 minutes", "1h": "1 hour", "4h": "4 hours", "1d": "1 day"}
SYMBOLS = ("click", "error", "purchase", "signup", "view")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", "ts", F.col("event_type").alias("symbol"), F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("int").alias("size"), "user_id")


def candles(spark: SparkSession, sf_dir: str, interval: str = "1h") -> DataFrame:
    return roll_candles(ticks(spark, sf_dir), BUCKETS[interval])


def sentiment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.col("size") / F.lit(99.0)
    label = F.when(score >= 0.66, "BULLISH").when(score <= 0.20, "FUD").when(score <= 0.34, "BEARISH").otherwise("NEUTRAL")
    source = F.element_at(F.array(*map(F.lit, ("news", "reddit", "onchain", "other"))), (F.col("user_id") % 4 + 1).cast("int"))
    return ticks(spark, sf_dir).select(F.col("event_id").alias("id"), "ts", "symbol", source.alias("source_type"), label.alias("sentiment_label"), score.alias("sentiment_score"), ((F.col("event_id") % 100) / F.lit(100.0)).alias("confidence"))


def onchain_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = F.element_at(F.array(*map(F.lit, ("to_exchange", "from_exchange", "wallet_to_wallet"))), (F.col("user_id") % 3 + 1).cast("int"))
    return ticks(spark, sf_dir).select("event_id", "ts", "symbol", (F.col("price") * 1000).alias("amount_usd"), (F.col("size") >= 90).alias("is_whale"), flow.alias("flow_direction"))


def onchain_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders, customers = (load(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customers, orders.o_custkey == customers.c_custkey)
    flow = F.when(F.col("l_returnflag") == "R", "to_exchange").when(F.col("l_returnflag") == "A", "from_exchange").otherwise("wallet_to_wallet")
    return joined.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("tx_id"), F.col("l_shipdate").alias("ts"), F.col("c_mktsegment").alias("symbol"), F.col("l_extendedprice").alias("amount_usd"),
        (F.col("l_extendedprice") >= 95000).alias("is_whale"), flow.alias("flow_direction"), "l_partkey", "l_suppkey",
    )


def _symbol(place) -> F.Column:
    return F.element_at(F.array(*map(F.lit, SYMBOLS)), (place % 5 + 1).cast("int"))


def news_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = _symbol(F.col("doc_id")), _symbol(F.floor(F.col("doc_id") / 5))
    ts = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=(40 * (F.col("doc_id") % 1000)).cast("int"))
    return load(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), ts.alias("ts"), F.col("source").alias("source_name"), F.substring("text", 1, 80).alias("title"), F.col("text").alias("content"), F.sha2(F.trim("text"), 256).alias("url_hash"),
        F.array_sort(F.array_distinct(F.array(first, second))).alias("mentioned_coins"), first.alias("primary_symbol"),
    )


def trading_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer")
    side = F.when(F.col("o_orderstatus") == "O", "BUY").when(F.col("o_orderstatus") == "F", "SELL").otherwise("HOLD")
    strength = F.col("o_totalprice") * 10 / F.lit(500000.0)
    closed = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    meta = F.to_json(F.create_map(F.lit("risk_level"), F.col("o_orderpriority"), F.lit("closed_at"), closed, F.lit("pnl_pct"), ((F.col("o_orderkey") % 41 - 20) / F.lit(10.0)).cast("string")))
    return orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"), F.col("c_mktsegment").alias("symbol"), F.lit("1h").alias("interval"), side.alias("signal"), strength.alias("strength"), (strength / 10).alias("confidence"),
        F.col("o_totalprice").alias("entry_price"), (F.col("o_orderkey") % 3 != 0).alias("is_active"), (F.col("o_orderdate") + F.expr("INTERVAL 4 HOURS")).alias("expires_at"), meta.alias("metadata"),
    )


def tick_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.element_at(F.array(*map(F.lit, ("BUY", "SELL", "HOLD"))), (F.col("event_id") % 3 + 1).cast("int"))
    return ticks(spark, sf_dir).select(F.col("event_id").alias("id"), "ts", "symbol", side.alias("signal"), (F.col("size") / F.lit(10.0)).alias("strength"), "price")


def price_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    actual = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("actual_price"))
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("model_name"), F.col("o_totalprice").alias("predicted_price"), F.col("o_orderstatus").alias("status"))
    return orders.join(actual, "id", "left")


def backtest_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "orders")
    side = F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY")
    edge = F.round(F.col("l_discount") - 0.05, 4)
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("decimal(18,2)")).alias("id"), F.col("l_linestatus").alias("symbol"), side.alias("side"), F.col("o_orderdate").alias("entry_time"),
        F.col("l_shipdate").alias("exit_time"), F.round(F.col("l_extendedprice") * edge, 6).alias("pnl"), edge.alias("pnl_pct"),
        F.abs(F.unix_seconds(F.col("l_shipdate").cast("timestamp")) - F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).alias("duration_seconds"),
    )


def equity_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten thousand plus the running sum of each hour's (price - 100), in cents so that sums are exact."""
    hourly = ticks(spark, sf_dir).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.sum(F.round(F.col("price") * 100).cast("long") - 10000).alias("cents"))
    summed = running(hourly, [], ["ts"], F.date_trunc("week", "ts"), through=("sum", F.col("cents")))
    return summed.select("ts", ((F.lit(100000000) + F.col("through")) / F.lit(100.0)).alias("equity"))


def coin_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(s, i != 3, 0.5, 6.0 + i / 10, ["15m", "1h"]) for i, s in enumerate((*SYMBOLS, "idle"))]
    return spark.createDataFrame(rows, "symbol string, is_enabled boolean, min_signal_confidence double, min_signal_strength double, tracked_intervals array<string>")


def system_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latencies of four services: every tick is a call, its price the milliseconds that it took."""
    return ticks(spark, sf_dir).select("event_id", "ts", F.concat(F.lit("svc"), (F.col("user_id") % 4).cast("string")).alias("service_name"), F.col("price").alias("latency_ms"))


_SYMBOLS_SQL = "['click', 'error', 'purchase', 'signup', 'view']"


def _candles_sql(interval: str) -> str:
    return f"""SELECT symbol, time_bucket(INTERVAL '{BUCKETS[interval]}', ts) AS ts, arg_min(price, {{t: ts, i: event_id}}) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, {{t: ts, i: event_id}}) AS close, CAST(sum(size) AS BIGINT) AS volume, count(*) AS trade_count FROM ticks GROUP BY ALL"""


#: SQL of each table, after the tables that it needs.
SQL = {
    "ticks": "SELECT event_id, ts, event_type AS symbol, value AS price, CAST(json_extract_string(props, '$.k') AS INT) AS size, user_id FROM events",
    **{f"candles_{i}": _candles_sql(i) for i in BUCKETS},
    "sentiment_scores": """SELECT event_id AS id, ts, symbol, ['news', 'reddit', 'onchain', 'other'][CAST(user_id % 4 AS INT) + 1] AS source_type,
  CASE WHEN size / 99.0::DOUBLE >= 0.66 THEN 'BULLISH' WHEN size / 99.0::DOUBLE <= 0.20 THEN 'FUD' WHEN size / 99.0::DOUBLE <= 0.34 THEN 'BEARISH' ELSE 'NEUTRAL' END AS sentiment_label,
  size / 99.0::DOUBLE AS sentiment_score, (event_id % 100) / 100.0::DOUBLE AS confidence FROM ticks""",
    "onchain_events": """SELECT event_id, ts, symbol, price * 1000 AS amount_usd, size >= 90 AS is_whale,
  ['to_exchange', 'from_exchange', 'wallet_to_wallet'][CAST(user_id % 3 AS INT) + 1] AS flow_direction FROM ticks""",
    "onchain_transactions": """SELECT l_orderkey || '-' || l_linenumber AS tx_id, l_shipdate AS ts, c_mktsegment AS symbol, l_extendedprice AS amount_usd, l_extendedprice >= 95000 AS is_whale,
  CASE l_returnflag WHEN 'R' THEN 'to_exchange' WHEN 'A' THEN 'from_exchange' ELSE 'wallet_to_wallet' END AS flow_direction, l_partkey, l_suppkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""",
    "news_articles": f"""SELECT doc_id AS id, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL (40 * (doc_id % 1000)) MINUTE AS ts, source AS source_name, substring(text, 1, 80) AS title, text AS content,
  sha256(trim(text, ' ')) AS url_hash, list_sort(list_distinct([{_SYMBOLS_SQL}[doc_id % 5 + 1], {_SYMBOLS_SQL}[(doc_id // 5) % 5 + 1]])) AS mentioned_coins, {_SYMBOLS_SQL}[doc_id % 5 + 1] AS primary_symbol FROM documents""",
    "trading_signals": """SELECT o_orderkey AS id, o_orderdate AS ts, c_mktsegment AS symbol, '1h' AS interval, CASE o_orderstatus WHEN 'O' THEN 'BUY' WHEN 'F' THEN 'SELL' ELSE 'HOLD' END AS signal,
  o_totalprice * 10 / 500000.0::DOUBLE AS strength, o_totalprice * 10 / 500000.0::DOUBLE / 10 AS confidence, o_totalprice AS entry_price, o_orderkey % 3 <> 0 AS is_active, o_orderdate + INTERVAL 4 HOUR AS expires_at,
  o_orderpriority AS risk_level, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END AS closed_at, (o_orderkey % 41 - 20) / 10.0::DOUBLE AS pnl_pct
  FROM orders JOIN customer ON o_custkey = c_custkey""",
    "tick_signals": "SELECT event_id AS id, ts, symbol, ['BUY', 'SELL', 'HOLD'][CAST(event_id % 3 AS INT) + 1] AS signal, size / 10.0::DOUBLE AS strength, price FROM ticks",
    "price_predictions": """SELECT o_orderkey AS id, o_orderdate AS ts, o_orderpriority AS model_name, o_totalprice AS predicted_price, o_orderstatus AS status, actual_price
  FROM orders LEFT JOIN (SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS actual_price FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
    "backtest_trades": """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_extendedprice AS DECIMAL(18, 2))) AS id, l_linestatus AS symbol, CASE l_returnflag WHEN 'R' THEN 'SELL' ELSE 'BUY' END AS side,
  o_orderdate AS entry_time, l_shipdate AS exit_time, round(l_extendedprice * round(l_discount - 0.05, 4), 6) AS pnl, round(l_discount - 0.05, 4) AS pnl_pct, abs(date_diff('second', o_orderdate, l_shipdate)) AS duration_seconds
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "equity_curve": """SELECT ts, (100000000 + sum(cents) OVER (ORDER BY ts)) / 100.0::DOUBLE AS equity
  FROM (SELECT date_trunc('hour', ts) AS ts, CAST(sum(CAST(round(price * 100) AS BIGINT) - 10000) AS BIGINT) AS cents FROM ticks GROUP BY 1)""",
    "coin_configs": "SELECT * FROM (VALUES ('click', true, 0.5::DOUBLE, 6.0::DOUBLE), ('error', true, 0.5, 6.1), ('purchase', true, 0.5, 6.2), ('signup', false, 0.5, 6.3), ('view', true, 0.5, 6.4), ('idle', true, 0.5, 6.5)) t(symbol, is_enabled, min_signal_confidence, min_signal_strength)",
    "system_metrics": "SELECT event_id, ts, 'svc' || (user_id % 4) AS service_name, price AS latency_ms FROM ticks",
}


def twin(sql: str, *names: str) -> str:
    """SQL with the named domain tables in front."""
    needed = [n for n in SQL if n in names or (n == "ticks" and any(" FROM ticks" in SQL[x] for x in names))]
    if not needed:
        return sql
    kind = "WITH RECURSIVE " if "WITH RECURSIVE" in sql else "WITH "
    own = sql.strip().removeprefix("WITH RECURSIVE").removeprefix("WITH").strip() if sql.strip().startswith("WITH") else ""
    head = kind + ",\n".join(f"{n} AS ({SQL[n]})" for n in needed)
    return f"{head},\n{own}" if own else f"{head}\n{sql.strip()}"
