"""Set operations, windows in event time, JSON, merges and lookups."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodemark.functions import models
from lodemark.operators import commits
from lodemark.operators import relational as rel
from lodemark.operators.crawl import crawl
from lodemark.storage import folder, shared_dir
from lodemark.streaming import jobs

from .registry import query
from .tables import candles, load, news_articles, onchain_events, sentiment_scores, tick_signals, ticks, trading_signals


@query(
    """SELECT symbol, 'both' AS part FROM (SELECT symbol FROM ticks WHERE size >= 98 AND price < 20 INTERSECT SELECT symbol FROM ticks WHERE size <= 1 AND price < 20)
    UNION ALL SELECT CAST(user_id AS VARCHAR), 'first' FROM (SELECT user_id FROM ticks WHERE symbol = 'click' EXCEPT SELECT user_id FROM ticks WHERE symbol = 'signup')""",
    "ticks",
)
def set_operations(spark, sf_dir):
    t = ticks(spark, sf_dir)
    both = t.filter("size >= 98 AND price < 20").select("symbol").intersect(t.filter("size <= 1 AND price < 20").select("symbol"))
    first = t.filter("symbol = 'click'").select("user_id").subtract(t.filter("symbol = 'signup'").select("user_id"))
    return both.select("symbol", F.lit("both").alias("part")).unionByName(first.select(F.col("user_id").cast("string").alias("symbol"), F.lit("first").alias("part")))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM ticks WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, s""",
    "ticks",
)
def session_windows(spark, sf_dir):
    w = F.session_window("ts", "6 hours")
    return ticks(spark, sf_dir).groupBy("user_id", w).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n")).drop("session_window")


@query(
    """SELECT symbol, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start, count(*) AS n FROM ticks GROUP BY 1, 2""",
    "ticks",
)
def sliding_rate(spark, sf_dir):
    w = F.window("ts", "1 hour", "30 minutes")
    return ticks(spark, sf_dir).groupBy("symbol", w).agg(F.count("*").alias("n")).select("symbol", F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT event_id, user_id FROM ticks QUALIFY count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 4 HOUR PRECEDING AND CURRENT ROW) > 2", "ticks")
def rate_limit_log(spark, sf_dir):
    """Events beyond two in four hours of a user, as a sliding log would refuse them."""
    w = Window.partitionBy("user_id").orderBy("_us").rangeBetween(-4 * 3600 * 10**6, 0)
    rows = ticks(spark, sf_dir).withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
    return rows.withColumn("_n", F.count("*").over(w)).filter("_n > 2").select("event_id", "user_id")


@query("SELECT id, risk_level, 'manual' AS close_reason, CASE WHEN pnl_pct > 0 THEN 'win' ELSE 'other' END AS bucket FROM trading_signals WHERE is_active", "trading_signals")
def json_update(spark, sf_dir):
    """Keys added to a JSON payload and read back; an old value of a new key is replaced."""
    old = F.from_json("metadata", "map<string,string>")
    new = F.create_map(F.lit("close_reason"), F.lit("manual"), F.lit("bucket"), F.when(F.get_json_object("metadata", "$.pnl_pct").cast("double") > 0, "win").otherwise("other"))
    merged = F.to_json(F.map_concat(F.map_filter(old, lambda k, v: ~k.isin("close_reason", "bucket")), new))
    rows = trading_signals(spark, sf_dir).filter("is_active").select("id", merged.alias("m"))
    return rows.select("id", *(F.get_json_object("m", f"$.{k}").alias(k) for k in ("risk_level", "close_reason", "bucket")))


@query("SELECT * FROM candles_1h", "candles_1h")
def ingest_tumbling_stream(spark, sf_dir):
    """Hourly candles by Structured Streaming over the events, all that there are: equal to the batch rollup."""
    schema = load(spark, sf_dir, "events").schema
    live = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    live = live.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("symbol"), F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("int").alias("size"))
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    jobs_stream = jobs.candle_stream(live, "1 hour").writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{at}/out"))
    jobs_stream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    """WITH d AS (SELECT ts::DATE AS d, symbol, arg_max(close, ts) AS close FROM candles_1h GROUP BY 1, 2), s AS (SELECT ts::DATE AS d, symbol, round(avg(sentiment_score), 6) AS score FROM sentiment_scores GROUP BY 1, 2), w AS (SELECT ts::DATE AS d, symbol, count(*) AS whales FROM onchain_events WHERE is_whale GROUP BY 1, 2)
    SELECT d, symbol, close, score, whales FROM d JOIN s USING (d, symbol) JOIN w USING (d, symbol)""",
    "candles_1h", "sentiment_scores", "onchain_events",
)
def three_way_merge(spark, sf_dir):
    d = F.to_date("ts").alias("d")
    prices = candles(spark, sf_dir).groupBy(d, "symbol").agg(F.max_by("close", "ts").alias("close"))
    scores = sentiment_scores(spark, sf_dir).groupBy(d, "symbol").agg(F.round(F.avg("sentiment_score"), 6).alias("score"))
    whales = onchain_events(spark, sf_dir).filter("is_whale").groupBy(d, "symbol").agg(F.count("*").alias("whales"))
    return prices.join(scores, ["d", "symbol"]).join(whales, ["d", "symbol"])


@query(
    """WITH h AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-03 23:00:00', INTERVAL 1 HOUR)) AS ts), s AS (SELECT unnest(['click', 'view']) AS symbol)
    SELECT s.symbol, h.ts, c.close FROM h CROSS JOIN s LEFT JOIN candles_1h c ON c.symbol = s.symbol AND c.ts = h.ts""",
    "candles_1h",
)
def calendar_join(spark, sf_dir):
    """Every hour of three days for two symbols, with the candle where there is one."""
    hours = spark.range(1).select(F.explode(F.expr("sequence(timestamp_ntz'2024-01-01', timestamp_ntz'2024-01-03 23:00:00', interval 1 hour)")).alias("ts"), F.array(F.lit("click"), F.lit("view")).alias("s")).select("ts", F.explode("s").alias("symbol"))
    return hours.join(candles(spark, sf_dir).select("symbol", "ts", "close"), ["symbol", "ts"], "left")


@query(
    """WITH a AS (SELECT close AS a, row_number() OVER (ORDER BY ts) AS n FROM candles_4h WHERE symbol = 'click'), b AS (SELECT close AS b, row_number() OVER (ORDER BY ts) AS n FROM candles_1d WHERE symbol = 'view') SELECT n, a, b FROM a JOIN b USING (n)""",
    "candles_4h", "candles_1d",
)
def positional_zip(spark, sf_dir):
    """Two series paired by place, as long as the shorter one. Each is one symbol's candles."""
    n = F.row_number().over(Window.partitionBy("symbol").orderBy("ts")).cast("long").alias("n")
    a = candles(spark, sf_dir, "4h").filter("symbol = 'click'").select(n, F.col("close").alias("a"))
    b = candles(spark, sf_dir, "1d").filter("symbol = 'view'").select(n, F.col("close").alias("b"))
    return a.join(b, "n")


@query("SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderkey = 77")
def point_lookup(spark, sf_dir):
    return load(spark, sf_dir, "orders").filter("o_orderkey = 77").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))


@query("SELECT id, actual_price FROM price_predictions ORDER BY actual_price DESC NULLS LAST, id LIMIT 40", "price_predictions")
def nulls_last_topk(spark, sf_dir):
    from .tables import price_predictions

    return price_predictions(spark, sf_dir).select("id", "actual_price").orderBy(F.col("actual_price").desc_nulls_last(), "id").limit(40)


@query("SELECT count(*) AS n FROM price_predictions WHERE actual_price IS NOT NULL", "price_predictions")
def drop_na(spark, sf_dir):
    """Rows without nulls in the numeric columns, which are found from the schema."""
    from .tables import price_predictions

    rows = price_predictions(spark, sf_dir)
    numeric = [f.name for f in rows.schema if isinstance(f.dataType, T.NumericType)]
    return rows.dropna(how="any", subset=numeric).agg(F.count("*").alias("n"))


@query("SELECT symbol, count(*) FILTER (pnl > 0) AS wins, count(*) AS n, arg_max(id, {p: pnl, i: id}) AS best FROM backtest_trades GROUP BY 1", "backtest_trades")
def outcome_kpis(spark, sf_dir):
    from .tables import backtest_trades

    return backtest_trades(spark, sf_dir).groupBy("symbol").agg(F.count_if(F.col("pnl") > 0).alias("wins"), F.count("*").alias("n"), F.max_by("id", F.struct("pnl", "id")).alias("best"))


@query("SELECT id, title || chr(10) || content AS queue_text, coalesce(mentioned_coins[1], 'BTC') AS coin, split_part(source_name, '.', 1) AS source FROM news_articles", "news_articles")
def queue_text(spark, sf_dir):
    first = F.coalesce(F.try_element_at("mentioned_coins", F.lit(1)), F.lit("BTC"))
    return news_articles(spark, sf_dir).select("id", F.concat_ws("\n", "title", "content").alias("queue_text"), first.alias("coin"), F.split_part("source_name", F.lit("."), F.lit(1)).alias("source"))


@query(
    """WITH d AS (SELECT symbol, ts, close - lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS d FROM candles_1d) SELECT symbol, ts, CASE WHEN d > 0 THEN 0.6::DOUBLE ELSE 0.2 END AS up, CASE WHEN d < 0 THEN 0.6::DOUBLE ELSE 0.2 END AS down, CASE WHEN d = 0 THEN 0.6::DOUBLE ELSE 0.2 END AS side FROM d""",
    "candles_1d",
)
def slope_votes(spark, sf_dir):
    d = F.col("close") - F.lag("close").over(Window.partitionBy("symbol").orderBy("ts"))
    votes = models.slope_votes(F.col("d"))
    return candles(spark, sf_dir, "1d").withColumn("d", d).select("symbol", "ts", votes["UP"].alias("up"), votes["DOWN"].alias("down"), votes["SIDEWAYS"].alias("side"))


@query(
    """SELECT o_orderpriority, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS f, round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS o, round(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 2) AS p FROM orders GROUP BY 1"""
)
def pivot_status(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.round(F.sum("o_totalprice"), 2))
    return rows.withColumnsRenamed({"F": "f", "O": "o", "P": "p"})


@query("SELECT symbol, count(*) AS n, max(ts) AS last_ts FROM tick_signals GROUP BY 1 HAVING max(ts) > TIMESTAMP '2024-01-30 12:00:00'", "tick_signals")
def changed_since(spark, sf_dir):
    """Symbols with signals newer than those last worked on."""
    rows = tick_signals(spark, sf_dir)
    seen = rows.select("symbol").distinct().withColumn("ts", F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"))
    return jobs.changed_keys(rows, seen).join(rows.groupBy("symbol").agg(F.count("*").alias("n")), "symbol")


@query("SELECT c.symbol, count(s.id) AS n FROM coin_configs c LEFT JOIN tick_signals s ON s.symbol = c.symbol AND s.strength >= c.min_signal_strength GROUP BY 1", "coin_configs", "tick_signals")
def configured_counts(spark, sf_dir):
    from .tables import coin_configs

    configs, rows = coin_configs(spark, sf_dir).alias("c"), tick_signals(spark, sf_dir).alias("s")
    joined = configs.join(rows, (F.col("c.symbol") == F.col("s.symbol")) & (F.col("s.strength") >= F.col("c.min_signal_strength")), "left")
    return joined.groupBy("c.symbol").agg(F.count("s.id").alias("n"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS status FROM orders")
def update_by_predicate(spark, sf_dir):
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("status"))


@query("SELECT o_orderkey AS id, o_custkey AS k FROM orders ORDER BY id, k LIMIT 100 OFFSET 100")
def key_page(spark, sf_dir):
    """The second page of all orders by key."""
    return rel.page(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k")), [F.col("id"), F.col("k")], 2, 100)


@query("SELECT symbol, count(*) AS n, round(avg(price), 6) AS mean FROM ticks WHERE symbol IN ('click', 'view') AND size >= 50 GROUP BY 1", "ticks")
def parameterised_sql(spark, sf_dir):
    """A bound statement over a frame."""
    text = "SELECT symbol, count(*) AS n, round(avg(price), 6) AS mean FROM {rows} WHERE array_contains(:symbols, symbol) AND size >= :least GROUP BY symbol"
    return spark.sql(text, args={"symbols": F.array(F.lit("click"), F.lit("view")), "least": 50}, rows=ticks(spark, sf_dir))


@query("SELECT * FROM (VALUES ('r_regionkey', 'int', 0), ('r_name', 'string', 1)) t(name, kind, place)")
def catalog_columns(spark, sf_dir):
    schema = load(spark, sf_dir, "region").schema
    return spark.createDataFrame([(f.name, f.dataType.simpleString(), i) for i, f in enumerate(schema)], "name string, kind string, place int")


@query("SELECT * FROM candles_1h", "candles_1h")
def incremental_refresh(spark, sf_dir):
    """Candles kept until the 15th, of which the last hours were incomplete, brought up to date from the touched hours on."""
    from lodemark.operators.rollups import candles as roll

    rows, known, again = ticks(spark, sf_dir), F.lit("2024-01-15 06:30:00").cast("timestamp_ntz"), F.lit("2024-01-15 06:00:00").cast("timestamp_ntz")
    base, delta = roll(rows.filter(F.col("ts") < known), "1 hour"), roll(rows.filter(F.col("ts") >= again), "1 hour")
    return rel.upsert(base, delta, ["symbol", "ts"])


@query("SELECT id, mentioned_coins FROM news_articles WHERE list_has_any(mentioned_coins, ['click', 'view']) AND list_has_all(mentioned_coins, ['click'])", "news_articles")
def array_containment(spark, sf_dir):
    c = F.col("mentioned_coins")
    some, needed = F.array(F.lit("click"), F.lit("view")), F.array(F.lit("click"))
    return news_articles(spark, sf_dir).filter(F.arrays_overlap(c, some) & (F.size(F.array_except(needed, c)) == 0)).select("id", "mentioned_coins")


@query("SELECT side, round(sum(pnl), 2) AS total, CASE WHEN round(sum(pnl), 2) > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS p_profit FROM backtest_trades GROUP BY 1", "backtest_trades")
def monte_carlo(spark, sf_dir):
    """Shuffling trades doesn't change their sum, so each run of the shuffle has the same total and the chance of profit is 0 or 1."""
    from .tables import backtest_trades

    return backtest_trades(spark, sf_dir).groupBy("side").agg(F.round(F.sum("pnl"), 2).alias("total")).withColumn("p_profit", F.when(F.col("total") > 0, 1.0).otherwise(0.0))


@query(
    """WITH f AS (SELECT event_id, unnest([{n: 'price', v: price - 20}, {n: 'size', v: size - 50.0::DOUBLE}, {n: 'user', v: (user_id % 9)::DOUBLE - 4}]) AS f FROM ticks),
    r AS (SELECT event_id, f.n AS n, row_number() OVER (PARTITION BY event_id ORDER BY abs(f.v) DESC, f.n) AS p FROM f) SELECT event_id, max(n) FILTER (p = 1) AS first, max(n) FILTER (p = 2) AS second FROM r GROUP BY 1""",
    "ticks",
)
def factor_breakdown(spark, sf_dir):
    """Names of the two factors of largest magnitude."""
    values = {"price": F.col("price") - 20, "size": F.col("size") - F.lit(50.0), "user": (F.col("user_id") % 9).cast("double") - 4}
    ranked = F.array_sort(F.array(*(F.struct((-F.abs(v)).alias("m"), F.lit(k).alias("n")) for k, v in values.items())))
    return ticks(spark, sf_dir).select("event_id", ranked[0]["n"].alias("first"), ranked[1]["n"].alias("second"))


@query(
    """WITH b AS (SELECT symbol, ts, close, avg(close) OVER w AS m, count(close) OVER w AS n FROM candles_1h WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 24 PRECEDING AND CURRENT ROW)) SELECT symbol, ts, CASE WHEN n = 25 THEN round(m, 6) END AS sma_20, volume IS NULL AS no_extra FROM b JOIN (SELECT symbol AS s, ts AS t, volume FROM candles_1h) v ON v.s = b.symbol AND v.t = b.ts""",
    "candles_1h",
)
def indicator_rows(spark, sf_dir):
    """Indicators in the shape of the indicator table: its own columns, and a map of the rest, without empty values."""
    from lodemark.operators.rolling import full, over

    w = over("symbol")
    rows = candles(spark, sf_dir).select("symbol", "ts", F.round(full(w, 25, F.avg, F.col("close")), 6).alias("sma_20"), F.create_map(F.lit("volume"), F.col("volume").cast("string")).alias("metadata"))
    return rows.select("symbol", "ts", "sma_20", (F.size(F.map_filter("metadata", lambda k, v: v.isNotNull())) == 0).alias("no_extra"))


@query(
    """WITH RECURSIVE h AS (SELECT regexp_extract_all(html, '<a href="([^"]*)"', 1) AS u FROM pages), l AS (SELECT DISTINCT u[1] AS src, unnest(u[2:]) AS dst FROM h),
    f AS (SELECT DISTINCT src AS url, 0 AS depth FROM l WHERE src NOT IN (SELECT dst FROM l) UNION SELECT l.dst, f.depth + 1 FROM f JOIN l ON l.src = f.url WHERE f.depth < 4) SELECT url, min(depth) AS depth FROM f GROUP BY 1""",
)
def menu_crawl(spark, sf_dir):
    """How many clicks each menu entry is away from those that no menu has: a menu's first entry is where the menu stands, and leads to the others."""
    menus = load(spark, sf_dir, "pages").select(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)).alias("u"))
    links = menus.select(F.get("u", F.lit(0)).alias("src"), F.explode(F.slice("u", 2, 2**31 - 1)).alias("dst")).distinct()
    roots = links.select(F.col("src").alias("url")).join(links.select(F.col("dst").alias("url")), "url", "left_anti")
    return crawl(links, roots, 4)


@query(
    """SELECT CASE WHEN ts < TIMESTAMP '1998-01-01' THEN 'archived' ELSE 'kept' END AS part, id, symbol, signal, CASE WHEN ts < TIMESTAMP '1998-01-01' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS archived_ts,
    CASE WHEN ts < TIMESTAMP '1998-01-01' THEN risk_level END AS risk_level, round(confidence, 9) AS confidence FROM trading_signals""",
    "trading_signals",
)
def archived_signals(spark, sf_dir):
    """Old signals leave their table and go to an archive as records, in one commit; both tables as readers see them afterwards."""
    root = folder(spark, "signals")
    commits.commit(spark, root, replace={"signals": trading_signals(spark, sf_dir)})
    record = F.struct(
        F.col("id").alias("signal_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), "symbol", "signal", F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("strength", F.lit(0.0)).alias("strength"), F.coalesce(F.from_json("metadata", "map<string, string>"), F.create_map().cast("map<string, string>")).alias("metadata"),
    )
    commits.archive(spark, root, "signals", "archive", F.col("ts") < F.lit("1998-01-01").cast("timestamp_ntz"), record)
    kept = commits.read(spark, root, "signals").select(F.lit("kept").alias("part"), "id", "symbol", "signal", F.lit(None).cast("string").alias("archived_ts"), F.lit(None).cast("string").alias("risk_level"), "confidence")
    old = commits.read(spark, root, "archive").select("record.*").select(F.lit("archived").alias("part"), F.col("signal_id").alias("id"), "symbol", "signal", F.col("ts").alias("archived_ts"), F.col("metadata")["risk_level"].alias("risk_level"), "confidence")
    return old.unionByName(kept).withColumn("confidence", F.round("confidence", 9))


@query(
    """SELECT id, closed_at IS NOT NULL AS has_outcome, CASE WHEN closed_at IS NOT NULL THEN symbol END AS outcome_symbol, strftime(closed_at, '%Y-%m-%d %H:%M:%S') AS closed_at,
    CASE WHEN closed_at IS NOT NULL THEN pnl_pct END AS pnl_pct, CAST(NULL AS DOUBLE) AS close_price FROM trading_signals""",
    "trading_signals",
)
def signal_outcomes(spark, sf_dir):
    """Signals with the nested outcome of those that were executed or closed."""
    from lodemark.functions.features import signal_outcome

    rows = trading_signals(spark, sf_dir).select("id", signal_outcome(F.col("id"), F.col("symbol"), F.col("signal"), F.col("metadata")).alias("outcome"))
    return rows.select("id", F.col("outcome").isNotNull().alias("has_outcome"), F.col("outcome.symbol").alias("outcome_symbol"), "outcome.closed_at", "outcome.pnl_pct", "outcome.close_price")


@query(
    """WITH m AS (SELECT round(avg(open), 6) AS open, round(avg(high), 6) AS high, round(avg(low), 6) AS low, round(avg(volume), 6) AS volume, round(avg(trade_count), 6) AS trade_count FROM candles_1h) UNPIVOT m ON * INTO NAME name VALUE mean""",
    "candles_1h",
)
def numeric_features(spark, sf_dir):
    """Means of the numeric columns, found from the schema, without the target, the close."""
    bars = candles(spark, sf_dir)
    names = rel.numeric_columns(bars, {"close"})
    means = bars.agg(*(F.round(F.avg(c), 6).alias(c) for c in names))
    return means.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("mean")) for c in names))).alias("m")).select("m.*")
