"""Portfolio metrics and backtests."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodemark.operators import backtest, metrics
from lodemark.storage import save

from .registry import query
from .tables import backtest_trades, candles, equity_curve, price_predictions, tick_signals

R = 0.02 / 252


def trades(spark, sf_dir):
    return backtest_trades(spark, sf_dir)


def curve(spark, sf_dir):
    return equity_curve(spark, sf_dir).withColumn("run", F.lit(1))


@query(
    """SELECT side, count(*) AS trades, count(*) FILTER (pnl > 0) AS wins, round(100 * avg(CASE WHEN pnl > 0 THEN 1.0::DOUBLE ELSE 0 END), 4) AS win_rate, round(avg(pnl_pct), 6) AS mean_return,
    round(coalesce(sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) / nullif(sum(CASE WHEN pnl < 0 THEN -pnl ELSE 0 END), 0), sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END)), 4) AS profit_factor, round(avg(duration_seconds), 2) AS mean_seconds, max(pnl_pct) AS best, min(pnl_pct) AS worst
    FROM backtest_trades GROUP BY 1""",
    "backtest_trades",
)
def trade_summary(spark, sf_dir):
    return metrics.run_summary(trades(spark, sf_dir), ["side"])


@query(
    f"""SELECT side, round(coalesce((avg(pnl_pct - {R}) / nullif(round(stddev_samp(pnl_pct), 12), 0)) * sqrt(252), 0), 4) AS sharpe,
    round(coalesce((avg(pnl_pct - {R}) / nullif(round(stddev_samp(CASE WHEN pnl_pct - {R} < 0 THEN pnl_pct - {R} END), 12), 0)) * sqrt(252), 0), 4) AS sortino, round(coalesce(sum(pnl_pct) / nullif(abs(least(min(pnl_pct), 0)), 0), 0), 4) AS calmar,
    round(coalesce(sum(CASE WHEN pnl_pct > 0 THEN pnl_pct ELSE 0 END) / nullif(sum(CASE WHEN pnl_pct < 0 THEN -pnl_pct ELSE 0 END), 0), 0), 4) AS omega, round(coalesce(stddev_samp(pnl_pct), 0) * sqrt(252), 6) AS volatility,
    round(coalesce(stddev_samp(CASE WHEN pnl_pct < 0 THEN pnl_pct END), 0), 6) AS semi_deviation FROM backtest_trades GROUP BY 1""",
    "backtest_trades",
)
def sharpe_sortino_calmar_omega(spark, sf_dir):
    return metrics.ratios(trades(spark, sf_dir), ["side"])


@query(
    """WITH r AS (SELECT side, pnl_pct AS r, row_number() OVER (PARTITION BY side ORDER BY pnl_pct) - 1 AS i, count(*) OVER (PARTITION BY side) AS n FROM backtest_trades)
    SELECT side, round(abs(min(r) FILTER (i = greatest(CAST(floor(n * 0.05) AS BIGINT) - 1, 0))), 6) AS var_95, round(abs(min(r) FILTER (i = greatest(CAST(floor(n * 0.01) AS BIGINT) - 1, 0))), 6) AS var_99,
    round(abs(avg(r) FILTER (i < greatest(floor(n * 0.05), 1))), 6) AS cvar_95 FROM r GROUP BY 1""",
    "backtest_trades",
)
def var_cvar(spark, sf_dir):
    return metrics.var_cvar(trades(spark, sf_dir), ["side"])


DD = """p AS (SELECT ts, equity, max(equity) OVER (ORDER BY ts) AS peak FROM equity_curve), q AS (SELECT *, max(CASE WHEN equity = peak THEN ts END) OVER (ORDER BY ts) AS peak_ts, coalesce((peak - equity) / nullif(peak, 0), 0) AS dd FROM p)"""


@query(f"WITH {DD} SELECT ts, equity, peak, round(dd, 6) AS drawdown FROM q", "equity_curve")
def drawdown_curve(spark, sf_dir):
    return metrics.drawdowns(curve(spark, sf_dir), ["run"]).select("ts", "equity", "peak", F.round("drawdown", 6).alias("drawdown"))


@query(f"WITH {DD} SELECT round(dd, 6) AS max_drawdown, date_diff('second', peak_ts, ts) AS duration_seconds FROM q ORDER BY dd DESC, ts LIMIT 1", "equity_curve")
def max_drawdown(spark, sf_dir):
    return metrics.max_drawdown(curve(spark, sf_dir), ["run"]).drop("run")


@query(
    f"""WITH {DD}, e AS (SELECT *, CASE WHEN dd > 0 AND coalesce(lag(dd) OVER (ORDER BY ts), 0) = 0 THEN 1 ELSE 0 END AS new FROM q), g AS (SELECT *, CAST(sum(new) OVER (ORDER BY ts) AS BIGINT) AS episode FROM e)
    SELECT episode, min(ts) AS first_ts, max(ts) AS last_ts, round(max(dd), 6) AS depth, count(*) AS points FROM g WHERE dd > 0 GROUP BY 1""",
    "equity_curve",
)
def drawdown_episodes(spark, sf_dir):
    return metrics.drawdown_episodes(curve(spark, sf_dir), ["run"]).drop("run")


@query(
    """WITH n AS (SELECT side, pnl > 0 AS won, row_number() OVER (PARTITION BY side ORDER BY exit_time, id, pnl) - row_number() OVER (PARTITION BY side, pnl > 0 ORDER BY exit_time, id, pnl) AS run FROM backtest_trades),
    r AS (SELECT side, won, run, count(*) AS n FROM n GROUP BY ALL) SELECT side, coalesce(max(n) FILTER (won), 0) AS longest_win, coalesce(max(n) FILTER (NOT won), 0) AS longest_loss FROM r GROUP BY 1""",
    "backtest_trades",
)
def streaks(spark, sf_dir):
    return metrics.streaks(trades(spark, sf_dir).select("side", "pnl", "exit_time", "id"), ["side"], ["exit_time", "id", "pnl"])


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, round(arg_max(equity, ts) / nullif(arg_min(equity, ts), 0) - 1, 6) AS return FROM equity_curve GROUP BY 1", "equity_curve")
def daily_returns(spark, sf_dir):
    c = curve(spark, sf_dir)
    return c.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.round(F.try_divide(F.max_by("equity", "ts"), F.min_by("equity", "ts")) - 1, 6).alias("return"))


@query("SELECT strftime(ts, '%Y-%m') AS month, round(arg_max(equity, ts) / nullif(arg_min(equity, ts), 0) - 1, 6) AS return FROM equity_curve GROUP BY 1", "equity_curve")
def monthly_returns(spark, sf_dir):
    return metrics.monthly_returns(curve(spark, sf_dir), ["run"]).drop("run")


@query(
    """WITH t AS (SELECT arg_max(equity, ts) / nullif(arg_min(equity, ts), 0) - 1 AS r, greatest(date_diff('second', min(ts), max(ts)) / 86400.0::DOUBLE / 365.25, 1 / 365.25) AS y FROM equity_curve)
    SELECT round(r, 6) AS total_return, round(CASE WHEN r <= -1 THEN -1.0::DOUBLE ELSE pow(1 + r, 1 / y) - 1 END, 6) AS annual_return FROM t""",
    "equity_curve",
)
def return_summary(spark, sf_dir):
    return metrics.return_summary(curve(spark, sf_dir), ["run"]).drop("run")


@query(
    """SELECT side, round(avg(CASE WHEN pnl > 0 THEN 1.0::DOUBLE ELSE 0 END) * coalesce(avg(pnl) FILTER (pnl > 0), 0) - avg(CASE WHEN pnl < 0 THEN 1.0::DOUBLE ELSE 0 END) * abs(coalesce(avg(pnl) FILTER (pnl < 0), 0)), 4) AS expectancy FROM backtest_trades GROUP BY 1""",
    "backtest_trades",
)
def expectancy(spark, sf_dir):
    return metrics.expectancy(trades(spark, sf_dir), ["side"])


@query(
    """WITH a AS (SELECT ts, close / nullif(lag(close) OVER (ORDER BY ts), 0) - 1 AS a FROM candles_4h WHERE symbol = 'click'), b AS (SELECT ts, close / nullif(lag(close) OVER (ORDER BY ts), 0) - 1 AS b FROM candles_4h WHERE symbol = 'view'),
    j AS (SELECT a, b FROM a JOIN b USING (ts) WHERE a IS NOT NULL AND b IS NOT NULL), s AS (SELECT coalesce(covar_samp(a, b) / nullif(var_samp(b), 0), 0) AS beta, avg(a) AS ma, avg(b) AS mb, coalesce(stddev_samp(a - b), 0) AS te, coalesce(avg(a - b) / nullif(stddev_samp(a - b), 0), 0) AS ir FROM j)
    SELECT round(beta, 6) AS beta, round(ma - beta * mb, 6) AS alpha, round(te, 6) AS tracking_error, round(ir, 6) AS information_ratio FROM s""",
    "candles_4h",
)
def benchmark_beta(spark, sf_dir):
    from lodemark.operators.rolling import change, over

    bars = candles(spark, sf_dir, "4h").withColumn("r", change(over("symbol"), 1, F.col("close")))
    own, other = (bars.filter(F.col("symbol") == s).select("ts", F.col("r").alias(n)) for s, n in (("click", "a"), ("view", "b")))
    return metrics.benchmark(own.join(other, "ts").dropna().withColumn("run", F.lit(1)), ["run"], "a", "b").drop("run")


@query(
    """SELECT side, round(avg(pnl_pct) - 1.96 * coalesce(stddev_samp(pnl_pct), 0) / sqrt(count(*)), 6) AS low, round(avg(pnl_pct) + 1.96 * coalesce(stddev_samp(pnl_pct), 0) / sqrt(count(*)), 6) AS high,
    round(coalesce(avg(pnl_pct) / nullif(stddev_samp(pnl_pct) / sqrt(count(*)), 0), 0), 4) AS t_stat FROM backtest_trades GROUP BY 1""",
    "backtest_trades",
)
def mean_interval(spark, sf_dir):
    return metrics.mean_interval(trades(spark, sf_dir), ["side"])


@query(
    f"""WITH s AS (SELECT symbol || '-' || side AS strategy, round((avg(pnl_pct - {R}) / nullif(round(stddev_samp(pnl_pct), 12), 0)) * sqrt(252), 4) AS sharpe, round(sum(pnl_pct), 6) AS total FROM backtest_trades GROUP BY 1)
    SELECT strategy, sharpe, total, rank() OVER (ORDER BY sharpe DESC, total DESC, strategy) AS place FROM s""",
    "backtest_trades",
)
def strategy_ranking(spark, sf_dir):
    from pyspark.sql.window import Window

    rows = trades(spark, sf_dir).withColumn("strategy", F.concat_ws("-", "symbol", "side"))
    out = metrics.ratios(rows, ["strategy"]).select("strategy", "sharpe").join(rows.groupBy("strategy").agg(F.round(F.sum("pnl_pct"), 6).alias("total")), "strategy")
    return out.withColumn("place", F.rank().over(Window.orderBy(F.desc("sharpe"), F.desc("total"), "strategy")).cast("long"))


LABELLED = """l AS (SELECT id, CASE WHEN actual_price > predicted_price THEN 'UP' WHEN actual_price < predicted_price THEN 'DOWN' ELSE 'SIDEWAYS' END AS label, CASE status WHEN 'O' THEN 'UP' WHEN 'F' THEN 'DOWN' ELSE 'SIDEWAYS' END AS predicted
FROM price_predictions WHERE actual_price IS NOT NULL)"""


def labelled(spark, sf_dir):
    p, a = F.col("predicted_price"), F.col("actual_price")
    rows = price_predictions(spark, sf_dir).filter("actual_price IS NOT NULL")
    return rows.select("id", F.when(a > p, "UP").when(a < p, "DOWN").otherwise("SIDEWAYS").alias("label"), F.when(F.col("status") == "O", "UP").when(F.col("status") == "F", "DOWN").otherwise("SIDEWAYS").alias("predicted"))


@query(f"WITH {LABELLED} SELECT label, predicted, count(*) AS n FROM l GROUP BY 1, 2", "price_predictions")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(labelled(spark, sf_dir))


@query(
    f"""WITH {LABELLED}, c AS (SELECT label AS c, count(*) AS s, count(*) FILTER (label = predicted) AS h FROM l GROUP BY 1), g AS (SELECT predicted AS c, count(*) AS g FROM l GROUP BY 1),
    p AS (SELECT s, h, coalesce(h / nullif(g, 0)::DOUBLE, 0) AS p, h / s::DOUBLE AS r FROM c LEFT JOIN g USING (c))
    SELECT round(sum(h) / sum(s)::DOUBLE, 6) AS accuracy, round(sum(p * s) / sum(s), 6) AS precision, round(sum(r * s) / sum(s), 6) AS recall, round(sum(coalesce(2 * p * r / nullif(p + r, 0), 0) * s) / sum(s), 6) AS f1 FROM p""",
    "price_predictions",
)
def weighted_prf(spark, sf_dir):
    return metrics.weighted_scores(labelled(spark, sf_dir))


@query(
    """SELECT model_name, count(actual_price) AS evaluated, round(avg(abs(predicted_price - actual_price)), 4) AS mae, round(avg(abs(predicted_price - actual_price) / nullif(actual_price, 0)), 6) AS mape, max(ts) AS last_ts
    FROM price_predictions GROUP BY 1""",
    "price_predictions",
)
def model_performance(spark, sf_dir):
    error = F.abs(F.col("predicted_price") - F.col("actual_price"))
    return price_predictions(spark, sf_dir).groupBy("model_name").agg(F.count("actual_price").alias("evaluated"), F.round(F.avg(error), 4).alias("mae"), F.round(F.avg(F.try_divide(error, F.nullif("actual_price", F.lit(0.0)))), 6).alias("mape"), F.max("ts").alias("last_ts"))


@query(
    """WITH m AS (SELECT model_name, CASE WHEN status = 'O' THEN 1 ELSE -1 END AS hit FROM price_predictions WHERE actual_price IS NOT NULL)
    SELECT model_name, round(coalesce(sum(hit) FILTER (hit > 0) / nullif(-sum(hit) FILTER (hit < 0), 0)::DOUBLE, 0), 6) AS profit_factor, round(coalesce(avg(hit) / nullif(stddev_pop(hit), 0), 0), 6) AS sharpe FROM m GROUP BY 1""",
    "price_predictions",
)
def hit_metrics(spark, sf_dir):
    rows = price_predictions(spark, sf_dir).filter("actual_price IS NOT NULL").withColumn("hit", F.when(F.col("status") == "O", 1).otherwise(-1))
    hits, misses = F.sum(F.when(F.col("hit") > 0, 1)), F.sum(F.when(F.col("hit") < 0, 1))
    return rows.groupBy("model_name").agg(F.round(metrics.safe(F.try_divide(hits, misses)), 6).alias("profit_factor"), F.round(metrics.safe(F.try_divide(F.avg("hit"), F.nullif(F.stddev_pop("hit"), F.lit(0.0)))), 6).alias("sharpe"))


@query(
    """WITH RECURSIVE s AS (SELECT symbol, date_trunc('hour', ts) AS ts, signal AS side, id FROM tick_signals), k AS (SELECT symbol, ts, arg_min(side, id) AS side FROM s GROUP BY 1, 2),
    r AS (SELECT c.symbol, c.ts, c.close, k.side, row_number() OVER (PARTITION BY c.symbol ORDER BY c.ts) AS n FROM candles_1h c LEFT JOIN k USING (symbol, ts)),
    e AS (SELECT symbol, ts, close, side, n, 1.0::DOUBLE AS equity, CASE WHEN side = 'BUY' THEN true ELSE false END AS held FROM r WHERE n = 1
      UNION ALL SELECT r.symbol, r.ts, r.close, r.side, r.n, CASE WHEN e.held THEN e.equity * r.close / e.close ELSE e.equity END, CASE r.side WHEN 'BUY' THEN true WHEN 'SELL' THEN false ELSE e.held END FROM e JOIN r ON r.symbol = e.symbol AND r.n = e.n + 1)
    SELECT symbol, ts, close, side, round(equity, 6) AS equity FROM e""",
    "tick_signals", "candles_1h",
)
def flat_backtest(spark, sf_dir):
    signals = tick_signals(spark, sf_dir).groupBy("symbol", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.min_by("signal", "id").alias("side"))
    return backtest.flat_backtest(candles(spark, sf_dir).select("symbol", "ts", "close"), signals, ["symbol"])


@query()
def bootstrap_interval(spark, sf_dir):
    """Interval of each side's mean return from 100 replicates; checked against a plain bootstrap and another partitioning in the tests."""
    return metrics.bootstrap(trades(spark, sf_dir), ["side"], "id", replicates=100)


GRID = [(i, t, s) for i, (t, s) in enumerate((t, s) for t in (0.01, 0.02, 0.05) for s in (0.01, 0.015, 0.03))]


@query(
    f"""WITH g AS (SELECT * FROM (VALUES {", ".join(f"({i}, {t}::DOUBLE, {s}::DOUBLE)" for i, t, s in GRID)}) g(run_id, take, stop)),
    b AS (SELECT s.id, s.symbol, s.ts, s.signal, s.strength, c.ts AS b_ts, c.close AS b FROM tick_signals s ASOF LEFT JOIN candles_1h c ON s.symbol = c.symbol AND s.ts >= c.ts WHERE s.signal IN ('BUY', 'SELL')),
    n AS (SELECT b.*, c.ts AS f_ts, c.close AS f FROM b ASOF LEFT JOIN candles_1h c ON b.symbol = c.symbol AND b.ts < c.ts),
    p AS (SELECT id, symbol, ts, CASE signal WHEN 'BUY' THEN 1 ELSE -1 END AS up, CASE WHEN b_ts IS NOT NULL AND (f_ts IS NULL OR ts - b_ts <= f_ts - ts) THEN b ELSE f END AS price FROM n),
    w AS (SELECT symbol, max(ts) AS fin FROM candles_1h GROUP BY 1),
    m AS (SELECT p.*, w.fin >= p.ts + INTERVAL 24 HOUR AS over, c.ts AS then_ts, p.up * (c.close / p.price - 1) AS move FROM p JOIN w USING (symbol) LEFT JOIN candles_1h c ON c.symbol = p.symbol AND c.ts BETWEEN p.ts + INTERVAL 1 SECOND AND p.ts + INTERVAL 24 HOUR WHERE p.price > 0),
    e AS (SELECT run_id, id, min(then_ts) FILTER (move >= take OR move <= -stop) AS hit, arg_min(move >= take, then_ts) FILTER (move >= take OR move <= -stop) AS won, max(then_ts) FILTER (over) AS last FROM m, g GROUP BY 1, 2)
    SELECT run_id, CASE WHEN coalesce(hit, last) IS NULL THEN 'open' WHEN hit IS NULL THEN 'timeout' WHEN won THEN 'take_profit' ELSE 'stop_loss' END AS reason, count(*) AS n, CAST(sum(epoch(coalesce(hit, last))) AS BIGINT) AS seconds FROM e GROUP BY 1, 2""",
    "tick_signals", "candles_1h",
)
def backtest_exits(spark, sf_dir):
    """How the positions of nine runs end: their number, and the sum of their exit times, by run and reason."""
    rows = backtest.positions(tick_signals(spark, sf_dir), candles(spark, sf_dir), GRID)
    return rows.groupBy("run_id", "reason").agg(F.count("*").alias("n"), F.sum(F.unix_seconds(F.col("exit_time").cast("timestamp"))).alias("seconds"))


def grid_flow(spark, sf_dir):
    return backtest.cash_flow(backtest.positions(tick_signals(spark, sf_dir), candles(spark, sf_dir), GRID))


@query()
def backtest_grid(spark, sf_dir):
    """Nine runs over all tick signals; checked against a plain loop in the tests."""
    return backtest.run_results(grid_flow(spark, sf_dir))


@query()
def backtest_equity(spark, sf_dir):
    """Equity of each run at the end of each day; checked with ``backtest_grid``."""
    rows = grid_flow(spark, sf_dir).groupBy("run_id", F.to_date("ts").alias("day"))
    return rows.agg(F.round(F.max_by("equity", F.struct("ts", "opens", "id")), 4).alias("equity"), F.count_if(~F.col("opens")).alias("trades"))


@query()
def backtest_marked(spark, sf_dir):
    """Equity at market of each run at the end of each day; checked against a plain loop in the tests."""
    bars = candles(spark, sf_dir).select("symbol", "ts", "close")
    taken = save(backtest.positions(tick_signals(spark, sf_dir), bars, GRID), "positions")  # read by the cash and by what it is worth
    marked = backtest.marked_equity(taken, backtest.cash_flow(taken), bars)
    return marked.groupBy("run_id", F.to_date("ts").alias("day")).agg(F.round(F.max_by("equity", "ts"), 4).alias("equity"), F.round(F.max_by("marked", "ts"), 4).alias("marked"))
