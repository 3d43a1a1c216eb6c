"""Portfolio and risk metrics over trades and equity curves."""

from __future__ import annotations

from math import exp, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .rolling import longest_runs, running

#: Trading days and the yearly risk-free rate.
DAYS, RISK_FREE = 252, 0.02


def safe(value: Column, default: float = 0.0) -> Column:
    return F.coalesce(value, F.lit(default))


def run_summary(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, win share in percent, mean return, profit factor (gross profit if nothing was lost), holding time, best and worst."""
    pnl = F.col("pnl")
    won, lost = F.sum(F.when(pnl > 0, pnl).otherwise(0.0)), F.sum(F.when(pnl < 0, -pnl).otherwise(0.0))
    return trades.groupBy(*keys).agg(
        F.count("*").alias("trades"), F.count_if(pnl > 0).alias("wins"), F.round(100 * F.avg(F.when(pnl > 0, 1.0).otherwise(0.0)), 4).alias("win_rate"), F.round(F.avg("pnl_pct"), 6).alias("mean_return"),
        F.round(F.coalesce(F.try_divide(won, F.nullif(lost, F.lit(0.0))), won), 4).alias("profit_factor"), F.round(F.avg("duration_seconds"), 2).alias("mean_seconds"), F.max("pnl_pct").alias("best"), F.min("pnl_pct").alias("worst"),
    )


def ratios(trades: DataFrame, keys: list[str], value: str = "pnl_pct") -> DataFrame:
    """Sharpe, Sortino, Calmar, Omega, volatility and semi-deviation of returns; 0 where a denominator is 0 or missing."""
    r, rf = F.col(value), RISK_FREE / DAYS
    excess = r - rf
    down = F.stddev_samp(F.when(excess < 0, excess))
    sharpe = safe(F.try_divide(F.avg(excess), F.nullif(F.round(F.stddev_samp(r), 12), F.lit(0.0))) * sqrt(DAYS))
    sortino = safe(F.try_divide(F.avg(excess), F.nullif(F.round(down, 12), F.lit(0.0))) * sqrt(DAYS))
    gains, losses = F.sum(F.when(r > 0, r).otherwise(0.0)), F.sum(F.when(r < 0, -r).otherwise(0.0))
    calmar = safe(F.try_divide(F.sum(r), F.nullif(F.abs(F.least(F.min(r), F.lit(0.0))), F.lit(0.0))))
    return trades.groupBy(*keys).agg(
        F.round(sharpe, 4).alias("sharpe"), F.round(sortino, 4).alias("sortino"), F.round(calmar, 4).alias("calmar"), F.round(safe(F.try_divide(gains, F.nullif(losses, F.lit(0.0)))), 4).alias("omega"),
        F.round(safe(F.stddev_samp(r)) * sqrt(DAYS), 6).alias("volatility"), F.round(safe(F.stddev_samp(F.when(r < 0, r))), 6).alias("semi_deviation"),
    )


def var_cvar(trades: DataFrame, keys: list[str], value: str = "pnl_pct") -> DataFrame:
    """Historical value at risk at 95 and 99 %, and the mean of the worst 5 %: order statistics, not interpolated.

    Returns are counted by value first, so that what is sorted is as long as the distinct returns of a key.
    """
    counted = trades.groupBy(*keys, F.col(value).alias("r")).agg(F.count("*").alias("n"))
    w, whole = Window.partitionBy(*keys).orderBy("r"), Window.partitionBy(*keys)
    ranked = counted.withColumns({"through": F.sum("n").over(w), "total": F.sum("n").over(whole)})

    def at(p: float) -> Column:
        place = F.greatest(F.floor(F.col("total") * p).cast("long") - 1, F.lit(0))
        return F.min(F.when(F.col("through") > place, F.col("r")))

    tail = F.greatest(F.floor(F.col("total") * 0.05), F.lit(1))
    used = F.greatest(F.least(F.col("n"), tail - (F.col("through") - F.col("n"))), F.lit(0))
    return ranked.groupBy(*keys).agg(F.round(F.abs(at(0.05)), 6).alias("var_95"), F.round(F.abs(at(0.01)), 6).alias("var_99"), F.round(F.abs(F.sum(F.col("r") * used) / F.sum(used)), 6).alias("cvar_95"))


def drawdowns(curve: DataFrame, keys: list[str], ts: str = "ts", equity: str = "equity", unit: str = "week") -> DataFrame:
    """Rows with peak (so far), peak_ts (the last time that it was reached) and drawdown, the share below the peak; by blocks of a time unit, as times aren't null."""
    out = running(curve, keys, [ts], F.date_trunc(unit, ts), _top=("max", F.struct(F.col(equity).alias("e"), F.col(ts).alias("t"))))
    out = out.select(*curve.columns, F.col("_top.e").alias("peak"), F.col("_top.t").alias("peak_ts"))
    return out.withColumn("drawdown", F.coalesce(F.try_divide(F.col("peak") - F.col(equity), F.nullif("peak", F.lit(0.0))), F.lit(0.0)))


def max_drawdown(curve: DataFrame, keys: list[str], ts: str = "ts", equity: str = "equity") -> DataFrame:
    """The deepest drawdown, the first of equal ones, and the seconds from its peak to it."""
    out = drawdowns(curve, keys, ts, equity).withColumn("seconds", F.timestamp_diff("SECOND", F.col("peak_ts"), F.col(ts)))
    deepest = F.max_by(F.struct("drawdown", "seconds"), F.struct(F.col("drawdown"), -F.unix_seconds(F.col(ts).cast("timestamp"))))
    return out.groupBy(*keys).agg(deepest.alias("d")).select(*keys, F.round("d.drawdown", 6).alias("max_drawdown"), F.col("d.seconds").alias("duration_seconds"))


def drawdown_episodes(curve: DataFrame, keys: list[str], ts: str = "ts", equity: str = "equity") -> DataFrame:
    """Runs below a peak: first and last time, depth and rows."""
    block = F.date_trunc("week", ts)
    out = running(drawdowns(curve, keys, ts, equity), keys, [ts], block, _p=("lag", F.col("drawdown")))
    out = running(out, keys, [ts], block, episode=("sum", ((F.col("drawdown") > 0) & (safe(F.col("_p")) == 0)).cast("long"))).filter("drawdown > 0")
    return out.groupBy(*keys, "episode").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.round(F.max("drawdown"), 6).alias("depth"), F.count("*").alias("points"))


def streaks(trades: DataFrame, keys: list[str], order: list[str], unit: str = "week") -> DataFrame:
    """Longest runs of trades that won and that didn't, by blocks of a time unit; ``order`` begins with a time."""
    runs = longest_runs(trades, F.coalesce(F.col("pnl") > 0, F.lit(False)), keys, order, F.date_trunc(unit, order[0]))
    return runs.withColumnsRenamed({"longest_true": "longest_win", "longest_false": "longest_loss"})


def monthly_returns(curve: DataFrame, keys: list[str], ts: str = "ts", equity: str = "equity") -> DataFrame:
    month = F.date_format(ts, "yyyy-MM").alias("month")
    return curve.groupBy(*keys, month).agg(F.round(F.try_divide(F.max_by(equity, ts), F.min_by(equity, ts)) - 1, 6).alias("return"))


def return_summary(curve: DataFrame, keys: list[str], ts: str = "ts", equity: str = "equity") -> DataFrame:
    """Total and yearly return; a year has 365.25 days, and less than a day counts as one."""
    days = F.timestamp_diff("SECOND", F.min(ts), F.max(ts)) / F.lit(86400.0)
    years = F.greatest(days / 365.25, F.lit(1 / 365.25))
    total = F.try_divide(F.max_by(equity, ts), F.min_by(equity, ts)) - 1
    return curve.groupBy(*keys).agg(F.round(total, 6).alias("total_return"), F.round(F.when(total <= -1, -1.0).otherwise(F.pow(1 + total, 1 / years) - 1), 6).alias("annual_return"))


def month_report(trades: DataFrame, keys: list[str], capital: float) -> DataFrame:
    """Best and worst month by exit, their returns on ``capital`` in percent, and the deviation of monthly returns."""
    monthly = trades.groupBy(*keys, F.date_format("exit_time", "yyyy-MM").alias("month")).agg(F.round(100 * F.sum("pnl") / capital, 6).alias("r"))
    place = F.struct("r", "month")
    return monthly.groupBy(*keys).agg(F.max_by("month", place).alias("best_month"), F.max("r").alias("best_return"), F.min_by("month", place).alias("worst_month"), F.min("r").alias("worst_return"), F.round(safe(F.stddev_samp("r")), 4).alias("consistency"))


def trade_report(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and largest win and loss (a trade without gain is a loss), and trades a month in which any ended."""
    pnl, months = F.col("pnl"), F.greatest(F.count_distinct(F.date_format("exit_time", "yyyy-MM")), F.lit(1))
    win, loss = F.when(pnl > 0, pnl), F.when(pnl <= 0, pnl)
    return trades.groupBy(*keys).agg(
        F.round(safe(F.avg(win)), 4).alias("avg_win"), F.round(safe(F.avg(loss)), 4).alias("avg_loss"), safe(F.max(win)).alias("largest_win"), safe(F.min(loss)).alias("largest_loss"), F.round(F.count("*") / months, 6).alias("trades_per_month"),
    )


def recoveries(curve: DataFrame, keys: list[str], ts: str = "ts", equity: str = "equity") -> DataFrame:
    """Mean drawdown below peaks, number of recoveries, and the mean and median of the whole days that they took."""
    block = F.date_trunc("week", ts)
    rows = running(drawdowns(curve, keys, ts, equity), keys, [ts], block, _p=("lag", F.col("drawdown")))
    rows = running(rows, keys, [ts], block, _started=("max_before", F.when((F.col("drawdown") > 0) & (safe(F.col("_p")) == 0), F.col(ts))))
    days = F.when((F.col("drawdown") == 0) & (F.col("_p") > 0), F.floor(F.timestamp_diff("SECOND", F.col("_started"), F.col(ts)) / 86400))
    rows = rows.withColumn("_days", days).groupBy(*keys)
    return rows.agg(F.round(F.avg(F.when(F.col("drawdown") > 0, F.col("drawdown"))), 6).alias("mean_drawdown"), F.count("_days").alias("recoveries"), F.round(safe(F.avg("_days")), 6).alias("mean_days"), safe(F.median("_days")).alias("median_days"))


def win_loss_report(trades: DataFrame, keys: list[str]) -> DataFrame:
    """One nested ``report`` for each run: summary with its period, and the distribution of wins and losses."""
    period = F.struct(F.min("entry_time").alias("start"), F.max("exit_time").alias("end"))
    summary = F.struct(period.alias("period"), F.count("*").alias("trades"), F.round(F.avg("pnl_pct"), 6).alias("mean_return"))
    spread = F.struct(F.count_if(F.col("pnl") > 0).alias("wins"), F.count_if(F.col("pnl") <= 0).alias("losses"))
    return trades.groupBy(*keys).agg(F.struct(summary.alias("summary"), spread.alias("win_loss_distribution")).alias("report"))


def flat_metrics(curve: DataFrame, keys: list[str], periods: int = 365 * 24 * 4, ts: str = "ts", equity: str = "equity") -> DataFrame:
    """The deepest drawdown as a negative share of its peak, and the Sharpe ratio of the curve's changes."""
    rows = running(drawdowns(curve, keys, ts, equity), keys, [ts], F.date_trunc("week", ts), _before=("lag", F.col(equity)))
    rows = rows.withColumn("_r", F.try_divide(F.col(equity), F.nullif("_before", F.lit(0.0))) - 1)
    sharpe = safe(F.try_divide(F.avg("_r"), F.nullif(F.stddev_samp("_r"), F.lit(0.0))) * sqrt(periods))
    return rows.groupBy(*keys).agg(F.round(safe(-F.max("drawdown")), 6).alias("max_drawdown"), F.round(sharpe, 4).alias("sharpe"))


def expectancy(trades: DataFrame, keys: list[str]) -> DataFrame:
    pnl = F.col("pnl")
    win, loss = F.avg(F.when(pnl > 0, 1.0).otherwise(0.0)), F.avg(F.when(pnl < 0, 1.0).otherwise(0.0))
    value = win * safe(F.avg(F.when(pnl > 0, pnl))) - loss * F.abs(safe(F.avg(F.when(pnl < 0, pnl))))
    return trades.groupBy(*keys).agg(F.round(value, 4).alias("expectancy"))


def benchmark(returns: DataFrame, keys: list[str], own: str, other: str) -> DataFrame:
    """Beta, alpha, tracking error and information ratio of paired returns."""
    beta = safe(F.try_divide(F.covar_samp(own, other), F.nullif(F.var_samp(other), F.lit(0.0))))
    gap = F.col(own) - F.col(other)
    info = safe(F.try_divide(F.avg(gap), F.nullif(F.stddev_samp(gap), F.lit(0.0))))
    return returns.groupBy(*keys).agg(F.round(beta, 6).alias("beta"), F.round(F.avg(own) - beta * F.avg(other), 6).alias("alpha"), F.round(safe(F.stddev_samp(gap)), 6).alias("tracking_error"), F.round(info, 6).alias("information_ratio"))


def mean_interval(trades: DataFrame, keys: list[str], value: str = "pnl_pct", z: float = 1.96) -> DataFrame:
    error = safe(F.stddev_samp(value)) / F.sqrt(F.count(value).cast("double"))
    return trades.groupBy(*keys).agg(F.round(F.avg(value) - z * error, 6).alias("low"), F.round(F.avg(value) + z * error, 6).alias("high"), F.round(safe(F.try_divide(F.avg(value), F.nullif(error, F.lit(0.0)))), 4).alias("t_stat"))


def bootstrap(trades: DataFrame, keys: list[str], row: str, value: str = "pnl_pct", replicates: int = 200, seed: int = 7, level: float = 0.95) -> DataFrame:
    """Interval of the mean by a Poisson bootstrap: keys, mean, low, high, replicates.

    Each row stands in each replicate as often as a Poisson variable of mean 1 says, drawn by a hash of ``row`` (its unique id), the replicate and the seed: so any partitioning
    gives the same, no row is moved, and one aggregation, combined before the shuffle, has the sums of all replicates.
    """
    limits, p, whole = [], exp(-1.0), 0.0
    for k in range(10):  # beyond 9 the rest is 1e-7
        whole += p
        limits.append(whole)
        p /= k + 1

    drawn = F.pmod(F.xxhash64(F.col("_row"), F.col("replicate"), F.lit(seed)), F.lit(2**31)).cast("double") / float(2**31)
    times = F.lit(len(limits))
    for k in reversed(range(len(limits))):
        times = F.when(F.col("_drawn") < limits[k], F.lit(k)).otherwise(times)
    held = trades.filter(F.col(value).isNotNull()).select(*keys, row, F.col(value).cast("double").alias("_v"))
    each = held.select(*keys, "_v", F.col(row).cast("string").alias("_row"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    each = each.withColumn("_drawn", drawn).filter(F.col("_drawn") >= limits[0]).select(*keys, "_v", "replicate", times.alias("_n"))  # drawn once, in compiled code, not within a lambda
    means = each.groupBy(*keys, "replicate").agg((F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("m"))
    cut = means.groupBy(*keys).agg(F.percentile("m", F.lit((1 - level) / 2)).alias("low"), F.percentile("m", F.lit((1 + level) / 2)).alias("high"), F.count("*").alias("replicates"))
    return held.groupBy(*keys).agg(F.round(F.avg("_v"), 6).alias("mean")).join(cut, keys).select(*keys, "mean", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "replicates")


def confusion(rows: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    return rows.groupBy(label, predicted).agg(F.count("*").alias("n"))


def weighted_scores(rows: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1, in one row, from the confusion table."""
    cells = confusion(rows, label, predicted)
    hit = F.when(F.col(label) == F.col(predicted), F.col("n")).otherwise(0)
    by_label = cells.groupBy(F.col(label).alias("c")).agg(F.sum("n").alias("support"), F.sum(hit).alias("hits"))
    by_predicted = cells.groupBy(F.col(predicted).alias("c")).agg(F.sum("n").alias("guessed"))
    per = by_label.join(by_predicted, "c", "left").withColumns({"p": safe(F.try_divide(F.col("hits"), F.col("guessed"))), "r": F.col("hits") / F.col("support")})
    per = per.withColumn("f", safe(F.try_divide(2 * F.col("p") * F.col("r"), F.nullif(F.col("p") + F.col("r"), F.lit(0.0)))))
    mean = lambda c: F.round(F.sum(F.col(c) * F.col("support")) / F.sum("support"), 6)
    return per.agg(F.round(F.sum("hits") / F.sum("support"), 6).alias("accuracy"), mean("p").alias("precision"), mean("r").alias("recall"), mean("f").alias("f1"))
