"""Backtests. What a position gains doesn't depend on cash: exits of all positions of all runs are found in parallel, by key and time bin. Only then is
the cash that a run's positions share followed through their openings and closings, one after another, with the open positions alone in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodemark.storage import save

from .rolling import running
from .temporal import gathered, nearest_join

#: Slippage and fee of each leg, hours until a position times out, share of cash for one position, and the cash at the start.
SLIPPAGE, FEE, TIMEOUT_HOURS, ALLOCATION, CAPITAL = 0.0005, 0.001, 24, 0.2, 10_000.0

#: Tasks over which runs are dealt by hash; many, so that few runs share one.
TASKS = 128


def positions(signals: DataFrame, bars: DataFrame, grid: list[tuple[int, float, float]]) -> DataFrame:
    """run_id, id, symbol, side, entry_time, entry, units, share, exit_time, exit_price, reason, back for each BUY or SELL of ``signals`` and each run.

    ``signals``: id (unique), symbol, ts, signal, strength. ``bars``: symbol, ts, close. ``grid``: a stated list of runs (run_id, take, stop). A position is entered at the nearest
    bar's close and left at the first later bar at which it is up by ``take`` or down by ``stop``, else at the last one within ``TIMEOUT_HOURS``. It stays open
    if nothing hits before the bars of its symbol end, earlier than its timeout. ``share``: of the cash that goes in; ``units``: what a unit of cash buys; ``back``: what comes back for each unit of cash, after slippage and fees. Signals without a positive price are left out.
    """
    closes = save(bars.select("symbol", "ts", "close"), "closes")  # read four times
    traded = signals.filter(F.col("signal").isin("BUY", "SELL")).select("id", "symbol", "ts", "signal", "strength").distinct()
    priced = nearest_join(traded, closes, ["symbol"]).filter("r_close > 0").select(*traded.columns, F.col("r_close").alias("price"))
    ends = closes.groupBy("symbol").agg(F.max("ts").alias("_end"))
    priced = priced.join(ends, "symbol").select(*priced.columns, (F.col("_end") >= F.col("ts") + F.make_dt_interval(hours=F.lit(TIMEOUT_HOURS))).alias("_over"))
    rows = gathered(priced, closes, ["symbol"], F.col("ts") + F.expr("INTERVAL 1 SECOND"), F.col("ts") + F.make_dt_interval(hours=F.lit(TIMEOUT_HOURS)), TIMEOUT_HOURS * 3600, "_later")  # as many as bars until the timeout
    up = F.when(F.col("signal") == "BUY", F.lit(1)).otherwise(F.lit(-1))
    rows = rows.withColumn("_moves", F.transform("_later", lambda b: F.struct(b["ts"].alias("ts"), b["close"].alias("close"), (up * (b["close"] / F.col("price") - 1)).alias("move"))))
    above = lambda x: F.get(F.filter("_moves", lambda m: m["move"] >= x), F.lit(0))
    below = lambda x: F.get(F.filter("_moves", lambda m: m["move"] <= -x), F.lit(0))
    takes, stops = (sorted({g[k] for g in grid}) for k in (1, 2))  # a run's first hit is the earlier of its target's and its stop's, which runs share
    rows = rows.withColumns({"_takes": F.array(*map(above, takes)), "_stops": F.array(*map(below, stops)), "_last": F.when(F.col("_over"), F.try_element_at("_moves", F.lit(-1)))})
    runs = [F.struct(F.lit(i).cast("long").alias("run_id"), F.lit(t).alias("take"), F.least(F.col("_takes")[takes.index(t)], F.col("_stops")[stops.index(s)]).alias("_hit")) for i, t, s in grid]
    rows = rows.select("id", "symbol", "ts", "signal", "strength", "price", "_last", F.explode(F.array(*runs)).alias("_run")).select("*", "_run.*").withColumn("_out", F.coalesce("_hit", "_last"))
    reason = F.when(F.col("_out").isNull(), "open").when(F.col("_hit").isNull(), "timeout").when(F.col("_hit.move") >= F.col("take"), "take_profit").otherwise("stop_loss")
    entry, left = F.col("price") * (1 + up * SLIPPAGE), F.col("_out.close") * (1 - up * SLIPPAGE)
    back = (entry + up * (left - entry) - (entry + left) * FEE) / (F.col("price") * (1 + SLIPPAGE))
    share = ALLOCATION * F.least(F.lit(1.0), F.greatest(F.lit(0.1), F.col("strength") / 10))
    return rows.select("run_id", "id", "symbol", F.col("signal").alias("side"), F.col("ts").alias("entry_time"), entry.alias("entry"), (1 / (F.col("price") * (1 + SLIPPAGE))).alias("units"), share.alias("share"), F.col("_out.ts").alias("exit_time"), left.alias("exit_price"), reason.alias("reason"), back.alias("back"))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs_met, run, cash, held, put = {}, None, CAPITAL, 0.0, {}  # runs of one task may take turns
    for batch in batches:
        runs, opens, ids, parts = (batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("run_id", "opens", "id", "part"))
        kept, out = [], []
        for at, (r, opening, i, part) in enumerate(zip(runs, opens, ids, parts, strict=True)):
            if r != run:
                runs_met[run] = cash, held, put
                run, (cash, held, put) = r, runs_met.get(r) or (CAPITAL, 0.0, {})
            if opening:
                if cash <= 0:
                    continue
                amount, gain = cash * part, 0.0
                put[i] = amount
                cash, held = cash - amount, held + amount
            elif i not in put:
                continue
            else:
                amount = put.pop(i)
                gain = amount * (part - 1)
                cash, held = cash + amount * part, held - amount
            kept.append(at)
            out += amount, gain, cash, cash + held
        same = batch.select(["run_id", "id", "ts", "opens"])
        if len(kept) < batch.num_rows:
            same = same.take(pa.array(kept, pa.int64()))
        values = np.array(out, np.float64).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays([*same.columns, *(pa.array(values[:, k]) for k in range(4))], ["run_id", "id", "ts", "opens", "amount", "pnl", "cash", "equity"])


def cash_flow(taken: DataFrame) -> DataFrame:
    """run_id, id, ts, opens, amount, pnl, cash, equity for each opening and closing of ``positions``, in order of time, closings first, then of id.

    Equity counts open positions at cost (``marked_equity`` has it at market); without cash, nothing is opened. A run is a sequence, as its cash is shared; its rows stream through one task.
    """
    enters = F.struct(F.col("entry_time").alias("ts"), F.lit(True).alias("opens"), F.col("share").alias("part"))
    leaves = F.struct(F.col("exit_time").alias("ts"), F.lit(False).alias("opens"), F.col("back").alias("part"))
    steps = taken.select("run_id", "id", F.explode(F.when(F.col("exit_time").isNotNull(), F.array(enters, leaves)).otherwise(F.array(enters))).alias("_s")).select("run_id", "id", "_s.*")
    order = ["ts", "opens", "id"]  # time first, as rows that differ in it are sorted fastest
    schema = f"run_id long, id {dict(taken.dtypes)['id']}, ts {dict(taken.dtypes)['entry_time']}, opens boolean, amount double, pnl double, cash double, equity double"
    return steps.repartition(TASKS, "run_id").sortWithinPartitions(*order).mapInArrow(_fold, schema)


def marked_equity(taken: DataFrame, flow: DataFrame, bars: DataFrame, unit: str = "day") -> DataFrame:
    """run_id, ts, cash, marked, equity at each time at which a run's positions or the price of one of its symbols change.

    ``marked`` values what is open, long or short, at the last close of its symbol at or before that time. Openings and closings are signed quantities by run and symbol; running sums over them
    and running closes give the value of each symbol, whose changes are summed by run. All are scans in two levels by a time ``unit``, so no task has a whole run or symbol.
    """
    taken, flow = save(taken.select("run_id", "id", "symbol", "units"), "taken"), save(flow, "flow")  # each is read more than once
    block, change = F.date_trunc(unit, "ts"), F.when(F.col("opens"), F.col("stake")).otherwise(-F.col("stake")) * F.col("units")
    traded = flow.select("run_id", "id", "ts", "opens", F.col("amount").alias("stake"))
    moves = traded.join(taken, ["run_id", "id"]).groupBy("run_id", "symbol", "ts").agg(F.sum(change).alias("quantity"))
    held = moves.select("run_id", "symbol").distinct()  # a row for each run and symbol
    closes = bars.groupBy("symbol", "ts").agg(F.max("close").alias("close")).join(F.broadcast(held), "symbol")
    both = moves.join(closes, ["run_id", "symbol", "ts"], "full")
    known = running(both, ["run_id", "symbol"], ["ts"], block, units=("sum", F.coalesce("quantity", F.lit(0.0))), price=("last", F.col("close")))
    valued = known.withColumn("value", F.coalesce(F.col("units") * F.col("price"), F.lit(0.0)))
    steps = running(valued, ["run_id", "symbol"], ["ts"], block, before=("lag", F.col("value")))
    steps = steps.groupBy("run_id", "ts").agg(F.sum(F.col("value") - F.coalesce("before", F.lit(0.0))).alias("step"))
    cash = flow.groupBy("run_id", "ts").agg(F.max_by("cash", F.struct("opens", "id")).alias("after"))
    times = steps.join(cash, ["run_id", "ts"], "full")
    out = running(times, ["run_id"], ["ts"], block, marked=("sum", F.coalesce("step", F.lit(0.0))), cash=("last", F.col("after")))
    cash = F.coalesce("cash", F.lit(CAPITAL))
    return out.select("run_id", "ts", cash.alias("cash"), "marked", (cash + F.col("marked")).alias("equity"))


def run_results(flow: DataFrame) -> DataFrame:
    """One row for each run: trades, wins, equity and total return at its end."""
    last = F.max_by("equity", F.struct("ts", "opens", "id"))
    out = flow.groupBy("run_id").agg(F.count_if(~F.col("opens")).alias("trades"), F.count_if(~F.col("opens") & (F.col("pnl") > 0)).alias("wins"), F.round(last, 4).alias("equity"))
    return out.withColumn("total_return", F.round(F.col("equity") / CAPITAL - 1, 6))


def flat_backtest(prices: DataFrame, signals: DataFrame, keys: list[str]) -> DataFrame:
    """All in at a BUY, all out at a SELL: equity by row of ``prices`` (keys, ts, close), ``signals`` (keys, ts, side).

    Only signals that change the position count: a BUY after a SELL or at the start, a SELL after a BUY. Equity is the product of
    the moves of the bars at which something was held.
    """
    w = Window.partitionBy(*keys).orderBy("ts")
    rows = prices.join(signals, [*keys, "ts"], "left")
    rows = rows.withColumn("_side", F.last(F.when(F.col("side").isin("BUY", "SELL"), F.col("side")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    move = F.when(F.col("_side") == "BUY", F.col("close") / F.lag("close").over(w)).otherwise(F.lit(1.0))
    rows = rows.withColumn("_move", F.ln(F.coalesce(move, F.lit(1.0))))
    return rows.select(*keys, "ts", "close", "side", F.round(F.exp(F.sum("_move").over(w.rowsBetween(Window.unboundedPreceding, 0))), 6).alias("equity"))
