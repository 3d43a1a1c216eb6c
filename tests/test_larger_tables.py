"""What kept queries from ending over larger tables, and that the ways around it give the same."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lodemark.operators import backtest, signals, temporal
from lodemark.operators.rolling import trailing_count
from lodemark.plans import risk
from lodemark.plans.tables import candles, tick_signals
from lodemark.queries import QUERIES

T0 = dt.datetime(2024, 1, 1)


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_whale_transfers_has_no_frame_to_the_end(spark, data):
    """Such a frame is gone through anew for each row: 83 s over sf0.1, where a symbol has two bins."""
    assert "unboundedfollowing" not in planned(QUERIES["whale_transfers"](spark, data)).lower()


def test_nearest_of_many_in_one_bin(spark):
    """Against all pairs, with equal times on both sides, null times and keys without a partner, in one bin and in many."""
    rng = random.Random(3)
    at = lambda: T0 + dt.timedelta(seconds=rng.randrange(0, 40_000, 20))
    right = [(k, t, float(i)) for k in "AB" for i, t in enumerate(sorted({at() for _ in range(150)}))] + [("A", None, -1.0)]
    left = [(i, rng.choice("ABC"), at() if i % 50 else None) for i in range(600)]
    r = spark.createDataFrame(right, "k string, ts timestamp_ntz, v double")
    rows = spark.createDataFrame(left, "id int, k string, ts timestamp_ntz")
    near, ahead = {}, {}
    for i, k, t in left:
        found = [(abs(u - t), u, v) for x, u, v in right if x == k and u and t]
        near[i] = min(found)[2] if found else None
        after = [(u, v) for x, u, v in right if x == k and u and t and u >= t]
        ahead[i] = min(after)[1] if after else None
    for seconds in (600, 30 * 86400):
        assert {x.id: x.r_v for x in temporal.nearest_join(rows, r, ["k"], bin_seconds=seconds).collect()} == near
        assert {x.id: x.r_v for x in temporal.asof_join(rows, r, ["k"], direction="forward", bin_seconds=seconds).collect()} == ahead


def test_nearest_price_has_no_frame_to_the_end(spark, data):
    out = QUERIES["nearest_price"](spark, data)
    assert "unboundedfollowing" not in planned(out).lower()
    assert out.filter(F.col("price").isNull()).count() == 0


def test_error_rate_alert_has_no_sliding_frame(spark, data):
    """A sliding frame is gone through anew for each row, and four services were four tasks."""
    assert "rangeframe, -" not in planned(QUERIES["error_rate_alert"](spark, data)).lower()


def test_trailing_count_equals_a_loop(spark):
    """With equal times, rows just in and just out of reach, null times and null keys, in blocks shorter and longer than the reach."""
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", None]), T0 + dt.timedelta(seconds=rng.randrange(0, 20_000, 50), microseconds=rng.choice([0, 0, 1])) if i % 40 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, k string, ts timestamp_ntz")
    reach = dt.timedelta(seconds=1000)
    want = {i: sum(x == k and (u is None if t is None else u is not None and t - reach <= u <= t) for _, x, u in rows) for i, k, t in rows}
    for seconds in (100, 3600, 10**6):
        assert {r.id: r.recent for r in trailing_count(df, ["k"], 1000, block_seconds=seconds).collect()} == want


def test_gathered_equals_all_pairs(spark, monkeypatch):
    """With null keys and times, equal times, keys without a partner, and left rows twice; broadcast and shuffled."""
    rng = random.Random(6)
    at = lambda i: T0 + dt.timedelta(seconds=rng.randrange(0, 40_000, 100)) if i % 30 else None
    right = [(rng.choice(["a", "b", None]), at(i), float(i)) for i in range(1, 200)]
    left = [(i // 2, rng.choice(["a", "b", "c", None]), at(i)) for i in range(300)]
    rows, r = spark.createDataFrame(left, "id int, k string, ts timestamp_ntz"), spark.createDataFrame(right, "k string, ts timestamp_ntz, v double")
    hour = dt.timedelta(hours=1)
    want = [(i, k, t, sorted((u, v) for x, u, v in right if x == k and u and t <= u <= t + hour)) for i, k, t in left if t]
    for most in (2_000_000, 0):
        monkeypatch.setattr(temporal, "GATHERED", most)
        got = temporal.gathered(rows, r, ["k"], F.col("ts"), F.col("ts") + F.expr("INTERVAL 1 HOUR"), 3600, "near").collect()
        assert sorted(((x.id, x.k, x.ts, [tuple(y) for y in x.near]) for x in got if x.ts), key=repr) == sorted(want, key=repr)
        assert len(got) == len(left) and all(x.near == [] for x in got if not x.ts)


def test_signals_are_not_multiplied_by_their_bars(spark, data):
    """Both had a row for each signal and bar within a day, grouped by all columns again."""
    bars = candles(spark, data)
    for out in (signals.lifecycle(tick_signals(spark, data), bars), backtest.positions(tick_signals(spark, data), bars, risk.GRID)):
        assert "_r_ts" not in planned(out) and "collect_list" not in planned(out)


def test_lifecycle_equals_a_loop(spark):
    """Prices below zero, of zero and null, HOLD, null closes, repeated rows, null times and symbols."""
    rng = random.Random(7)
    bars = [(k, T0 + dt.timedelta(hours=h), rng.choice([90.0, 99.0, 100.0, 101.9, 103.0, -100.0, None])) for k in ("a", None) for h in range(60)]
    rows = [(i, rng.choice(["a", "b", None]), T0 + dt.timedelta(minutes=rng.randrange(-60, 4000)) if i % 20 else None, rng.choice(["BUY", "SELL", "HOLD"]), rng.choice([100.0, 100.0, -100.0, 0.0, None])) for i in range(300)]
    df = spark.createDataFrame(rows + rows[:30], "id int, symbol string, ts timestamp_ntz, signal string, price double")
    got = {r.id: (r.reason, r.closed_at) for r in signals.lifecycle(df, spark.createDataFrame(bars, "symbol string, ts timestamp_ntz, close double")).collect()}
    for i, k, t, side, price in rows:
        end = "open", None
        for _, u, c in sorted((b for b in bars if b[0] == k and t and t + dt.timedelta(seconds=1) <= b[1] <= t + dt.timedelta(hours=24)), key=lambda b: b[1]):
            end = "timeout", u
            if price is None or c is None or side == "HOLD":
                continue
            won, lost = (c >= price * 1.02, c <= price * 0.985) if side == "BUY" else (c <= price * 0.98, c >= price * 1.015)
            if won or lost:
                end = "take_profit" if won else "stop_loss", u
                break
        assert got[i] == end, (i, k, t, side, price)


def test_both_legs_come_from_one_plan_of_positions(spark, data):
    """Openings and closings each had the whole search of exits."""
    taken = backtest.positions(tick_signals(spark, data), candles(spark, data), risk.GRID)
    assert planned(backtest.cash_flow(taken)).count("Window [") == planned(taken).count("Window [") > 0


def test_marked_finds_its_positions_once(spark, data, monkeypatch):
    """The cash and what it is worth each had the whole search of exits; now both read the table that this has written."""
    read, real = [], backtest.cash_flow
    monkeypatch.setattr(backtest, "cash_flow", lambda taken: read.append(taken) or real(taken))
    QUERIES["backtest_marked"](spark, data)
    assert "Window" not in planned(read[0])


def test_bootstrap_draws_once_in_compiled_code(spark, data):
    """A lambda, which isn't compiled, had the hash of each row and replicate ten times."""
    plan = planned(QUERIES["bootstrap_interval"](spark, data))
    assert "lambdafunction" not in plan and plan.count("xxhash64(") <= 2  # for the filter and for the number
