"""Operators against plain Python on small inputs."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodemark.functions import indicators, text
from lodemark.operators import backtest, metrics, neardup, relational, rollups, signals, temporal
from lodemark.operators.rolling import ema, over, percent_rank
from lodemark.plans import risk

T0 = dt.datetime(2024, 1, 1)


def at(m):
    return T0 + dt.timedelta(minutes=m)


@pytest.fixture(scope="module")
def bars(spark):
    rng = random.Random(5)
    rows, price = [], 100.0
    for i in range(260):
        price *= 1 + rng.uniform(-0.02, 0.02)
        rows.append(("A", at(15 * i), price, price * 1.01, price * 0.99, price * (1 + rng.uniform(-0.005, 0.005)), rng.randrange(0, 50)))
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume long")


def test_ema_equals_pandas(bars):
    got = ema(bars, {"e9": ("close", 9), "e200": ("close", 200)}, ["symbol"]).orderBy("ts").toPandas()
    for n, c in ((9, "e9"), (200, "e200")):
        np.testing.assert_allclose(got[c], got["close"].ewm(span=n, adjust=False).mean(), rtol=1e-9)


def test_macd_and_rank_equal_pandas(bars):
    got = indicators.with_macd(bars).withColumn("r", percent_rank(over("symbol"), 100, F.col("close"))).orderBy("ts").toPandas()
    macd = got["close"].ewm(span=12, adjust=False).mean() - got["close"].ewm(span=26, adjust=False).mean()
    np.testing.assert_allclose(got["macd_signal"], macd.ewm(span=9, adjust=False).mean(), atol=1e-9)
    np.testing.assert_allclose(got["r"].to_numpy(float), got["close"].rolling(100).rank(pct=True).to_numpy(), equal_nan=True)


def test_asof_forms(spark):
    left = spark.createDataFrame([("A", 1, at(10)), ("A", 2, at(20)), ("A", 3, at(0)), ("B", 4, at(5))], "k string, id int, ts timestamp_ntz")
    right = spark.createDataFrame([("A", at(10), 1.0), ("A", at(19), 2.0), ("A", at(30), 3.0)], "k string, ts timestamp_ntz, v double")
    find = lambda **a: {r.id: r.r_v for r in temporal.asof_join(left, right, ["k"], **a).collect()}
    assert find() == {1: 1.0, 2: 2.0, 3: None, 4: None}
    assert find(exact=False) == {1: None, 2: 2.0, 3: None, 4: None}
    assert find(direction="forward") == {1: 1.0, 2: 3.0, 3: 1.0, 4: None}
    assert find(direction="forward", exact=False) == {1: 2.0, 2: 3.0, 3: 1.0, 4: None}
    assert {r.id: r.r_v for r in temporal.nearest_join(left, right, ["k"]).collect()} == {1: 1.0, 2: 2.0, 3: 1.0, 4: None}


def test_hand_computed_cases(spark):
    prices = spark.createDataFrame([("A", at(0), 100.0), ("A", at(1), 102.0), ("A", at(2), 101.0)], "symbol string, ts timestamp_ntz, close double")
    sides = spark.createDataFrame([("A", at(0), "BUY"), ("A", at(2), "SELL")], "symbol string, ts timestamp_ntz, side string")
    curve = [r.equity for r in backtest.flat_backtest(prices, sides, ["symbol"]).orderBy("ts").collect()]
    assert curve == [1.0, 1.02, 1.01]
    scores = spark.createDataFrame([("A", at(55), 0.7, 0.8, 1.0), ("A", at(5), 0.4, 0.9, 1.2)], "symbol string, ts timestamp_ntz, sentiment_score double, confidence double, volume_weight double")
    got = rollups.decayed_flat(scores, F.lit(at(60)).cast("timestamp_ntz"), {"24h": 86400}).first().score
    assert abs(got - 0.53016) < 1e-5


def test_drawdown_and_streaks(spark):
    eq = spark.createDataFrame([(1, at(i), v) for i, v in enumerate([100.0, 110.0, 99.0, 99.0, 120.0, 90.0])], "run int, ts timestamp_ntz, equity double")
    d = metrics.max_drawdown(eq, ["run"]).first()
    assert (d.max_drawdown, d.duration_seconds) == (0.25, 60)
    assert metrics.drawdown_episodes(eq, ["run"]).count() == 2
    trades = spark.createDataFrame([(1, at(i), p) for i, p in enumerate([1.0, 1.0, -1.0, 1.0, 1.0, 1.0, -1.0, -1.0])], "run int, ts timestamp_ntz, pnl double")
    for unit in ("week", "minute"):
        s = metrics.streaks(trades, ["run"], ["ts"], unit).first()
        assert (s.longest_win, s.longest_loss) == (3, 2)


def test_streaks_over_blocks(spark):
    rng = random.Random(7)
    rows = [(rng.choice("ab"), i, at(i), rng.choice([1.0] * 6 + [-1.0])) for i in range(600)]
    want = {}
    for k in "ab":
        best, n, last = {True: 0, False: 0}, 0, None
        for _, _, _, p in (r for r in rows if r[0] == k):
            n, last = (n + 1, last) if (p > 0) == last else (1, p > 0)
            best[last] = max(best[last], n)
        want[k] = best[True], best[False]
    df = spark.createDataFrame(rows, "k string, id int, ts timestamp_ntz, pnl double")
    for unit in ("minute", "hour", "day"):
        assert {r.k: (r.longest_win, r.longest_loss) for r in metrics.streaks(df, ["k"], ["ts", "id"], unit).collect()} == want


def test_hot_symbol_is_many_tasks(spark):
    """One symbol has 99 % of the rows: no partition of the join's window has more than a small share of them, and it equals pandas."""
    n = 20_000
    left = spark.range(n).select(F.when(F.col("id") % 100 == 0, "cold").otherwise("hot").alias("k"), "id", (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id").cast("int") * 7 % 43200)).alias("ts"))
    right = spark.range(n // 4).select(F.when(F.col("id") % 100 == 1, "cold").otherwise("hot").alias("k"), (F.col("id") * 1.0).alias("v"), (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id").cast("int") * 13 % 43200)).alias("ts"))
    right = right.groupBy("k", "ts").agg(F.max("v").alias("v"))
    got = temporal.asof_join(left, right, ["k"])
    l, r = left.toPandas().sort_values(["ts", "id"]), right.toPandas().sort_values("ts")
    want = pd.merge_asof(l, r, on="ts", by="k").set_index("id")["v"].sort_index()
    pd.testing.assert_series_equal(got.toPandas().set_index("id")["r_v"].sort_index(), want, check_names=False)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = temporal.asof_join(left, right, ["k"]).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(r["count"] for r in sizes) < 0.25 * n


def test_join_unique_with_hot_keys(spark):
    from lodemark.operators.skew import join_unique

    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 2000).alias("k"), "id")
    lookup = rows.select("k").distinct().withColumn("v", F.col("k") * 2).filter("k <> 17")
    got = join_unique(rows, lookup, "k", rows.groupBy("k").agg(F.count("*").alias("n")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(lookup, "k").collect()))


def test_with_next(spark):
    from lodemark.operators.rolling import with_next

    rows = [(i, None if i % 5 == 0 else f"v{i}") for i in range(0, 90, 3)]
    got = {r.i: r.next for r in with_next(spark.createDataFrame(rows, "i long, v string"), "i", "v", span=10).collect()}
    assert got == dict(zip([i for i, _ in rows], [v for _, v in rows[1:]] + [None], strict=True))


def test_cooldown_equals_loop(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("AB"), at(rng.randrange(3000))) for i in range(300)]
    kept, last = set(), {}
    for i, k, t in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if k not in last or (t - last[k]).total_seconds() >= 1800:
            last[k] = t
            kept.add(i)
    df = spark.createDataFrame(rows, "id int, symbol string, ts timestamp_ntz")
    assert {r.id for r in signals.cooldown(df, ["symbol"], 1800).collect()} == kept
    # narrow bins, a key that is null, ids that repeat across keys
    assert {r.id for r in signals.cooldown(df, ["symbol"], 1800, bin_seconds=3600).collect()} == kept
    two = df.select("id", F.lit(None).cast("string").alias("symbol"), "ts").filter("symbol IS NULL AND id < 0").unionByName(df.withColumn("symbol", F.when(F.col("symbol") == "A", "A")).withColumn("id", F.col("id") % 50))
    rows, last, want = sorted(two.collect(), key=lambda r: (r.symbol is None, r.symbol or "", r.ts, r.id)), {}, []
    for r in rows:
        if r.symbol not in last or (r.ts - last[r.symbol]).total_seconds() >= 1800:
            last[r.symbol] = r.ts
            want.append(tuple(r))
    assert sorted(map(tuple, signals.cooldown(two, ["symbol"], 1800).collect()), key=str) == sorted(want, key=str)


def test_upsert_insert_retention(spark):
    base = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, s string, v double")
    delta = spark.createDataFrame([(2, "x", 9.0, 1), (2, "y", 8.0, 2), (3, "z", None, 1)], "k int, s string, v double, _order int")
    assert {tuple(r) for r in relational.upsert(base, delta, ["k"], ["v"]).collect()} == {(1, "a", 1.0), (2, "b", 8.0), (3, "z", None)}
    assert {r.k for r in relational.insert_new(base, delta, ["k"], ["_order"]).collect()} == {3}
    assert relational.insert_new(base.filter("k = 1"), delta, ["k"], ["_order"]).filter("k = 2").first().s == "x"


def test_near_classes_equal_all_pairs(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    docs = []
    for i in range(40):
        base = [rng.choice(words) for _ in range(rng.randrange(30, 400))]
        docs.append(" ".join(base))
        if i % 3 == 0:
            docs += [" ".join([*base[:k], "changed", *base[k + 1 :]]) for k in range(0, 20, 4)] + [docs[-1]]
    docs += ["", None, "one", "one"]
    sigs = [neardup.minima(t) for t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (sigs[i] == sigs[j]).sum() >= neardup.AGREE:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert {r.id: r.class_id for r in neardup.near_classes(df).collect()} == {i: find(i) for i in range(len(docs))}


def test_first_articles_stay(spark):
    """An article stays if no earlier one that stays is like it: of a chain a-b-c, where a and c aren't alike, a and c."""
    rng = random.Random(9)
    texts, titles = [], []
    for chain in range(6):
        words, title = [f"c{chain}w{rng.randrange(5000)}" for _ in range(600)], f"title of chain number {chain} for the news"
        for step in range(7):
            texts.append(" ".join(words))
            titles.append(title if (chain, step) != (5, 3) else "quite another one")
            for _ in range(rng.choice([0, 2, 4])):
                words[rng.randrange(600)] = f"new{rng.randrange(10**6)}"
    rows = [(i, t, x) for i, (t, x) in enumerate(zip(titles, texts, strict=True))]
    rng.shuffle(rows)
    rows = [(k, t, x) for k, (_, t, x) in enumerate(rows)] + [(100, None, None), (101, "", ""), (102, rows[0][1], rows[0][2])]
    sigs = {i: neardup.minima(x) for i, _, x in rows}
    alike = lambda a, b: (sigs[a[0]] == sigs[b[0]]).sum() >= neardup.AGREE and neardup.titled_alike((a[1] or "").lower(), (b[1] or "").lower())
    kept = []
    for r in rows:
        if not any(alike(r, k) for k in kept):
            kept.append(r)
    got = neardup.keep_first(spark.createDataFrame(rows, "id long, title string, content string"))
    found = {r.id: r.kept for r in got.collect()}
    assert {i for i, k in found.items() if k} == {r[0] for r in kept} and len(found) == len(rows)
    classes = {r.class_id for r in neardup.near_titled(spark.createDataFrame(rows, "id long, title string, content string")).collect()}
    assert len(classes) < len(kept)  # chains hold more than their first


def test_models_of_symbols_are_plain_fits(spark):
    """A symbol's model is the least squares fit of its own rows; one with too few rows has none."""
    from lodemark.functions import models

    rng = np.random.default_rng(8)
    rows = [(s, float(a), float(b), float(2 * a - b * k + rng.normal() / 10)) for k, (s, n) in enumerate((("x", 200), ("y", 90), ("few", 5))) for a, b in rng.normal(size=(n, 2))]
    rows.append(("x", None, 1.0, 1.0))
    df = spark.createDataFrame(rows, "symbol string, a double, b double, target double").repartition(4)
    fitted = models.train_each(df, "symbol", ["a", "b"], "target", least_rows=20)
    got = {r.symbol: r for r in fitted.collect()}
    for s in ("x", "y"):
        own = np.array([r[1:] for r in rows if r[0] == s and r[1] is not None])
        design = np.column_stack((np.ones(len(own)), own[:, :2]))
        want = np.linalg.lstsq(design, own[:, 2], rcond=None)[0]
        assert got[s].status == "trained" and got[s].rows == len(own) and np.allclose(got[s].weights, want, atol=1e-6)
    assert got["few"].status == "too few rows" and got["few"].weights is None
    told = models.predict_each(df, fitted, "symbol", ["a", "b"]).collect()
    assert len(told) == len(rows) and all((r.predicted is None) == (r.symbol == "few" or r.a is None) for r in told)
    assert all(abs(r.predicted - np.dot(got[r.symbol].weights, (1, r.a, r.b))) < 1e-9 for r in told if r.predicted is not None)


def test_backtest_equals_loop(spark, data):
    """All signals of all symbols in one loop over time, with shared cash."""
    from lodemark.plans.tables import candles, tick_signals

    bars = candles(spark, data).select("symbol", "ts", "close").toPandas()
    by = {k: g.sort_values("ts").reset_index(drop=True) for k, g in bars.groupby("symbol")}
    rows = tick_signals(spark, data).toPandas()
    rows = rows[rows["signal"].isin(["BUY", "SELL"])]
    for run_id, take, stop in (risk.GRID[0], risk.GRID[8]):
        events, reasons, bought, curve = [], {}, {}, {}
        for r in rows.itertuples(index=False):
            b = by[r.symbol]
            gap = (b["ts"] - r.ts).abs()
            price = b["close"][gap.idxmin()]  # of equally near ones the first
            later = b[(b["ts"] >= r.ts + pd.Timedelta(seconds=1)) & (b["ts"] <= r.ts + pd.Timedelta(hours=24))]
            up = 1 if r.signal == "BUY" else -1
            moves = up * (later["close"] / price - 1)
            hit = later[(moves >= take) | (moves <= -stop)]
            events.append((r.ts, True, r.id, 0.2 * min(1.0, max(0.1, r.strength / 10))))
            over = b["ts"].iloc[-1] >= r.ts + pd.Timedelta(hours=24)  # else it may still be hit
            out = hit.iloc[0] if len(hit) else later.iloc[-1] if len(later) and over else None
            bought[r.id] = r.symbol, 1 / (price * 1.0005)
            reasons[r.id] = "open" if out is None else "timeout" if not len(hit) else "take_profit" if up * (out["close"] / price - 1) >= take else "stop_loss"
            if out is not None:
                entry, left = price * (1 + up * 0.0005), out["close"] * (1 - up * 0.0005)
                events.append((out["ts"], False, r.id, (entry + up * (left - entry) - (entry + left) * 0.001) / (price * 1.0005)))
        cash, put, trades, wins = 10_000.0, {}, 0, 0
        for t, opens, i, part in sorted(events):
            if opens and cash > 0:
                put[i] = cash * part
                cash -= put[i]
            elif not opens and i in put:
                cash, trades, wins = cash + put[i] * part, trades + 1, wins + (part > 1)
                del put[i]
            else:
                continue
            curve[t] = cash, dict(put)
        got = risk.backtest_grid(spark, data).filter(F.col("run_id") == run_id).first()
        assert (got.trades, got.wins) == (trades, wins) and abs(got.equity - cash - sum(put.values())) < 1e-3
        taken = backtest.positions(tick_signals(spark, data), candles(spark, data), [(run_id, take, stop)])
        assert {r.id: r.reason for r in taken.collect()} == reasons and "open" in reasons.values()
        marked = {r.ts: r for r in backtest.marked_equity(taken, backtest.cash_flow(taken), candles(spark, data)).collect()}
        for t, (money, held) in list(curve.items())[::7] + [list(curve.items())[-1]]:
            worth = 0.0
            for i, amount in held.items():
                symbol, units = bought[i]
                seen = by[symbol][by[symbol]["ts"] <= t]["close"]
                worth += amount * units * seen.iloc[-1] if len(seen) else 0.0
            assert abs(marked[t].marked - worth) < 1e-5 and abs(marked[t].equity - money - worth) < 1e-5
        assert len(marked) > len(curve)  # prices move between events as well
    days = risk.backtest_equity(spark, data).toPandas()
    assert days.groupby("run_id")["trades"].sum().to_dict() == {r.run_id: r.trades for r in risk.backtest_grid(spark, data).collect()}


def test_positions_near_the_end_stay_open(spark, data):
    from lodemark.plans.tables import candles, tick_signals

    bars = candles(spark, data)
    ends = {r.symbol: r.end for r in bars.groupBy("symbol").agg(F.max("ts").alias("end")).collect()}
    rows = backtest.positions(tick_signals(spark, data), bars, [(0, 1e9, 1e9)]).collect()  # nothing hits
    over = [r.entry_time + dt.timedelta(hours=24) <= ends[r.symbol] for r in rows]
    assert 0 < sum(over) < len(rows)
    assert all((r.reason, r.exit_time is None) == (("timeout", False) if o else ("open", True)) for r, o in zip(rows, over, strict=True))


@pytest.mark.parametrize("unit", ["hour", "day", "year"])
def test_running_equals_windows(spark, unit):
    """A series of 200 days with gaps, nulls and equal values, in blocks of any size, against windows over all of it."""
    import random

    from pyspark.sql.window import Window

    from lodemark.operators.rolling import running

    rng = random.Random(4)
    start = pd.Timestamp("2024-01-01")
    rows = [(k, (start + pd.Timedelta(hours=h)).to_pydatetime(), rng.choice([None, *range(-9, 9)])) for k in ("a", "b") for h in sorted(rng.sample(range(4800), 150))]
    df = spark.createDataFrame([*rows, ("c", start.to_pydatetime(), None)], "k string, ts timestamp_ntz, x int")
    v = F.col("x")
    w = Window.partitionBy("k").orderBy("ts")
    through, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("k", "ts", "x", F.sum(v).over(through).alias("a"), F.max(v).over(through).alias("b"), F.max(v).over(before).alias("c"), F.last(v, ignorenulls=True).over(through).alias("d"), F.lag(v).over(w).alias("e"))
    got = running(df, ["k"], ["ts"], F.date_trunc(unit, "ts"), a=("sum", v), b=("max", v), c=("max_before", v), d=("last", v), e=("lag", v))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.columns == want.columns


def test_bootstrap_of_a_mean(spark):
    """The same in any partitioning, as wide as theory says, and one value where all rows are equal."""
    rng = np.random.default_rng(2)
    rows = [("a", i, float(v)) for i, v in enumerate(rng.normal(0.01, 0.05, 2000))] + [("b", 5000 + i, 0.5) for i in range(50)] + [("b", 9999, None)]
    df = spark.createDataFrame(rows, "side string, id long, pnl_pct double")
    got = {r.side: r for r in metrics.bootstrap(df, ["side"], "id", replicates=300).collect()}
    again = {r.side: r for r in metrics.bootstrap(df.repartition(7), ["side"], "id", replicates=300).collect()}
    assert got == again and got["a"].replicates == 300
    values = np.array([v for s, _, v in rows if s == "a"])
    assert abs((got["a"].high - got["a"].low) / (2 * 1.96 * values.std() / np.sqrt(2000)) - 1) < 0.2 and got["a"].low < values.mean() < got["a"].high
    assert got["b"].low == got["b"].high == got["b"].mean == 0.5


def test_the_latest_of_equal_ones_is_one(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 1), ("a", 2, 5), ("b", 1, 1), ("b", 1, 0)], "k string, n int, id int")
    got = relational.activate_latest(df, ["k"], "n", tie="id").filter("is_active").collect()
    assert {(r.k, r.n, r.id) for r in got} == {("a", 2, 5), ("b", 1, 1)}


def test_urls_equal_urllib(spark, data):
    from urllib.parse import urlsplit

    from lodemark.queries import QUERIES

    urls = {r.page_id: r.url for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    got = {r.page_id: r for r in QUERIES["url_functions"](spark, data).collect()}
    assert got.keys() == urls.keys()
    for i, u in urls.items():
        assert got[i].host == urlsplit(u).hostname, u
        base = u.split("#")[0]
        pages = [x for x in urlsplit(base).query.split("&") if x.startswith("page=")]
        if not pages:
            assert got[i].next == base + ("&" if "?" in base else "?") + "page=2"
        else:
            assert f"page={int(pages[0][5:]) + 1}" in got[i].next


def test_titles_equal_difflib(spark, data):
    from difflib import SequenceMatcher

    from lodemark.queries import QUERIES

    items = sorted((r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect())
    got = {r.item_id: r for r in QUERIES["title_similarity"](spark, data).collect()}
    want = {i: SequenceMatcher(None, a.lower(), b.lower()).ratio() for (i, a), (_, b) in zip(items, items[1:], strict=False)}
    assert got.keys() == want.keys() and all(abs(got[i].ratio - want[i]) < 1e-6 for i in want)


def test_near_titled_equals_all_pairs(spark):
    from difflib import SequenceMatcher

    rng = random.Random(6)
    docs = []
    for i in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(150)]
        docs += [(len(docs) + k, rng.choice([f"Coin {i} rises today", f"Coin {i} rises todays", f"Other words {i * 77}"]), " ".join([*base[:k], "new", *base[k + 1 :]] if k else base)) for k in range(4)]
    sigs, root = {i: neardup.minima(t) for i, _, t in docs}, {i: i for i, _, _ in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a, _ in docs:
        for j, b, _ in docs[:i]:
            if (sigs[i] == sigs[j]).sum() >= neardup.AGREE and SequenceMatcher(None, a.lower(), b.lower()).ratio() >= 0.8:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    df = spark.createDataFrame(docs, "id long, title string, content string")
    assert {r.id: r.class_id for r in neardup.near_titled(df).collect()} == {i: find(i) for i in root}


def test_text_functions(spark):
    one = lambda c, v=None: spark.createDataFrame([(v,)], "v string").select(c.alias("r")).first().r
    v = F.col("v")
    assert one(text.entities(v, {"BTC": ["btc", "bitcoin"], "ETH": ["eth"]}), "Bitcoin and ETH, not ethos") == ["BTC", "ETH"]
    assert one(text.primary(F.array(F.lit("ETH"), F.lit("XRP")), ["BTC", "ETH"])) == "ETH"
    assert one(text.mask(v), "api_key=abc123 token: 'x'") == "api_key=*** token: '***'"
    assert one(text.sql_literal(v, "string"), "it's") == "'it''s'"
    assert one(text.sql_literal(v.cast("double"), "number"), "NaN") == "NULL"
    assert one(text.next_page(v), "http://a/b?page=9&x=1#t") == "http://a/b?page=10&x=1"
    assert one(text.sparkline(F.array(*map(F.lit, (1.0, 4.0, 7.0))))) == "▁▄▇"
    assert one(text.coin(text.pair(v)), " btc ") == "BTC"


def test_cleanup_removes_what_was_saved(spark):
    import os

    from lodemark import storage

    a, b = storage.save(spark.range(5), "a"), storage.save(spark.range(6), "b")
    paths = [x.saved_as.removeprefix("file://") for x in (a, b)]
    storage.discard(a)
    assert [os.path.exists(p) for p in paths] == [False, True] and b.count() == 6
    assert storage.cleanup(spark) >= 1 and not os.path.exists(paths[1]) and storage.cleanup(spark) == 0
