"""Trading signals: rules, strength, targets, lifecycle, cooldown and gates, as column expressions for all symbols at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the rules.
BUY_SENTIMENT, SELL_SENTIMENT, MIN_CONFIDENCE, SUPPORT = 0.70, 0.30, 0.75, 2
GATE_CONFIDENCE, GATE_STRENGTH = 0.70, 6.5


def named(conditions: dict[str, Column]) -> Column:
    """Names of the conditions that hold."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in conditions.items())))


def factors(snapshot: DataFrame) -> DataFrame:
    """Primary, supporting and risk factors of each snapshot for both sides, and the side that the rules give.

    BUY needs all three primary factors, two supporting ones and no risk; SELL two primary and two supporting ones, whatever the risks.
    """
    s, p, c = F.col("sentiment"), F.col("direction"), F.col("prediction_confidence")
    buy = named({"sentiment": s > BUY_SENTIMENT, "prediction": p == "UP", "confidence": c > MIN_CONFIDENCE})
    buy_more = named({"rsi": F.col("rsi") < 30, "macd": F.col("macd_hist") > 0, "volume": F.col("volume_ratio") > 1.5, "outflow": F.col("net_flow") < 0, "trend": F.col("change_24h") > 0})
    risks = named({"overbought": F.col("rsi") > 80, "volatile": F.col("atr") > 0.05 * F.col("price"), "whales": F.col("whales") > 5, "dump": F.col("change_24h") < -10})
    sell = named({"sentiment": s < SELL_SENTIMENT, "prediction": p == "DOWN"})
    sell_more = named({"rsi": F.col("rsi") > 70, "macd": F.col("macd_hist") < 0, "volume": F.col("volume_ratio") > 1.5, "inflow": F.col("net_flow") > 0, "trend": F.col("change_24h") < 0})
    out = snapshot.withColumns({"buy_primary": buy, "buy_support": buy_more, "sell_primary": sell, "sell_support": sell_more, "risks": risks})
    is_buy = (F.size("buy_primary") == 3) & (F.size("buy_support") >= SUPPORT) & (F.size("risks") == 0)
    is_sell = (F.size("sell_primary") == 2) & (F.size("sell_support") >= SUPPORT)
    return out.withColumn("side", F.when(is_buy, "BUY").when(is_sell, "SELL").otherwise("HOLD"))


def strength(sentiment: Column, prediction: Column, onchain: Column, support: Column) -> Column:
    return F.least((0.3 * sentiment + 0.4 * prediction + 0.3 * onchain) * F.greatest(F.lit(0.2), support / F.lit(5.0)) * 10, F.lit(10.0))


def price_targets(side: Column, price: Column, predicted: Column, support: Column, resistance: Column) -> dict[str, Column]:
    """Target, stop and reward for risk: the predicted price or 2 % away, a stop of 1.5 % widened to support or resistance."""
    buy = side == "BUY"
    target = F.when(buy, F.coalesce(predicted, price * 1.02)).otherwise(F.coalesce(predicted, price * 0.98))
    stop = F.when(buy, F.least(price * 0.985, F.coalesce(support, price * 0.985))).otherwise(F.greatest(price * 1.015, F.coalesce(resistance, price * 1.015)))
    return {"target": target, "stop": stop, "risk_reward": F.try_divide(F.abs(target - price), F.nullif(F.abs(price - stop), F.lit(0.0)))}


def direction(predicted: Column, price: Column) -> Column:
    return F.when(predicted > price, "UP").when(predicted < price, "DOWN").otherwise("SIDEWAYS")


def quality_gate(df: DataFrame) -> DataFrame:
    return df.filter(F.col("signal").isin("BUY", "SELL") & (F.col("confidence") >= GATE_CONFIDENCE) & (F.col("strength") >= GATE_STRENGTH))


def pnl_pct(side: Column, entry: Column, exit_price: Column) -> Column:
    """Percent, signed by side; null where the entry is not positive."""
    move = 100 * (exit_price - entry) / F.nullif(entry, F.lit(0.0))
    return F.when(entry > 0, F.when(side == "SELL", -move).otherwise(move))


def close_reason(side: Column, price: Column, target: Column, stop: Column, expired: Column) -> Column:
    hit = F.when(side == "BUY", F.when(price >= target, "take_profit").when(price <= stop, "stop_loss")).when(side == "SELL", F.when(price <= target, "take_profit").when(price >= stop, "stop_loss"))
    return F.coalesce(hit, F.when(expired, "timeout"))


def lifecycle(signals: DataFrame, bars: DataFrame, hours: int = 24, take: float = 0.02, stop: float = 0.015) -> DataFrame:
    """Each signal with the first bar after it, within ``hours``, at which it closes: reason, time and percent won.

    A signal that neither target nor stop closes ends at the last bar in its time; one without bars stays open. Repeated rows are one. Bars within
    reach of a key and time bin are one row, so signals aren't multiplied by their bars.
    """
    from .temporal import gathered

    rows = gathered(signals.distinct(), bars.select("symbol", "ts", "close"), ["symbol"], F.col("ts") + F.expr("INTERVAL 1 SECOND"), F.col("ts") + F.make_dt_interval(hours=F.lit(hours)), hours * 3600, "_later")
    up, down = F.col("price") * (1 + take), F.col("price") * (1 - stop)
    target, floor = F.when(F.col("signal") == "BUY", up).otherwise(F.col("price") * (1 - take)), F.when(F.col("signal") == "BUY", down).otherwise(F.col("price") * (1 + stop))
    high = F.when(F.col("signal") == "BUY", target).when(F.col("signal") == "SELL", floor)
    low = F.when(F.col("signal") == "BUY", floor).when(F.col("signal") == "SELL", target)
    rows = rows.withColumns({"_high": high, "_low": low})
    rows = rows.withColumns({"_hit": F.get(F.filter("_later", lambda b: (b["close"] >= F.col("_high")) | (b["close"] <= F.col("_low"))), F.lit(0)), "_last": F.try_element_at("_later", F.lit(-1))})
    why = close_reason(F.col("signal"), F.col("_hit.close"), target, floor, F.lit(False))
    at = lambda c: F.coalesce(F.col(f"_hit.{c}"), F.col(f"_last.{c}"))
    return rows.select(*signals.columns, F.when(at("ts").isNull(), "open").otherwise(F.coalesce(why, F.lit("timeout"))).alias("reason"), at("ts").alias("closed_at"), F.round(pnl_pct(F.col("signal"), F.col("price"), at("close")), 6).alias("pnl_pct"))


def _followed(times: np.ndarray, wait: int) -> np.ndarray:
    """For each of the sorted times, the place of the last one kept if it is kept: links to the first time a wait later are doubled until they end."""
    at = np.searchsorted(times, times + wait)
    at = np.where(at == len(times), np.arange(len(times)), at)
    while (at[at] != at).any():
        at = at[at]
    return at


def cooldown(signals: DataFrame, keys: list[str], seconds: int, ts: str = "ts", tie: str = "id", bin_seconds: int = 24 * 3600) -> DataFrame:
    """Signals that come ``seconds`` or more after the last one kept of their key; of equal times, the one with the least ``tie``.

    Whether a signal is kept depends on those kept before it, but only through the time of the last one. Key and time bin are a task of their own: first each bin
    tells which last time it leaves for each it may start with (a step function of few steps, as kept signals soon fall together), then these are followed
    bin by bin for each key, and then each bin, with its start known, tells what it keeps. Null times are dropped; null keys are a key.
    """
    wait, width = seconds * 10**6, max(bin_seconds, 4 * seconds) * 10**6
    named = {k: F.struct(F.col(k)).alias(k) for k in keys}  # within structs, null keys can be joined
    rows = signals.filter(F.col(ts).isNotNull()).withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    times = rows.groupBy(*named.values(), "_us").agg(F.min(tie).alias("_t")).withColumn("_bin", F.floor(F.col("_us") / width)).drop("_t")
    head = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in times.schema if f.name in keys)}, _bin long"

    def steps(group: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(group["_us"].to_numpy())
        first = int(np.searchsorted(t, int(group["_bin"].iloc[0]) * width + wait)) + 1  # no start forbids more than these
        left = t[_followed(t, wait)][:first]
        last = np.append(left[1:] != left[:-1], True)
        return pd.concat([group[[*keys, "_bin"]].iloc[[0] * int(last.sum())].reset_index(drop=True), pd.DataFrame({"_upto": t[:first][last], "_left": left[last]})], axis=1)

    def starts(group: pd.DataFrame) -> pd.DataFrame:
        group, free, out = group.sort_values(["_bin", "_upto"]), np.iinfo(np.int64).min, []
        for _, b in group.groupby("_bin", sort=True):
            out.append(free)
            at = int(np.searchsorted(b["_upto"].to_numpy(), free))
            free = int(b["_left"].iloc[at]) + wait if at < len(b) else free
        bins = group.drop_duplicates("_bin")[[*keys, "_bin"]].reset_index(drop=True)
        return bins.assign(_us=out, _start=True)

    def kept(group: pd.DataFrame) -> pd.DataFrame:
        free = int(group.loc[group["_start"], "_us"].iloc[0])
        t, out = np.sort(group.loc[~group["_start"], "_us"].to_numpy()), []
        at = int(np.searchsorted(t, free))
        while at < len(t):
            out.append(int(t[at]))
            at = int(np.searchsorted(t, t[at] + wait))
        return group[[*keys, "_bin"]].iloc[[0] * len(out)].reset_index(drop=True).assign(_us=np.array(out, np.int64))

    begun = times.groupBy(*keys, "_bin").applyInPandas(steps, f"{head}, _upto long, _left long").groupBy(*keys).applyInPandas(starts, f"{head}, _us long, _start boolean")
    chosen = times.select(*keys, "_bin", "_us", F.lit(False).alias("_start")).unionByName(begun).groupBy(*keys, "_bin").applyInPandas(kept, f"{head}, _us long")
    first = F.min_by(F.struct(*signals.columns), F.col(tie)).alias("_row")
    return rows.join(chosen.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_us").alias("_kept")), [*(F.struct(F.col(k)) == F.col(f"_k_{k}") for k in keys), F.col("_us") == F.col("_kept")]).groupBy(*named.values(), "_us").agg(first).select("_row.*")


def flat_signal(move_pct: Column, sentiment: Column, volatility: Column) -> dict[str, Column]:
    """Signal of the simple rule. Weights 2 and 1.5, band 0.15, penalty 0.3, levels 3 % and 6 %."""
    score = 2 * move_pct + 1.5 * (sentiment - 0.5)
    side = F.when(score > 0.15, "BUY").when(score < -0.15, "SELL").otherwise("HOLD")
    confidence = F.least(F.greatest(F.least(F.abs(score), F.lit(1.0)) - 0.3 * F.least(F.greatest(volatility, F.lit(0.0)), F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    return {"side": side, "score": score, "confidence": confidence}


def position_size(account: Column, risk: Column, entry: Column, stop: Column) -> Column:
    return F.coalesce(F.try_divide(account * risk, F.nullif(F.abs(entry - stop), F.lit(0.0))), F.lit(0.0))


def quiet(ts: Column, start: int, end: int) -> Column:
    """Whether the hour is in the quiet hours, which may wrap around midnight."""
    h = F.hour(ts)
    return (h >= start) & (h < end) if start <= end else (h >= start) | (h < end)


def notify_gate(df: DataFrame, least_confidence: float, least_strength: float, quiet_start: int, quiet_end: int) -> DataFrame:
    ok = (F.col("confidence") >= least_confidence) & (F.col("strength") >= least_strength)
    return df.filter(ok & (~quiet(F.col("ts"), quiet_start, quiet_end) | (F.col("confidence") >= 0.9)))
