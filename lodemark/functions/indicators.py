"""Technical indicators over candles (symbol, ts, open, high, low, close, volume)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodemark.operators.rolling import change, ema, full, over, percent_rank, sma

def with_rsi(bars: DataFrame, n: int, name: str, default: float | None = None) -> DataFrame:
    """From simple means of rises and falls; the first bar counts as no change, no falls give null or ``default``."""
    w = over("symbol")
    bars = bars.withColumn("_d", F.col("close") - F.lag("close").over(w))
    gain, loss = F.when(F.col("_d") > 0, F.col("_d")).otherwise(0.0), F.when(F.col("_d") < 0, -F.col("_d")).otherwise(0.0)
    value = 100 - 100 / (1 + F.try_divide(sma(w, n, gain), F.nullif(sma(w, n, loss), F.lit(0.0))))
    return bars.withColumn(name, value if default is None else F.coalesce(value, F.lit(default))).drop("_d")


def with_macd(bars: DataFrame) -> DataFrame:
    bars = ema(bars, {"_e12": ("close", 12), "_e26": ("close", 26)}, ["symbol"]).withColumn("macd", F.col("_e12") - F.col("_e26"))
    bars = ema(bars, {"macd_signal": ("macd", 9)}, ["symbol"])
    return bars.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("_e12", "_e26")


def with_bollinger(bars: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    w, close = over("symbol"), F.col("close")
    mid, dev = sma(w, n, close), full(w, n, F.stddev_samp, close)
    return bars.withColumns({"bb_middle": mid, "bb_upper": mid + k * dev, "bb_lower": mid - k * dev})


def with_bollinger_flat(bars: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    """Without gaps: a missing mean is the close, a missing deviation is zero."""
    w, close = over("symbol"), F.col("close")
    mid, dev = F.coalesce(sma(w, n, close), close), F.coalesce(full(w, n, F.stddev_samp, close), F.lit(0.0))
    return bars.withColumns({"bb_middle": mid, "bb_upper": mid + k * dev, "bb_lower": mid - k * dev})


def with_atr(bars: DataFrame, n: int = 14) -> DataFrame:
    return bars.withColumn("atr_14", sma(over("symbol"), n, F.col("high") - F.col("low")))


def with_obv(bars: DataFrame) -> DataFrame:
    """Running volume, up when the close rises; the first and flat bars count down."""
    w = over("symbol")
    bars = bars.withColumn("_up", F.when(F.col("close") > F.lag("close").over(w), 1).otherwise(-1))
    return bars.withColumn("obv", F.sum(F.col("volume") * F.col("_up")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_up")


def with_vwap(bars: DataFrame, flat: bool = False) -> DataFrame:
    """Running volume-weighted typical price; ``flat``: of the close, and the close itself while there is no volume."""
    w = over("symbol").rowsBetween(Window.unboundedPreceding, 0)
    price = F.col("close") if flat else (F.col("high") + F.col("low") + F.col("close")) / 3
    value = F.try_divide(F.sum(price * F.col("volume")).over(w), F.sum(F.nullif("volume", F.lit(0)) if not flat else F.col("volume")).over(w).cast("double"))
    if flat:
        return bars.withColumn("vwap", F.coalesce(value, F.col("close")))
    return bars.withColumn("vwap", F.when(F.col("volume") != 0, value))


def with_stochastic(bars: DataFrame, n: int = 14, d: int = 3) -> DataFrame:
    w = over("symbol")
    low, high = full(w, n, F.min, F.col("low")), full(w, n, F.max, F.col("high"))
    bars = bars.withColumn("stoch_k", F.try_divide(100 * (F.col("close") - low), F.nullif(high - low, F.lit(0.0))))
    return bars.withColumn("stoch_d", sma(w, d, F.col("stoch_k")))


def with_mfi(bars: DataFrame, n: int = 14) -> DataFrame:
    w = over("symbol")
    bars = bars.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    bars = bars.withColumn("_d", F.col("_tp") - F.lag("_tp").over(w)).withColumn("_flow", F.col("_tp") * F.col("volume"))
    up, down = F.when(F.col("_d") > 0, F.col("_flow")).otherwise(0.0), F.when(F.col("_d") < 0, F.col("_flow")).otherwise(0.0)
    ratio = F.try_divide(full(w, n, F.sum, up), F.nullif(full(w, n, F.sum, down), F.lit(0.0)))
    return bars.withColumn("mfi_14", 100 - 100 / (1 + ratio)).drop("_tp", "_d", "_flow")


def with_price_features(bars: DataFrame, horizons: tuple[int, ...] = (4, 16, 96)) -> DataFrame:
    """Log return (0 where undefined), ranges, and for each horizon: change, volatility of log returns, z-score of the close."""
    w, close = over("symbol"), F.col("close")
    before = F.lag("close").over(w)
    ratio = F.when((close > 0) & (before > 0), close / F.nullif(before, F.lit(0.0)))
    bars = bars.withColumn("log_return", F.coalesce(F.ln(ratio), F.lit(0.0)))
    made = {"hl_range": F.try_divide(F.col("high") - F.col("low"), F.nullif(close, F.lit(0.0))), "co_spread": F.try_divide(close - F.col("open"), F.nullif(F.col("open"), F.lit(0.0)))}
    for n in horizons:
        dev = full(w, n, F.stddev_samp, close)
        made[f"roc_{n}"] = change(w, n, close)
        made[f"volatility_{n}"] = full(w, n, F.stddev_samp, F.col("log_return"))
        made[f"zscore_{n}"] = F.try_divide(close - sma(w, n, close), F.nullif(F.round(dev, 9), F.lit(0.0)))
    return bars.withColumns(made)


def with_volume_features(bars: DataFrame) -> DataFrame:
    w, v = over("symbol"), F.col("volume").cast("double")
    mean, whole = sma(w, 20, v), full(w, 96, F.sum, v)
    return bars.withColumns({"volume_change": F.try_divide(v, F.nullif(F.lag(v).over(w), F.lit(0.0))) - 1, "volume_ma_20": mean, "volume_ratio": F.try_divide(v, F.nullif(mean, F.lit(0.0))), "volume_std_20": full(w, 20, F.stddev_samp, v), "volume_profile": F.try_divide(v, F.nullif(whole, F.lit(0.0)))})


def with_atr_percentile(bars: DataFrame, n: int = 100) -> DataFrame:
    bars = with_atr(bars).withColumn("atr_14", F.round("atr_14", 6))
    return bars.withColumn("atr_percentile", percent_rank(over("symbol"), n, F.col("atr_14")))


def with_temporal_features(bars: DataFrame) -> DataFrame:
    from math import pi

    hour, day = F.hour("ts"), F.weekday("ts")
    return bars.withColumns({"hour_sin": F.sin(2 * pi * hour / 24), "hour_cos": F.cos(2 * pi * hour / 24), "day_sin": F.sin(2 * pi * day / 7), "day_cos": F.cos(2 * pi * day / 7), "is_weekend": (day >= 5).cast("int")})


def with_last_major_move(bars: DataFrame, least: float = 0.03) -> DataFrame:
    """Hours since the last bar, this one included, that moved more than ``least`` from open to close."""
    moved = F.abs(F.try_divide(F.col("close") - F.col("open"), F.nullif(F.col("open"), F.lit(0.0)))) > least
    at = F.last(F.when(moved, F.col("ts")), ignorenulls=True).over(over("symbol").rowsBetween(Window.unboundedPreceding, 0))
    return bars.withColumn("hours_since_move", F.timestamp_diff("SECOND", at, F.col("ts")) / F.lit(3600.0))
