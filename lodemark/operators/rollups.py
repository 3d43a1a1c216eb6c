"""Rollups: candles, sentiment rollups, trailing windows and decayed means, for all symbols in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Label scores and source weights of the weighted sentiment mean.
LABEL_SCORES = {"BULLISH": 0.9, "NEUTRAL": 0.5, "BEARISH": 0.2, "FUD": 0.1}
SOURCE_WEIGHTS = {"news": 1.0, "reddit": 0.7, "onchain": 0.9, "other": 0.5}
#: Trailing windows in hours.
TRAILING = {"1h": 1, "4h": 4, "24h": 24, "7d": 168}


def bucket(ts: str, width: str) -> Column:
    return F.window(F.col(ts), width)["start"].cast("timestamp_ntz")


def candle_values() -> list[Column]:
    """What a candle holds, of ticks (ts, event_id, price, size), in batches and streams alike."""
    at = F.struct("ts", "event_id")
    return [F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("size").cast("long").alias("volume"), F.count("*").alias("trade_count")]


def candles(ticks: DataFrame, width: str) -> DataFrame:
    """Open, high, low, close, volume and count by symbol and bucket; ties in time are broken by event_id."""
    return ticks.groupBy("symbol", bucket("ts", width).alias("b")).agg(*candle_values()).withColumnRenamed("b", "ts")


def reroll(bars: DataFrame, width: str) -> DataFrame:
    """Candles of a wider bucket from candles."""
    return bars.groupBy("symbol", bucket("ts", width).alias("b")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.sum("trade_count").alias("trade_count")
    ).withColumnRenamed("b", "ts")


def lookup(values: dict, key: Column, default: float) -> Column:
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.create_map(*pairs)[key], F.lit(default))


def share(condition: Column) -> Column:
    return F.round(F.avg(F.when(condition, 1.0).otherwise(0.0)), 6)


def sentiment_hourly(scores: DataFrame) -> DataFrame:
    s = F.col("sentiment_score")
    return scores.groupBy("symbol", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(
        F.count("*").alias("n"), F.round(F.avg(s), 6).alias("avg_score"), F.round(F.stddev_pop(s), 6).alias("std_score"), share(s > 0.66).alias("bullish"), share(s < 0.34).alias("bearish"), share(s.between(0.34, 0.66)).alias("neutral")
    )


def sentiment_values() -> list[Column]:
    """Number, mean, deviation and shares of the labels of scores, in batches and streams alike."""
    label, s = F.col("sentiment_label"), F.col("sentiment_score")
    return [
        F.count("*").alias("n"), F.round(F.avg(s), 6).alias("avg_score"), F.round(F.stddev_pop(s), 6).alias("std_score"), share(label == "BULLISH").alias("bullish"), share(label.isin("BEARISH", "FUD")).alias("bearish"),
        share(label == "NEUTRAL").alias("neutral"), F.round(F.avg(s * F.coalesce("confidence", F.lit(0.5))), 6).alias("weighted"),
    ]


def sentiment_trailing(scores: DataFrame, as_of: Column, windows: dict[str, int] = TRAILING) -> DataFrame:
    """By symbol and trailing window before ``as_of``; windows without scores give no row."""
    longest = max(windows.values())
    dims = F.explode(F.array(*(F.struct(F.lit(k).alias("window"), F.lit(h).alias("hours")) for k, h in windows.items())))
    rows = scores.filter((F.col("ts") >= as_of - F.make_dt_interval(hours=F.lit(longest))) & (F.col("ts") <= as_of)).select("*", dims.alias("w"))
    rows = rows.filter(F.col("ts") >= as_of - F.make_dt_interval(hours=F.col("w.hours")))
    return rows.groupBy("symbol", "w.window").agg(*sentiment_values())


def age_seconds(ts: Column, as_of: Column) -> Column:
    """Seconds from ts to as_of, with microseconds, never negative."""
    return F.greatest((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / F.lit(1e6), F.lit(0.0))


def decayed_flat(scores: DataFrame, as_of: Column, windows: dict[str, int]) -> DataFrame:
    """Mean with weights confidence x volume / (1 + age / window); 0.5 for a symbol without scores in a window. ``windows`` in seconds."""
    dims = F.explode(F.array(*(F.struct(F.lit(k).alias("window"), F.lit(v).alias("seconds")) for k, v in windows.items())))
    grid = scores.select("symbol").distinct().select("symbol", dims.alias("w")).select("symbol", "w.window")
    age = age_seconds(F.col("ts"), as_of)
    rows = scores.filter(F.col("ts") <= as_of).withColumn("age", age).select("*", dims.alias("w")).filter(F.col("age") <= F.col("w.seconds"))
    weight = F.greatest(F.col("volume_weight"), F.lit(0.1)) * F.greatest(F.col("confidence"), F.lit(0.1)) / (1 + F.col("age") / F.col("w.seconds"))
    means = rows.groupBy("symbol", "w.window").agg((F.sum(F.col("sentiment_score") * weight) / F.sum(weight)).alias("mean"))
    return grid.join(means, ["symbol", "window"], "left").select("symbol", "window", F.round(F.coalesce("mean", F.lit(0.5)), 6).alias("score"))


def decayed_weighted(scores: DataFrame, as_of: Column) -> DataFrame:
    """Mean of label scores with weights confidence x source weight / (1 + age in hours) x clamp(upvotes, 1, 5000)^0.2, and its label."""
    age = age_seconds(F.col("ts"), as_of) / 3600
    weight = F.col("confidence") * lookup(SOURCE_WEIGHTS, F.col("source_type"), 0.5) / (1 + age) * F.pow(F.least(F.greatest(F.col("upvotes").cast("double"), F.lit(1.0)), F.lit(5000.0)), F.lit(0.2))
    value = lookup(LABEL_SCORES, F.col("sentiment_label"), 0.5)
    out = scores.filter(F.col("ts") <= as_of).groupBy("symbol").agg(F.round(F.try_divide(F.sum(value * weight), F.sum(weight)), 6).alias("score"))
    return out.withColumn("label", F.when(F.col("score") >= 0.66, "BULLISH").when(F.col("score") <= 0.34, "BEARISH").otherwise("NEUTRAL"))


def net_flow(events: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    rows = events.filter((F.col("ts") > as_of - F.make_dt_interval(hours=F.lit(hours))) & (F.col("ts") <= as_of))
    to, back = (F.sum(F.when(F.col("flow_direction") == d, F.col("amount_usd")).otherwise(0.0)) for d in ("to_exchange", "from_exchange"))
    return rows.groupBy("symbol").agg(F.round(to - back, 2).alias("net_flow"), F.sum(F.col("is_whale").cast("long")).alias("whales"))


def range_move(ticks: DataFrame, as_of: Column, hours: int = 1) -> DataFrame:
    rows = ticks.filter((F.col("ts") > as_of - F.make_dt_interval(hours=F.lit(hours))) & (F.col("ts") <= as_of))
    return rows.groupBy("symbol").agg(F.round(F.try_divide(F.max("price") - F.min("price"), F.min("price")), 6).alias("move"))
