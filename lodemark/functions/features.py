"""Feature frames for models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodemark.operators.rolling import change, full, over
from lodemark.operators.temporal import asof_join


def flat_frame(bars: DataFrame) -> DataFrame:
    """Returns over 1 and 5 bars (0 where undefined), volatility of 20 returns, and the next close as target; complete rows only."""
    w, close = over("symbol"), F.col("close")
    out = bars.select("symbol", "ts", "close", F.coalesce(change(w, 1, close), F.lit(0.0)).alias("return_1"), F.coalesce(change(w, 5, close), F.lit(0.0)).alias("return_5"), F.lead("close").over(w).alias("target"))
    out = out.withColumn("volatility_20", full(w, 20, F.stddev_samp, F.col("return_1")))
    return out.dropna(subset=["volatility_20", "target"]).select("symbol", "ts", "close", "return_1", "return_5", "volatility_20", "target")


def with_sentiment(frame: DataFrame, scores: DataFrame, default: float = 0.5) -> DataFrame:
    """``frame`` with the last ``sentiment_score`` of its symbol at or before each row; ``default`` where there is none. ``scores``: symbol, ts, sentiment_score."""
    joined = asof_join(frame, scores.select("symbol", "ts", "sentiment_score"), ["symbol"])
    return joined.select(*frame.columns, F.coalesce("r_sentiment_score", F.lit(default)).alias("sentiment_score"))


OUTCOME = {"executed_at": "string", "closed_at": "string", "execution_price": "double", "close_price": "double", "pnl_pct": "double", "close_reason": "string"}


def signal_outcome(signal_id: Column, symbol: Column, signal: Column, metadata: Column) -> Column:
    """What became of a signal, from its JSON: null unless it was executed or closed."""
    m = F.from_json(metadata, ", ".join(f"{c} string" for c in OUTCOME))  # numbers come with or without quotes
    some = (F.coalesce(m["executed_at"], F.lit("")) != "") | (F.coalesce(m["closed_at"], F.lit("")) != "")
    parts = (m[c].try_cast(kind).alias(c) for c, kind in OUTCOME.items())
    return F.when(some, F.struct(signal_id.alias("signal_id"), symbol.alias("symbol"), signal.alias("signal"), *parts))
