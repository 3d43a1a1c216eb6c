"""Deterministic series for demonstrations and tests."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def drift_prices(spark: SparkSession, n: int, symbols: list[str], start: float = 100.0, drift: float = 0.001, step: str = "15 minutes") -> DataFrame:
    """Bars whose closes rise by ``drift`` on even and fall by 0.7 of it on odd rows: a running product as a sum of logarithms."""
    rows = spark.range(n).crossJoin(F.broadcast(spark.createDataFrame([(s,) for s in symbols], "symbol string")))
    move = F.when(F.col("id") == 0, F.lit(0.0)).when(F.col("id") % 2 == 0, F.lit(drift)).otherwise(F.lit(-0.7 * drift))
    close = F.lit(start) * F.exp(F.sum(F.ln(1 + move)).over(Window.partitionBy("symbol").orderBy("id")))
    ts = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.expr(f"INTERVAL {step}") * F.col("id")
    bars = rows.select("symbol", ts.alias("ts"), close.alias("close"), (1000 + F.col("id")).alias("volume"))
    open_ = F.coalesce(F.lag("close").over(Window.partitionBy("symbol").orderBy("ts")), F.lit(start))
    return bars.withColumn("open", open_).withColumns({"high": F.greatest("open", "close") * 1.0015, "low": F.least("open", "close") * 0.9985})


def proxy_sentiment(bars: DataFrame, noise: float = 0.0, seed: int = 1) -> DataFrame:
    """Scores of 15 x daily return, with seeded noise if wanted, held to [-1, 1], and their labels at 0.3."""
    back = F.lag("close").over(Window.partitionBy("symbol").orderBy("ts"))
    raw = 15 * (F.try_divide(F.col("close"), F.nullif(back, F.lit(0.0))) - 1) + (F.rand(seed) * 2 - 1) * noise
    score = F.greatest(F.least(F.coalesce(raw, F.lit(0.0)), F.lit(1.0)), F.lit(-1.0))
    return bars.select("symbol", "ts", score.alias("score")).withColumn("label", F.when(F.col("score") > 0.3, "BULLISH").when(F.col("score") < -0.3, "BEARISH").otherwise("NEUTRAL"))


def article_pages(query: str, token: str | None) -> tuple[list[tuple], str | None]:
    """Three pages of two articles, one of which all queries find and one of which has no title: a stand-in for ``fetch`` of the articles source."""
    k = int(token or 0)
    return [(f"http://{query}/{k}", f"{query} {k}", "2024-01-01"), ("http://all/x" if k else f"http://{query}/none", "shared" if k else None, "2024-01-02")], str(k + 1) if k < 2 else None


def hourly_pages(symbol: str, interval: str, start: int, end: int, limit: int) -> list[list]:
    """A page of flat hourly candles, as an exchange would give it: a stand-in for ``fetch`` of the klines source."""
    hour = 3_600_000
    return [[t, "1", "2", "0.5", "1.5", "10"] for t in range(-(-start // hour) * hour, end + 1, hour)][:limit]


_refusals: dict[tuple, int] = {}


def refusing_pages(query: str, token: str | None) -> tuple[list, str | None]:
    """``article_pages`` behind an interface that refuses each page twice, and a query that starts with "never" always."""
    from .paged import Refused

    _refusals[query, token] = _refusals.get((query, token), 0) + 1
    if query.startswith("never") or _refusals[query, token] % 3:
        raise Refused(0.01)
    return article_pages(query, token)


def chain_blocks(chain: str, height: int, most: int) -> dict:
    """Blocks ten minutes apart with ``height`` modulo 4 transactions; block 93 is refused twice: a stand-in for ``fetch`` of the blocks source."""
    from .paged import Refused

    if height == 93:
        _refusals[chain, height] = _refusals.get((chain, height), 0) + 1
        if _refusals[chain, height] % 3:
            raise Refused(0.01)
    tx = [{"hash": f"{chain}{height}-{k}", "total": 2e8 * (k + 1), "inputs": [["a", "b"]], "outputs": [[]]} for k in range(height % 4)]
    return {"time": datetime(2024, 1, 1, tzinfo=UTC) + timedelta(minutes=10 * height), "tx": tx[:most]}
