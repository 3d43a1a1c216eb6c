"""News linkage: articles to symbols, lagged returns, and the reports over both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .temporal import interval_join, lagged_return


def link(articles: DataFrame, tracked: list[str]) -> DataFrame:
    """A row for each article and tracked symbol that it mentions or is about."""
    symbols = F.array_union(F.coalesce("mentioned_coins", F.array().cast("array<string>")), F.array_compact(F.array("primary_symbol")))
    return articles.select(F.col("id").alias("news_id"), "ts", F.explode(F.array_intersect(symbols, F.array(*map(F.lit, tracked)))).alias("symbol"))


def unlinked(articles: DataFrame, linkage: DataFrame) -> DataFrame:
    return articles.join(linkage.select(F.col("news_id").alias("id")), "id", "left_anti")


def correlate(linkage: DataFrame, bars: DataFrame, hours: int = 1) -> DataFrame:
    return lagged_return(linkage, bars, hours=hours)


def with_articles(linked: DataFrame, articles: DataFrame) -> DataFrame:
    return articles.join(linked.select(F.col("news_id").alias("id"), "symbol", "price_change"), "id")


def price_correlation(joined: DataFrame, symbol: str, since: Column, limit: int) -> DataFrame:
    rows = joined.filter((F.col("symbol") == symbol) & (F.col("ts") > since))
    return rows.orderBy(F.desc("ts"), "id").limit(limit)


def top_sources(joined: DataFrame, symbol: str, limit: int = 10) -> DataFrame:
    rows = joined.filter(F.col("symbol") == symbol).groupBy("source_name")
    out = rows.agg(F.count("*").alias("articles"), F.countDistinct(F.to_date("ts")).alias("days"), F.round(F.avg("price_change"), 6).alias("avg_change"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return out.orderBy(F.desc("articles"), "source_name").limit(limit)


def high_impact(joined: DataFrame, symbol: str, least: float, limit: int) -> DataFrame:
    impact = F.when(F.col("price_change") > 0, "POSITIVE").when(F.col("price_change") < 0, "NEGATIVE").otherwise("NEUTRAL")
    rows = joined.filter((F.col("symbol") == symbol) & (F.abs("price_change") >= least))
    return rows.withColumn("impact", impact).orderBy(F.abs("price_change").desc(), "id").limit(limit)


def hourly_stats(joined: DataFrame, symbol: str) -> DataFrame:
    return joined.filter(F.col("symbol") == symbol).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(
        F.count("*").alias("articles"), F.round(F.avg("price_change"), 6).alias("avg_change"), F.min("price_change").alias("min_change"), F.max("price_change").alias("max_change"),
        F.array_join(F.array_sort(F.collect_set("source_name")), ", ").alias("sources"), F.countDistinct("id").alias("ids"),
    )


def keyword_arrays(joined: DataFrame, symbol: str, limit: int) -> DataFrame:
    rows = joined.filter(F.col("symbol") == symbol).groupBy(F.array_join(F.array_sort("mentioned_coins"), ",").alias("coins"))
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("price_change"), 6).alias("avg_change")).orderBy(F.desc("n"), "coins").limit(limit)


def for_price_analysis(joined: DataFrame, bars: DataFrame, symbol: str, start: Column, end: Column) -> DataFrame:
    """Articles of a symbol in a time range with the candles of the hour after each: a candle on either edge counts, so rows may repeat."""
    rows = joined.filter((F.col("symbol") == symbol) & F.col("ts").between(start, end)).select("id", "ts", "symbol", "source_name", "price_change")
    return interval_join(rows, bars.select("symbol", "ts", "close"), ["symbol"], F.col("ts"), F.col("ts") + F.expr("INTERVAL 1 HOUR"), "ts", 3600)


def statistics(joined: DataFrame, articles: DataFrame) -> DataFrame:
    """Name and value of each figure, one row each."""
    a = articles.agg(F.count("*").alias("articles"), F.countDistinct("source_name").alias("sources"), F.countDistinct(F.to_date("ts")).alias("days"))
    b = joined.agg(F.count("*").alias("links"), F.count("price_change").alias("correlated"))
    pairs = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("value")) for c in (*a.columns, *b.columns)))
    return a.crossJoin(b).select(F.inline(pairs))  # one row by one row
