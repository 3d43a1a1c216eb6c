"""Nested records to rows: kline messages, chain transactions, comments, feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KLINE = "data struct<k struct<s string, t long, o string, h string, l string, c string, v string, x boolean>>"


def decode_klines(raw: DataFrame, value: str = "value") -> DataFrame:
    """Candles of stream messages; messages that don't parse, or with negative values, are left out."""
    k = F.from_json(F.col(value).cast("string"), KLINE)["data"]["k"]
    numbers = {n: k[c].try_cast("double").alias(n) for n, c in (("open", "o"), ("high", "h"), ("low", "l"), ("close", "c"), ("volume", "v"))}
    out = raw.select(k["s"].alias("symbol"), F.timestamp_millis(k["t"]).alias("ts"), *numbers.values(), k["x"].alias("closed"))
    return out.dropna(subset=["symbol", "ts", *numbers]).filter(F.least(*(F.col(n) for n in numbers)) >= 0)


def chain_transactions(blocks: DataFrame, unit: float, price: float, whale_usd: float = 1_000_000.0) -> DataFrame:
    """Rows of (height, time, tx array<struct<hash, total, inputs, outputs>>) as transfers; missing addresses are "unknown"."""
    tx = blocks.select("height", "time", F.explode("tx").alias("t"))
    first = lambda c: F.coalesce(F.get(F.get(F.col(f"t.{c}"), F.lit(0))["addresses"], F.lit(0)), F.lit("unknown"))
    out = tx.select(F.col("t.hash").alias("tx_hash"), F.col("time").alias("ts"), (F.col("t.total") / F.lit(unit)).alias("amount"), first("inputs").alias("from_address"), first("outputs").alias("to_address"))
    return out.withColumn("amount_usd", F.col("amount") * price).withColumn("is_whale", F.col("amount_usd") >= whale_usd)


def walk_blocks(blocks: DataFrame, height: int, budget: int) -> DataFrame:
    """Blocks from ``height`` downwards while the transactions of those before them are fewer than ``budget``.

    Counts are summed by ranges of 1,000 heights first, so that no sort holds more than a range or one row for each of them.
    """
    rows = blocks.filter(F.col("height") <= height).withColumns({"_n": F.size("tx"), "_range": F.floor(F.col("height") / 1000)})
    ranges = rows.groupBy("_range").agg(F.sum("_n").alias("_sum"))
    ranges = ranges.withColumn("_above", F.coalesce(F.sum("_sum").over(Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    inside = Window.partitionBy("_range").orderBy(F.desc("height")).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_above") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    return rows.join(ranges, "_range").withColumn("_before", before).filter(F.col("_before") < budget).select(*blocks.columns)


def hot_posts(posts: DataFrame, limit: int, sources: int, least_score: int) -> DataFrame:
    """Of each of ``sources`` subreddits its first ``limit`` / ``sources`` posts in order of rank, those with ``least_score`` or more; of a repeated post the last read."""
    w = Window.partitionBy("subreddit").orderBy("rank", "post_id")
    some = posts.withColumn("_n", F.row_number().over(w)).filter((F.col("_n") <= max(1, limit // sources)) & (F.col("score") >= least_score)).drop("_n")
    last = F.max_by(F.struct(*posts.columns), F.struct("subreddit", "rank")).alias("_r")
    return some.groupBy("post_id").agg(last).select("_r.*").orderBy("subreddit", "rank").limit(limit)


def comments(posts: DataFrame, most: int, least_ratio: float) -> DataFrame:
    """The first ``most`` comments of each post whose share of votes is ``least_ratio`` or more."""
    some = F.filter(F.slice("comments", 1, most), lambda c: c["upvote_ratio"] >= least_ratio)
    return posts.select("post_id", F.explode(some).alias("c")).select("post_id", "c.*")


def feed_items(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """Items of RSS documents that have a title and a link; published falls back to updated."""
    get = lambda tag: F.xpath(xml, F.lit(f"//item/{tag}/text()"))
    item = F.explode(F.arrays_zip(get("title").alias("title"), get("link").alias("link"), get("pubDate").alias("published"), get("updated").alias("updated")))
    rows = feeds.select(item.alias("i")).select("i.title", "i.link", F.coalesce("i.published", "i.updated").alias("published"))
    return rows.filter((F.trim("title") != "") & (F.trim("link") != ""))
