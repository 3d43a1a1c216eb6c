"""News linkage and the reports over it."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodemark.operators import news
from lodemark.operators.relational import insert_new

from .registry import query
from .tables import SYMBOLS, candles, news_articles

TABLES = ("news_articles", "candles_1h")
LINKED = """linkage AS (SELECT DISTINCT id AS news_id, ts, unnest(list_distinct(list_append(mentioned_coins, primary_symbol))) AS symbol FROM news_articles),
p AS (SELECT l.news_id, l.ts, l.symbol, c.close AS before FROM linkage l ASOF LEFT JOIN candles_1h c ON l.symbol = c.symbol AND l.ts >= c.ts),
joined0 AS (SELECT p.*, c.ts AS next_ts, c.close AS after FROM p ASOF LEFT JOIN candles_1h c ON p.symbol = c.symbol AND p.ts < c.ts),
linked AS (SELECT news_id, ts, symbol, CASE WHEN next_ts <= ts + INTERVAL 1 HOUR THEN round(100 * (after - before) / nullif(before, 0), 6) END AS price_change FROM joined0),
joined AS (SELECT a.*, l.symbol, l.price_change FROM news_articles a JOIN linked l ON a.id = l.news_id)"""


def linkage(spark, sf_dir):
    return news.link(news_articles(spark, sf_dir), list(SYMBOLS))


def joined(spark, sf_dir):
    linked = news.correlate(linkage(spark, sf_dir), candles(spark, sf_dir))
    return news.with_articles(linked, news_articles(spark, sf_dir))


@query(f"WITH {LINKED} SELECT news_id, ts, symbol FROM linkage", *TABLES)
def linkage_explode(spark, sf_dir):
    return linkage(spark, sf_dir)


@query(f"WITH {LINKED} SELECT * FROM linked", *TABLES)
def lagged_return(spark, sf_dir):
    return news.correlate(linkage(spark, sf_dir), candles(spark, sf_dir))


@query("SELECT id, primary_symbol FROM news_articles WHERE primary_symbol NOT IN ('click', 'view')", "news_articles")
def unlinked_news_anti(spark, sf_dir):
    articles = news_articles(spark, sf_dir)
    known = news.link(articles.filter(F.col("primary_symbol").isin("click", "view")), list(SYMBOLS))
    return news.unlinked(articles, known).select("id", "primary_symbol")


@query(f"WITH {LINKED} SELECT id, ts, source_name, title, price_change FROM joined WHERE symbol = 'click' AND ts > TIMESTAMP '2024-01-05' ORDER BY ts DESC, id LIMIT 100", *TABLES)
def news_price_correlation(spark, sf_dir):
    out = news.price_correlation(joined(spark, sf_dir), "click", F.lit("2024-01-05").cast("timestamp_ntz"), 100)
    return out.select("id", "ts", "source_name", "title", "price_change")


@query(
    f"""WITH {LINKED} SELECT source_name, count(*) AS articles, count(DISTINCT ts::DATE) AS days, round(avg(price_change), 6) AS avg_change, min(ts) AS first_ts, max(ts) AS last_ts
    FROM joined WHERE symbol = 'view' GROUP BY 1 ORDER BY articles DESC, source_name LIMIT 10""",
    *TABLES,
)
def news_top_sources(spark, sf_dir):
    return news.top_sources(joined(spark, sf_dir), "view")


@query(
    f"""WITH {LINKED} SELECT id, ts, price_change, CASE WHEN price_change > 0 THEN 'POSITIVE' WHEN price_change < 0 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS impact
    FROM joined WHERE symbol = 'purchase' AND abs(price_change) >= 5 ORDER BY abs(price_change) DESC, id LIMIT 20""",
    *TABLES,
)
def news_high_impact(spark, sf_dir):
    return news.high_impact(joined(spark, sf_dir), "purchase", 5.0, 20).select("id", "ts", "price_change", "impact")


@query(
    f"""WITH {LINKED} SELECT date_trunc('hour', ts) AS hour, count(*) AS articles, round(avg(price_change), 6) AS avg_change, min(price_change) AS min_change, max(price_change) AS max_change,
    string_agg(DISTINCT source_name, ', ' ORDER BY source_name) AS sources, count(DISTINCT id) AS ids FROM joined WHERE symbol = 'click' GROUP BY 1""",
    *TABLES,
)
def news_hourly_stats(spark, sf_dir):
    return news.hourly_stats(joined(spark, sf_dir), "click")


@query(
    f"""WITH {LINKED} SELECT array_to_string(list_sort(mentioned_coins), ',') AS coins, count(*) AS n, round(avg(price_change), 6) AS avg_change FROM joined WHERE symbol = 'click' GROUP BY 1 ORDER BY n DESC, coins LIMIT 10""",
    *TABLES,
)
def news_keyword_arrays(spark, sf_dir):
    return news.keyword_arrays(joined(spark, sf_dir), "click", 10)


@query(
    f"""WITH {LINKED} SELECT j.id, j.ts, j.symbol, j.source_name, j.price_change, c.ts AS r_ts, c.close AS r_close FROM joined j LEFT JOIN candles_1h c ON c.symbol = j.symbol AND c.ts BETWEEN j.ts AND j.ts + INTERVAL 1 HOUR
    WHERE j.symbol = 'signup' AND j.ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20'""",
    *TABLES,
)
def interval_join_news_price(spark, sf_dir):
    return news.for_price_analysis(joined(spark, sf_dir), candles(spark, sf_dir), "signup", F.lit("2024-01-03").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz"))


@query(
    f"""WITH {LINKED} SELECT 'articles' AS name, count(*) AS value FROM news_articles UNION ALL SELECT 'sources', count(DISTINCT source_name) FROM news_articles
    UNION ALL SELECT 'days', count(DISTINCT ts::DATE) FROM news_articles UNION ALL SELECT 'links', count(*) FROM joined UNION ALL SELECT 'correlated', count(price_change) FROM joined""",
    *TABLES,
)
def news_statistics(spark, sf_dir):
    return news.statistics(joined(spark, sf_dir), news_articles(spark, sf_dir))


@query(
    f"WITH {LINKED} SELECT symbol, count(*) AS links, count(price_change) AS correlated, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT source_name) AS sources FROM joined GROUP BY 1", *TABLES
)
def coverage_summary(spark, sf_dir):
    return joined(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("links"), F.count("price_change").alias("correlated"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.countDistinct("source_name").alias("sources"))


@query(
    "SELECT ts::DATE AS day, count(*) AS articles, count(DISTINCT source_name) AS sources, round(avg(length(content)), 6) AS avg_length FROM news_articles GROUP BY 1", "news_articles"
)
def collection_health(spark, sf_dir):
    return news_articles(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("articles"), F.countDistinct("source_name").alias("sources"), F.round(F.avg(F.length("content")), 6).alias("avg_length"))


@query("SELECT url_hash, min(id) AS id, count(*) AS copies FROM news_articles GROUP BY 1", "news_articles")
def url_hash_dedup(spark, sf_dir):
    return news_articles(spark, sf_dir).groupBy("url_hash").agg(F.min("id").alias("id"), F.count("*").alias("copies"))


@query(
    """WITH d AS (SELECT id, primary_symbol, ts FROM news_articles UNION ALL SELECT id, 'again', ts + INTERVAL 1 HOUR FROM news_articles WHERE ts >= TIMESTAMP '2024-01-10')
    SELECT id, CASE WHEN ts < TIMESTAMP '2024-01-20' THEN 'known' ELSE primary_symbol END AS primary_symbol, ts FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts, primary_symbol) = 1""",
    "news_articles",
)
def insert_do_nothing(spark, sf_dir):
    """Keep-first insert: the table has the articles before the 20th, the delta all of them, and those from the 10th on once more."""
    rows = news_articles(spark, sf_dir).select("id", "primary_symbol", "ts")
    base = rows.filter(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")).withColumn("primary_symbol", F.lit("known"))
    again = rows.filter(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")).select("id", F.lit("again").alias("primary_symbol"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"))
    return base.unionByName(insert_new(base, rows.unionByName(again), ["id"], ["ts", "primary_symbol"]))

