import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodemark.operators import sinks
from lodemark.sources import dumps, files, nested, paged, synthetic


def test_dump(spark, tmp_path):
    p = tmp_path / "d.sql"
    p.write_text("INSERT INTO x VALUES\n('A','1h','2024-01-01 00:00:00',1,2,0.5,1.5,10,NULL),\n('A','1h','2024-01-01 01:00:00',1,2,0.5,'1.6',10,3),\n('A','1h','bad',1,2,0.5,1.6,10,3);\n(short)\n('it''s, so','1h','2024-01-01 00:00:00',1,2,0.5,1.5,10,NULL)\n")
    assert [r.close for r in dumps.read_prices(spark, str(p), "A", "1h", 5).collect()] == [1.5, 1.6]
    assert dumps.read_tuples(spark, str(p), 9).filter(F.col("f")[0] == "it's, so").count() == 1


def test_files(spark, tmp_path):
    (tmp_path / "c.csv").write_text("symbol,open,high,low,close,volume\nA,1,2,0.5,1.5,10\nA,x,2,0.5,1.5,10\nA,1,2,-1,1.5,10\n")
    raw = spark.read.csv(str(tmp_path / "c.csv"), header=True)
    assert files.non_negative_ticks(raw).count() == 1
    assert files.read_csv(spark, str(tmp_path / "c.csv"), "symbol string, open double").filter("open IS NULL").count() == 1
    assert str(files.read_csv(spark, str(tmp_path / "c.csv"), "symbol string, high decimal(18,2)").first().high) == "2.00"


def test_paged(spark):
    paged.register(spark)
    df = spark.read.format("klines").option("symbols", "A,B").option("start", "0").option("end", str(48 * 3_600_000)).option("range", str(24 * 3_600_000)).option("limit", "10").option("fetch", "lodemark.sources.synthetic:hourly_pages").load()
    assert df.count() == 96 and df.select("symbol", "ts").distinct().count() == 96


def test_articles(spark):
    paged.register(spark)
    got = {r.url: r for r in paged.articles(spark, ["a", "b"], "lodemark.sources.synthetic:article_pages").collect()}
    assert set(got) == {"http://a/0", "http://a/1", "http://a/2", "http://b/0", "http://b/1", "http://b/2", "http://all/x"}
    assert got["http://all/x"].query == "a"
    few = {r.url for r in paged.articles(spark, ["a", "b"], "lodemark.sources.synthetic:article_pages", quota=3).collect()}
    assert few == {"http://a/0", "http://a/1", "http://b/0", "http://all/x"}


def test_articles_behind_refusals(spark):
    """Each page is refused twice and read all the same; a query that is always refused ends, and a comma is part of a query."""
    paged.register(spark)
    pages = "lodemark.sources.synthetic:refusing_pages"
    got = {r.url: r.query for r in paged.articles(spark, ["a, b", "never"], pages, wait=0.01).collect()}
    assert set(got) == {"http://a, b/0", "http://a, b/1", "http://a, b/2", "http://all/x"} and set(got.values()) == {"a, b"}
    assert paged.articles(spark, ["never 2"], pages, tries=3, wait=0.01).count() == 0
    waits = []

    def refuse():
        raise paged.Refused

    assert paged.with_backoff(refuse, 6, 1.0, 5.0, waits.append) is None and waits == [1.0, 2.0, 4.0, 5.0, 5.0]


def test_walk_and_posts(spark):
    rows = [(h, ["t"] * (h % 4)) for h in range(500, 3200, 7)]
    blocks = spark.createDataFrame(rows, "height int, tx array<string>")
    want, n = set(), 0
    for h, tx in sorted(rows, reverse=True):
        if h <= 3000 and n < 300:
            want.add(h)
            n += len(tx)
    assert {r.height for r in nested.walk_blocks(blocks, 3000, 300).collect()} == want
    posts = [(f"p{i}", "ab"[i % 2], i, 10 * i) for i in range(10)] + [("p8", "b", 1, 99)]
    got = nested.hot_posts(spark.createDataFrame(posts, "post_id string, subreddit string, rank int, score int"), 6, 2, 15).collect()
    assert [(r.subreddit, r.post_id) for r in got] == [("a", "p2"), ("a", "p4"), ("b", "p8"), ("b", "p3")]


def test_blocks(spark):
    """A walk stops at its time bound, its transactions or its blocks, goes on below the lowest block, and reads past refusals."""
    paged.register(spark)
    fetch, t0 = "lodemark.sources.synthetic:chain_blocks", dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    since = t0 + dt.timedelta(minutes=900)
    whole = paged.blocks(spark, {"btc": 100, "ltc": 2}, fetch, since - dt.timedelta(days=9), wait=0.01).collect()
    assert {r.height for r in whole if r.chain == "btc"} == set(range(1, 101)) and [r.height for r in whole if r.chain == "ltc"] == [2, 1]
    assert {r.height for r in paged.blocks(spark, {"btc": 100}, fetch, since, wait=0.01).collect()} == set(range(90, 101))
    cut = paged.blocks(spark, {"btc": 100}, fetch, since, wait=0.01, transactions=8).collect()
    assert [(r.height, len(r.tx)) for r in cut] == [(100, 0), (99, 3), (98, 2), (97, 1), (96, 0), (95, 2)]
    first = paged.blocks(spark, {"btc": 100, "ltc": 95}, fetch, since, wait=0.01, blocks=4)
    assert first.count() == 8
    on = paged.next_heights(first)
    assert on == {"btc": 96, "ltc": 91}
    rest = paged.blocks(spark, on, fetch, since, wait=0.01)
    both = first.unionByName(rest)
    assert both.filter("chain = 'btc'").count() == 11 and both.select("chain", "height").distinct().count() == both.count()
    sums = nested.chain_transactions(both.filter("chain = 'btc'"), 1e8, 40_000.0).collect()
    assert len(sums) == sum(h % 4 for h in range(90, 101)) and {r.to_address for r in sums} == {"unknown"} and {r.from_address for r in sums} == {"a"}


def test_require(spark):
    spark.range(1).createOrReplaceTempView("here")
    files.require(spark, "here")
    with pytest.raises(LookupError, match="nowhere, gone"):
        files.require(spark, "here", "nowhere", "gone")


def test_long_literal(spark, tmp_path):
    p = tmp_path / "l.sql"
    p.write_text("(1,'" + "it\'\'s, " * 200_000 + "',NULL,'a\'\'b','')")
    f = dumps.read_tuples(spark, str(p), 5).first().f
    assert f[0] == "1" and len(f[1]) == 6 * 200_000 and f[2] is None and f[3:] == ["a'b", ""]


def test_nested(spark):
    raw = spark.createDataFrame([('{"data":{"k":{"s":"A","t":0,"o":"1","h":"2","l":"0.5","c":"1.5","v":"3","x":true}}}',), ("junk",), ('{"data":{"k":{"s":"A","t":0,"o":"-1","h":"2","l":"0.5","c":"1.5","v":"3","x":true}}}',)], "value string")
    assert nested.decode_klines(raw).count() == 1
    blocks = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), [("h", 10**8, [], [(["x"],)])])], "height int, time timestamp_ntz, tx array<struct<hash string, total long, inputs array<struct<addresses array<string>>>, outputs array<struct<addresses array<string>>>>>")
    row = nested.chain_transactions(blocks, 1e8, 2_000_000.0).first()
    assert (row.from_address, row.to_address, row.amount, row.is_whale) == ("unknown", "x", 1.0, True)
    feed = spark.createDataFrame([("<rss><channel><item><title>a</title><link>l</link><pubDate>p</pubDate></item><item><title> </title><link>m</link></item></channel></rss>",)], "xml string")
    assert [r.title for r in nested.feed_items(feed).collect()] == ["a"]


def test_synthetic(spark):
    rows = synthetic.drift_prices(spark, 50, ["A", "B"]).orderBy("symbol", "ts").collect()
    assert len(rows) == 100 and abs(rows[1].close / rows[0].close - (1 - 0.0007)) < 1e-12
    assert synthetic.proxy_sentiment(synthetic.drift_prices(spark, 5, ["A"])).count() == 5


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("A", 1, 1.0), ("B", 2, float("nan"))], "symbol string, k int, v double")
    table = str(tmp_path / "t")
    sinks.append(df, table, ["symbol"])
    sinks.upsert_partitions(spark.createDataFrame([("A", 1, 5.0), ("A", 3, 6.0)], df.schema), table, ["symbol", "k"], ["symbol"])
    assert {(r.symbol, r.k, str(r.v)) for r in spark.read.parquet(table).collect()} == {("A", 1, "5.0"), ("A", 3, "6.0"), ("B", 2, "nan")}
    sinks.write_sql(df, str(tmp_path / "s"), "t", {"symbol": "string", "k": "number", "v": "number"}, 1, "(k) DO NOTHING")
    assert spark.read.text(str(tmp_path / "s")).filter(F.col("value").contains("('B', 2, NULL) ON CONFLICT")).count() == 1
    assert spark.read.text(str(tmp_path / "s")).count() == 2
    sinks.write_jsonl(df.withColumn("text", F.lit("é")), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().text == "é"
    reg = spark.createDataFrame([("m", "v3"), ("m", "v10"), ("m", "odd")], "model_name string, model_version string")
    assert {r.model_version for r in sinks.next_versions(reg, spark.createDataFrame([("m",), ("n",)], "model_name string")).collect()} == {"v11", "v1"}
    left, rest = sinks.delete_cascade(df, spark.createDataFrame([(1,), (2,)], "ref int"), F.col("k") == 1, "k", "ref")
    assert (left.count(), rest.count()) == (1, 1)
