"""Streams give what their batch twins give."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lodemark.operators.rollups import candles
from lodemark.operators.signals import cooldown
from lodemark.plans.tables import ticks
from lodemark.streaming import jobs


def stream_of(spark, df, path):
    df.write.mode("append").parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_candle_stream(spark, data, tmp_path):
    rows = ticks(spark, data)
    live = stream_of(spark, rows.withColumn("ts", F.col("ts").cast("timestamp")), str(tmp_path / "t"))
    got = run(spark, jobs.candle_stream(live, "1 hour"), "candle_stream", "complete")
    want = candles(rows, "1 hour")
    assert {(r.symbol, r.ts, r.open, r.close, r.volume) for r in got.collect()} == {(r.symbol, r.ts, r.open, r.close, r.volume) for r in want.collect()}


def test_dedup_and_batches(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(f"p{i % 7}", t0 + dt.timedelta(seconds=i)) for i in range(20)], "post_id string, ts timestamp")
    live = stream_of(spark, rows, str(tmp_path / "p"))
    assert run(spark, jobs.dedup_stream(live, ["post_id"]), "dedup_stream").count() == 7
    seen = []
    q = jobs.each_batch(stream_of(spark, rows, str(tmp_path / "q")), lambda df, i: seen.append(df.count()), str(tmp_path / "c"))
    q.awaitTermination(60)
    assert sum(seen) == 20


def test_cooldown_stream(spark, tmp_path):
    rng = random.Random(4)
    t0 = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(i, rng.choice("AB"), t0 + dt.timedelta(seconds=60 * i)) for i in range(120)], "id long, symbol string, ts timestamp")
    live = stream_of(spark, rows, str(tmp_path / "s"))
    got = {r.id for r in run(spark, jobs.cooldown_stream(live, 900), "cooldown_stream").collect()}
    assert got == {r.id for r in cooldown(rows, ["symbol"], 900).collect()}


def test_trailing_sentiment_stream(spark, data, tmp_path):
    from lodemark.operators.rollups import sentiment_trailing
    from lodemark.plans.tables import sentiment_scores

    rows = sentiment_scores(spark, data)
    live = stream_of(spark, rows.withColumn("ts", F.col("ts").cast("timestamp")), str(tmp_path / "t"))
    got = run(spark, jobs.trailing_sentiment_stream(live, 24), "trailing_stream", "complete")
    as_of = dt.datetime(2024, 1, 9)
    want = sentiment_trailing(rows.filter(F.col("ts") < F.lit(as_of).cast("timestamp_ntz")), F.lit(as_of).cast("timestamp_ntz"), {"24h": 24})
    columns = ["symbol", "n", "avg_score", "std_score", "bullish", "bearish", "neutral", "weighted"]
    assert sorted(map(tuple, got.filter("ts = TIMESTAMP '2024-01-09'").select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_token_bucket_stream(spark, tmp_path):
    rng, t0 = random.Random(8), dt.datetime(2024, 1, 1)
    rows = [(i, rng.choice("AB"), t0 + dt.timedelta(milliseconds=rng.randrange(60_000))) for i in range(200)]
    live = stream_of(spark, spark.createDataFrame(rows, "id long, symbol string, ts timestamp"), str(tmp_path / "b"))
    got = {r.id: r.allowed for r in run(spark, jobs.token_bucket_stream(live, 0.5, 5), "bucket_stream").collect()}
    left, last, want = {"A": 5.0, "B": 5.0}, {}, {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        left[k] = min(5.0, left[k] + (t - last.get(k, t)).total_seconds() * 0.5)
        last[k], want[i] = t, left[k] >= 1
        left[k] -= want[i]
    assert got == want and 0 < sum(got.values()) < 200


def test_changed_keys(spark):
    t = dt.datetime(2024, 1, 1)
    now = spark.createDataFrame([("A", t), ("B", t), ("C", t)], "symbol string, ts timestamp")
    seen = spark.createDataFrame([("A", t), ("B", t - dt.timedelta(1))], "symbol string, ts timestamp")
    assert {r.symbol for r in jobs.changed_keys(now, seen).collect()} == {"B", "C"}


def until(query, done, seconds=60):
    """Waits until ``done`` holds, then stops the query in whatever it is doing."""
    import time

    try:
        end = time.time() + seconds
        while not done() and time.time() < end:
            assert query.exception() is None, query.exception()
            time.sleep(0.3)
    finally:
        query.stop()
    assert done()


def start(df, folder, name):
    return df.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-checkpoint").outputMode("append").trigger(processingTime="200 milliseconds").start()


def written(spark, folder, name, schema):
    import glob

    return [tuple(r) for r in spark.read.schema(schema).parquet(f"{folder}/{name}").collect()] if glob.glob(f"{folder}/{name}/_spark_metadata/*") else []


def test_a_price_is_gone_after_its_time(spark, tmp_path):
    """The query is stopped while a price is live; the timer outlives it and takes the price away after the restart."""
    schema, out = "symbol string, ts timestamp, price double", "symbol string, price double, live boolean"
    ticks = lambda *rows: spark.createDataFrame(rows, "symbol string, t long, price double").select("symbol", F.timestamp_seconds("t").alias("ts"), "price").coalesce(1)
    ticks(("x", 5, 1.0), ("x", 9, 2.0), ("x", 7, 3.0), ("y", 1, 7.0)).write.parquet(f"{tmp_path}/in")
    live = lambda: jobs.price_cache_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 6)
    rows = lambda: sorted(written(spark, tmp_path, "cache", out))
    until(start(live(), tmp_path, "cache"), lambda: len(rows()) >= 2)
    assert rows() == [("x", 2.0, True), ("y", 7.0, True)]
    state = spark.read.format("statestore").option("stateVarName", "price").load(f"{tmp_path}/cache-checkpoint").selectExpr("key.symbol", "value.price").collect()
    assert sorted(map(tuple, state)) == [("x", 2.0), ("y", 7.0)]
    until(start(live(), tmp_path, "cache"), lambda: len(rows()) >= 4)
    assert rows() == [("x", 2.0, False), ("x", 2.0, True), ("y", 7.0, False), ("y", 7.0, True)]


def test_batches_leave_by_count_or_time_across_a_restart(spark, tmp_path):
    """23 rows, of which 7 come before a stop: whole batches leave by count, the rest by time, each row once and in batches that a run without a stop has too."""
    schema, out = "symbol string, id long", "symbol string, batch long, id long"
    put = lambda ids, mode: spark.createDataFrame([("x", i) for i in ids], schema).coalesce(1).write.mode(mode).parquet(f"{tmp_path}/in")
    live = lambda: jobs.flush_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), 10, 12)
    rows = lambda name: sorted(written(spark, tmp_path, name, out))
    put(range(7), "overwrite")
    query = start(live(), tmp_path, "flush")
    until(query, lambda: any(p["numInputRows"] for p in query.recentProgress))
    assert rows("flush") == []  # all seven are held
    held = spark.read.format("statestore").option("stateVarName", "held").load(f"{tmp_path}/flush-checkpoint").selectExpr("list_element.id").collect()
    assert sorted(r.id for r in held) == list(range(7))
    put(range(7, 23), "append")
    until(start(live(), tmp_path, "flush"), lambda: len(rows("flush")) >= 23)
    until(start(live(), tmp_path, "whole"), lambda: len(rows("whole")) >= 23)
    for name in ("flush", "whole"):
        got = rows(name)
        assert sorted(i for _, _, i in got) == list(range(23))
        assert [sum(b == k for _, b, _ in got) for k in range(3)] == [10, 10, 3]
