"""Structured Streaming twins of the batch operators.

Event time is a timestamp with time zone (watermarks take no other); late rows beyond the watermark are dropped here and put right by the
batch recomputation, which uses the same functions.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from lodemark.operators.rollups import candle_values, sentiment_values


def candle_stream(ticks: DataFrame, width: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Candles of a tick stream (symbol, ts, event_id, price, size)."""
    bars = ticks.withWatermark("ts", late).groupBy(F.window("ts", width), "symbol").agg(*candle_values())
    return bars.select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume", "trade_count")


def trailing_sentiment_stream(scores: DataFrame, hours: int, slide: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Sentiment of the last ``hours`` by symbol, at the end of each ``slide``: the trailing windows as sliding ones."""
    rows = scores.withWatermark("ts", late).groupBy(F.window("ts", f"{hours} hours", slide), "symbol").agg(*sentiment_values())
    return rows.select("symbol", F.col("window.end").alias("ts"), "n", "avg_score", "std_score", "bullish", "bearish", "neutral", "weighted")


class Bucket(StatefulProcessor):
    """Tokens left and the time they were counted, for each key: ``per_second`` flow in, ``most`` fit, and each request takes one or is refused."""

    def __init__(self, per_second: float, most: float):
        self.per_second, self.most = per_second, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.left = handle.getValueState("left", "tokens double, us long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        tokens, last = self.left.get() if self.left.exists() else (float(self.most), None)
        frame = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "id"])
        allowed = []
        for us in frame["ts"].astype("datetime64[us]").astype("int64").tolist():
            since = 0 if last is None else max(0, us - last)
            tokens, last = min(self.most, tokens + since / 1e6 * self.per_second), us if last is None else max(last, us)
            allowed.append(tokens >= 1)
            tokens -= tokens >= 1
        self.left.update((float(tokens), last))
        yield pd.DataFrame({"symbol": key[0], "id": frame["id"], "allowed": allowed})

    def close(self) -> None:
        pass


def token_bucket_stream(requests: DataFrame, per_second: float, most: float) -> DataFrame:
    """symbol, id and whether it is allowed, of a stream (id, symbol, ts) of requests. Needs the RocksDB state store."""
    return requests.groupBy("symbol").transformWithStateInPandas(Bucket(per_second, most), "symbol string, id long, allowed boolean", "Append", "None")


def dedup_stream(posts: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Drops ids seen before, for as long as the watermark keeps them."""
    return posts.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def rate_stream(posts: DataFrame, width: str = "60 seconds", slide: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    return posts.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "symbol").agg(F.count("*").alias("n")).select("symbol", F.col("window.end").alias("ts"), "n")


def session_stream(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


class Cooldown(StatefulProcessor):
    """Keeps the time of the last signal let through for each key, and lets the next one through after ``seconds``."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "us long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        last = self.last.get()[0] if self.last.exists() else None
        kept = []
        frame = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "id"])
        times = frame["ts"].astype("datetime64[us]").astype("int64")
        for us, signal in zip(times.tolist(), frame["id"].tolist(), strict=True):
            if last is None or us - last >= self.seconds * 10**6:
                last = us
                kept.append(signal)
        if kept:
            self.last.update((last,))
        yield pd.DataFrame({"symbol": [key[0]] * len(kept), "id": kept})

    def close(self) -> None:
        pass


def cooldown_stream(signals: DataFrame, seconds: int) -> DataFrame:
    """Ids let through of a stream (id, symbol, ts); one key's rows of a batch are in order of time. Needs the RocksDB state store."""
    return signals.groupBy("symbol").transformWithStateInPandas(Cooldown(seconds), "symbol string, id long", "Append", "None")


class PriceCache(StatefulProcessor):
    """The last price of a key, which is gone ``seconds`` after its last tick came in: a timer takes it away and says so."""

    def __init__(self, seconds: float):
        self.millis = int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.price = handle, handle.getValueState("price", "us long, price double")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        best = self.price.get() if self.price.exists() else None
        for frame in rows:
            times = frame["ts"].astype("datetime64[us]").astype("int64")
            for us, price in zip(times.tolist(), frame["price"].tolist(), strict=True):
                if best is None or us >= best[0]:
                    best = (us, price)
        self.price.update((best[0], best[1]))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.millis)
        yield pd.DataFrame({"symbol": [key[0]], "price": [best[1]], "live": [True]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        price = self.price.get()[1] if self.price.exists() else None
        self.price.clear()
        yield pd.DataFrame({"symbol": [key[0]], "price": [price], "live": [False]})

    def close(self) -> None:
        pass


def price_cache_stream(ticks: DataFrame, seconds: float = 30) -> DataFrame:
    """symbol, price, live of a stream (symbol, ts, price): a row for each key with new ticks, and one that isn't live when its time is over. Needs the RocksDB state store."""
    return ticks.groupBy("symbol").transformWithStateInPandas(PriceCache(seconds), "symbol string, price double, live boolean", "Append", "ProcessingTime")


class Flush(StatefulProcessor):
    """Gathers ids of a key in a list and lets them go as a batch at ``most`` of them, or ``seconds`` after the first of them came in."""

    def __init__(self, most: int, seconds: float):
        self.most, self.millis = most, int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held, self.number = handle.getListState("held", "id long"), handle.getValueState("number", "n long")

    def _out(self, key, batches: list[list[int]]) -> pd.DataFrame:
        first = self.number.get()[0] if self.number.exists() else 0
        self.number.update((first + len(batches),))
        rows = [(key[0], first + k, i) for k, ids in enumerate(batches) for i in ids]
        return pd.DataFrame(rows, columns=["symbol", "batch", "id"])

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        held, had = [r[0] for r in self.held.get()] if self.held.exists() else [], False
        had = bool(held)
        for frame in rows:
            held += frame["id"].tolist()
            full = len(held) // self.most
            if full:
                yield self._out(key, [held[k * self.most : (k + 1) * self.most] for k in range(full)])
                held, had = held[full * self.most :], False
        timers = list(self.handle.listTimers())
        if not had:  # the first of those held is new
            for old in timers:
                self.handle.deleteTimer(old)
            if held:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.millis)
        if held:
            self.held.put([(int(i),) for i in held])
        else:
            self.held.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        held = [r[0] for r in self.held.get()] if self.held.exists() else []
        self.held.clear()
        if held:
            yield self._out(key, [held])

    def close(self) -> None:
        pass


def flush_stream(rows: DataFrame, most: int = 10, seconds: float = 5) -> DataFrame:
    """symbol, batch (numbered from 0 by key), id of a stream (symbol, id). What is held is state, so a restart from the checkpoint loses and repeats nothing. Needs the RocksDB state store."""
    return rows.groupBy("symbol").transformWithStateInPandas(Flush(most, seconds), "symbol string, batch long, id long", "Append", "ProcessingTime")


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Runs ``write`` (an idempotent upsert, an aggregate, a callback) on each micro-batch."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest_prices(batch: DataFrame) -> DataFrame:
    """The last tick of each symbol in a batch, for a cache."""
    return batch.groupBy("symbol").agg(F.max_by(F.struct("ts", "event_id", "price"), F.struct("ts", "event_id")).alias("r")).select("symbol", "r.*")


def changed_keys(now: DataFrame, seen: DataFrame) -> DataFrame:
    """Keys whose last time is later than when they were last worked on."""
    last = now.groupBy("symbol").agg(F.max("ts").alias("last_ts"))
    return last.join(seen.withColumnRenamed("ts", "_seen"), "symbol", "left").filter(F.col("_seen").isNull() | (F.col("last_ts") > F.col("_seen"))).select("symbol", "last_ts")
