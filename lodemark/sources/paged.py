"""Python data sources for interfaces that give candles or articles page by page.

Candles: one partition for each symbol, interval and time range, so that ranges are fetched side by side. ``fetch`` names a function
``module:function`` (symbol, interval, start_ms, end_ms, limit) that returns rows of [open_time, open, high, low, close, volume, ...]; a
page that is empty, short or doesn't advance ends a partition.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "symbol string, interval string, ts timestamp, open double, high double, low double, close double, volume double"


class Range(InputPartition):
    def __init__(self, symbol: str, interval: str, start: int, end: int):
        self.symbol, self.interval, self.start, self.end = symbol, interval, start, end


class KlineReader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = dict(options)

    def partitions(self) -> list[Range]:
        start, end, step = int(self.o["start"]), int(self.o["end"]), int(self.o.get("range", 30 * 86_400_000))
        return [Range(s, i, a, min(end, a + step)) for s in self.o["symbols"].split(",") for i in self.o.get("intervals", "1h").split(",") for a in range(start, end, step)]

    def read(self, partition: Range) -> Iterator[tuple]:
        module, name = self.o["fetch"].split(":")
        fetch, limit, cursor = getattr(importlib.import_module(module), name), int(self.o.get("limit", 1000)), partition.start
        while cursor < partition.end:
            page = fetch(partition.symbol, partition.interval, cursor, partition.end - 1, limit)
            for k in page:
                yield (partition.symbol, partition.interval, datetime.fromtimestamp(k[0] / 1000, UTC), *map(float, k[1:6]))
            if len(page) < limit or page[-1][0] + 1 <= cursor:
                return
            cursor = page[-1][0] + 1


class Refused(Exception):
    """What a fetch raises when it is told to come back later; ``after``: seconds, if it was told."""

    def __init__(self, after: float | None = None):
        super().__init__(after)
        self.after = after


def with_backoff(call: Callable, tries: int = 4, wait: float = 1.0, most: float = 60.0, sleep: Callable = time.sleep):
    """What ``call`` returns; after a refusal it is tried again, with waits that double from ``wait`` to ``most`` seconds or are as long as told. None after ``tries`` refusals."""
    for k in range(tries):
        try:
            return call()
        except Refused as told:
            if k + 1 < tries:
                sleep(min(most, wait * 2**k if told.after is None else told.after))
    return None


class Query(InputPartition):
    def __init__(self, query: str, requests: int):
        self.query, self.requests = query, requests


class ArticleReader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = dict(options)

    def partitions(self) -> list[Query]:
        queries = [q for q in json.loads(self.o["queries"]) if q]
        quota = int(self.o.get("quota", 2000))
        return [Query(q, quota // len(queries) + (i < quota % len(queries))) for i, q in enumerate(queries)]

    def read(self, partition: Query) -> Iterator[tuple]:
        module, name = self.o["fetch"].split(":")
        fetch, most, token, seen = getattr(importlib.import_module(module), name), int(self.o.get("limit", 100)), None, {None}
        for _ in range(partition.requests):
            page = with_backoff(lambda: fetch(partition.query, token), int(self.o.get("tries", 4)), float(self.o.get("wait", 1.0)))  # noqa: B023
            if page is None:  # refused for good: what has been read stays
                return
            rows, token = page
            for url, title, published in rows[:most]:
                if url and title:
                    yield partition.query, url, title, published
            if not rows or token in seen:  # no next page, or one that has been read
                return
            seen.add(token)


class Articles(DataSource):
    """Search results of many queries: one partition for each, which follows page tokens (or the addresses of next pages) while its share of the ``quota`` of
    requests lasts. ``fetch`` names a function (query, token) that returns rows of (url, title, published) and the next token, None at the end, or raises
    ``Refused``: it is then tried again up to ``tries`` times with waits that double from ``wait`` seconds; a query that is refused for good ends with what it has."""

    @classmethod
    def name(cls) -> str:
        return "articles"

    def schema(self) -> str:
        return "query string, url string, title string, published string"

    def reader(self, schema) -> ArticleReader:
        return ArticleReader(self.options)


class Chain(InputPartition):
    def __init__(self, chain: str, height: int):
        self.chain, self.height = chain, height


class BlockReader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = dict(options)

    def partitions(self) -> list[Chain]:
        return [Chain(c, int(h)) for c, h in json.loads(self.o["heights"]).items()]

    def read(self, partition: Chain) -> Iterator[tuple]:
        module, name = self.o["fetch"].split(":")
        fetch, since = getattr(importlib.import_module(module), name), datetime.fromisoformat(self.o["since"])
        blocks, left, height = int(self.o.get("blocks", 1000)), int(self.o.get("transactions", 100_000)), partition.height
        while height > 0 and blocks > 0 and left > 0:
            block = with_backoff(lambda: fetch(partition.chain, height, left), int(self.o.get("tries", 4)), float(self.o.get("wait", 1.0)))  # noqa: B023
            if block is None or (block["time"] is not None and block["time"] < since):  # refused for good, or older than asked for
                return
            tx = [(t["hash"], t["total"], [(i,) for i in t["inputs"]], [(o,) for o in t["outputs"]]) for t in block["tx"][:left]]
            yield partition.chain, height, block["time"], tx
            blocks, left, height = blocks - 1, left - len(tx), height - 1


class Blocks(DataSource):
    """Blocks of chains, one partition each, from a height downwards until a block is older than ``since``, or ``blocks`` blocks or ``transactions``
    transactions have been read; the last block is cut to what is left of these. ``fetch`` names a function (chain, height, most) that returns a dict of
    time and tx (dicts of hash, total, and lists of addresses for each of inputs and outputs), or raises ``Refused``, as for articles. A walk follows one
    chain's heights, so chains are its parallelism."""

    @classmethod
    def name(cls) -> str:
        return "blocks"

    def schema(self) -> str:
        side = "array<struct<addresses array<string>>>"
        return f"chain string, height long, time timestamp, tx array<struct<hash string, total double, inputs {side}, outputs {side}>>"

    def reader(self, schema) -> BlockReader:
        return BlockReader(self.options)


class Klines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "klines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> KlineReader:
        return KlineReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Klines)
    spark.dataSource.register(Articles)
    spark.dataSource.register(Blocks)


def blocks(spark: SparkSession, heights: dict[str, int], fetch: str, since: datetime, **options: int | float) -> DataFrame:
    """Rows of the blocks source, for ``nested.chain_transactions``; ``heights``: of each chain, the first to read."""
    reader = spark.read.format("blocks").option("heights", json.dumps(heights)).option("fetch", fetch).option("since", since.isoformat())
    return reader.options(**{k: str(v) for k, v in options.items()}).load()


def next_heights(read: DataFrame) -> dict[str, int]:
    """Where a walk goes on after the blocks read: below the lowest of each chain (a row for each chain reaches the driver)."""
    return {r.chain: r.height - 1 for r in read.groupBy("chain").agg(F.min("height").alias("height")).collect()}


def articles(spark: SparkSession, queries: list[str], fetch: str, quota: int = 2000, limit: int = 100, tries: int = 4, wait: float = 1.0) -> DataFrame:
    """Each address once, with the first of the queries (by name) that found it."""
    rows = spark.read.format("articles").option("queries", json.dumps(queries)).option("fetch", fetch).option("quota", str(quota)).option("limit", str(limit)).option("tries", str(tries)).option("wait", str(wait)).load()
    return rows.groupBy("url").agg(F.min_by(F.struct("query", "title", "published"), F.struct("query", "title")).alias("r")).select("url", "r.*")
