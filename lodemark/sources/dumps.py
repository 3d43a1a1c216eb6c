"""Tuples of SQL dumps: one ``( ... )`` per line, quoted with single quotes. Lines that aren't tuples, or don't fit, are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_tuples(spark: SparkSession, path: str, fields: int) -> DataFrame:
    """Lines with at least ``fields`` fields, as ``f``: an array of strings (NULL becomes null)."""
    line = F.regexp_replace(F.trim("value"), r"[,;]\s*$", "")
    rows = spark.read.text(path).select(line.alias("l")).filter(F.col("l").startswith("(") & F.col("l").endswith(")"))
    inner = F.expr("substring(l, 2, length(l) - 2)")
    # A field is a literal, in which quotes are doubled, or whatever has no comma; each character is looked at once.
    parts = F.regexp_extract_all(inner, F.lit(r"(?:^|,)(\s*+'[^']*+(?:''[^']*+)*+'|[^,]*+)"), 1)

    def value(x: Column) -> Column:
        x = F.trim(x)
        text = F.replace(F.regexp_replace(x, r"^'|'$", ""), F.lit("''"), F.lit("'"))
        return F.when(F.upper(x) == "NULL", None).otherwise(F.when(x.startswith("'"), text).otherwise(x))

    return rows.select(F.transform(parts, value).alias("f")).filter(F.size("f") >= fields)


def typed(rows: DataFrame, columns: dict[str, tuple[int, str]], required: list[str]) -> DataFrame:
    """{name: (place, type)}; rows in which a required value is missing or doesn't parse are left out."""
    out = rows.select(*(F.get("f", F.lit(i)).try_cast(t).alias(n) for n, (i, t) in columns.items()))
    return out.dropna(subset=required)


def read_prices(spark: SparkSession, path: str, symbol: str, interval: str, limit: int) -> DataFrame:
    """The last ``limit`` candles of a symbol and interval in a dump of (symbol, interval, ts, open, high, low, close, volume, quote)."""
    columns = {"symbol": (0, "string"), "interval": (1, "string"), "ts": (2, "timestamp_ntz"), **{n: (i, "double") for i, n in enumerate(("open", "high", "low", "close", "volume"), 3)}}
    rows = typed(read_tuples(spark, path, 9), columns, ["ts", "close"]).filter((F.col("symbol") == symbol) & (F.col("interval") == interval))
    return rows.orderBy(F.desc("ts")).limit(limit).orderBy("ts")


def latest_per_symbol(rows: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")
