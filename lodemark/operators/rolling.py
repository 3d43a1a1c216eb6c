"""Rolling windows, recurrences and ranks over time-ordered rows of each key.

All functions take ``w``: a window by key in order of time. Expressions over one ``w`` share a shuffle and a sort.
"""

from __future__ import annotations

from collections.abc import Callable
from math import floor, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def over(*keys: str, order: str = "ts") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def full(w: WindowSpec, n: int, agg: Callable[[Column], Column], value: Column) -> Column:
    """An aggregate of the last n rows; null until there are n of them with a value."""
    rows = w.rowsBetween(1 - n, 0)
    return F.when(F.count(value).over(rows) == n, agg(value).over(rows))


def sma(w: WindowSpec, n: int, value: Column) -> Column:
    return full(w, n, F.avg, value)


def change(w: WindowSpec, k: int, value: Column) -> Column:
    """Relative change over k rows."""
    return F.try_divide(value, F.lag(value, k).over(w)) - 1


def percent_rank(w: WindowSpec, n: int, value: Column) -> Column:
    """Average rank of the current value among the last n, over n."""
    held = F.collect_list(value).over(w.rowsBetween(1 - n, 0))
    less = F.size(F.filter(held, lambda x: x < value))
    equal = F.size(F.filter(held, lambda x: x == value))
    return F.when(F.size(held) == n, (less + (equal + 1) / F.lit(2.0)) / n)


def ema(df: DataFrame, spans: dict[str, tuple[str, int]], keys: list[str], order: str = "ts") -> DataFrame:
    """Exponential means: {new column: (column, span)}; the first value seeds the mean, then e += a (x - e), a = 2 / (span + 1).

    A linear recurrence needs no fold: rows are numbered and cut to blocks that are short enough for the weights to stay within
    doubles; within a block the mean is a weighted running sum, and what the three blocks before left over (the rest is below 1e-24) is
    carried in by frames over block numbers. All of it is windows by key: one shuffle for any number of spans. Values must not be null.
    """
    out = df.withColumn("_n", F.row_number().over(over(*keys, order=order)) - 1)
    for name, (column, span) in spans.items():
        a = 2 / (span + 1)
        q = 1 - a
        size = max(1, floor(log(1e8) / -log(q)))
        weight = F.when(F.col("_n") == 0, 1.0).otherwise(a)
        out = out.withColumns({"_b": F.floor(F.col("_n") / size), "_p": (F.col("_n") % size).cast("double")})
        inside = Window.partitionBy(*keys, "_b").orderBy("_n")
        out = out.withColumn("_own", F.pow(F.lit(q), F.col("_p")) * F.sum(F.col(column) * weight * F.pow(F.lit(q), -F.col("_p"))).over(inside))
        blocks, end = Window.partitionBy(*keys).orderBy("_b"), F.when(F.col("_p") == size - 1, F.col("_own"))
        carry = sum((F.coalesce(F.sum(end).over(blocks.rangeBetween(-k, -k)), F.lit(0.0)) * q ** (size * (k - 1)) for k in range(1, 4)), F.lit(0.0))
        out = out.withColumn(name, F.col("_own") + F.pow(F.lit(q), F.col("_p") + 1) * carry).drop("_b", "_p", "_own")
    return out.drop("_n")


def with_next(df: DataFrame, order: str, value: str, span: int = 1000) -> DataFrame:
    """``df`` with ``next``: ``value`` of the row that follows in ``order``, a whole number without repeats.

    Windows over ranges of ``span`` numbers; what the first row of each range holds comes from a table with one row for each of them.
    """
    rows = df.withColumn("_range", F.floor(F.col(order) / span))
    firsts = rows.groupBy("_range").agg(F.min_by(F.struct(F.col(value).alias("v")), order).alias("_first"))
    after = firsts.select("_range", F.lead("_first").over(Window.orderBy("_range")).alias("_after"))
    own = F.lead(F.struct(F.col(value).alias("v"))).over(Window.partitionBy("_range").orderBy(order))
    return rows.withColumn("_own", own).join(after, "_range").withColumn("next", F.coalesce("_own", "_after")["v"]).select(*df.columns, "next")


def longest_runs(df: DataFrame, flag: Column, keys: list[str], order: list[str], block: Column) -> DataFrame:
    """keys, longest_true, longest_false: the longest runs of consecutive rows with equal ``flag``.

    ``block``: a value that never falls in the ``order``, such as the month; runs are found within blocks, which are tasks of their own, and a fold over each
    key's blocks joins those that go on.
    """
    runs = islands(df.withColumn("_block", block), flag, [*keys, "_block"], order)
    edge = F.struct("flag", "length")
    longest = lambda x: F.coalesce(F.max(F.when(F.col("flag") == x, F.col("length"))), F.lit(0))
    blocks = runs.groupBy(*keys, "_block").agg(F.min_by(edge, "first").alias("head"), F.max_by(edge, "first").alias("tail"), F.count("*").alias("runs"), longest(True).alias("true"), longest(False).alias("false"))
    folded = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_block", "head", "tail", "runs", "true", "false"))).alias("all"))
    none = F.lit(0).cast("long")

    def step(s: Column, b: Column) -> Column:
        head = b["head"]["length"] + F.when(s["flag"] == b["head"]["flag"], s["open"]).otherwise(none)
        best = lambda x: F.greatest(s[str(x).lower()], b[str(x).lower()], F.when(b["head"]["flag"] == x, head).otherwise(none))
        return F.struct(b["tail"]["flag"].alias("flag"), F.when(b["runs"] == 1, head).otherwise(b["tail"]["length"]).alias("open"), best(True).alias("true"), best(False).alias("false"))

    start = F.struct(F.lit(None).cast("boolean").alias("flag"), none.alias("open"), none.alias("true"), none.alias("false"))
    out = folded.withColumn("_s", F.aggregate("all", start, step))
    return out.select(*keys, F.col("_s.true").alias("longest_true"), F.col("_s.false").alias("longest_false"))


def islands(df: DataFrame, flag: Column, keys: list[str], order: list[str]) -> DataFrame:
    """Runs of consecutive rows with equal ``flag``: keys, flag, length, first and last place."""
    all_rows = Window.partitionBy(*keys).orderBy(*order)
    same = Window.partitionBy(*keys, "_flag").orderBy(*order)
    rows = df.withColumn("_flag", flag).withColumn("_n", F.row_number().over(all_rows)).withColumn("_run", F.col("_n") - F.row_number().over(same))
    return rows.groupBy(*keys, "_flag", "_run").agg(F.count("*").alias("length"), F.min("_n").alias("first"), F.max("_n").alias("last")).withColumnRenamed("_flag", "flag").drop("_run")


def running(df: DataFrame, keys: list[str], order: list[str], block: Column, **wanted: tuple[str, Column]) -> DataFrame:
    """``df`` with a column for each of ``wanted`` (kind, value): what holds for each row of its keys' series, in ``order``, found in two levels.

    Kinds: ``sum`` and ``max`` up to and with the row, ``last`` (value that isn't null) up to and with it, ``max_before`` and ``lag`` before it. ``block``: a value that
    never falls in the ``order``, such as the week. Each block is summed up in one row, a window over these carries the state from block to block, and windows
    within blocks do the rest: no task has more of a series than a block, or the summaries of its blocks. Keys and blocks must not be null.
    """
    rows, at = df.withColumn("_block", block), F.struct(*order)
    each = {"sum": F.sum, "max": F.max, "max_before": F.max, "last": lambda c: F.max_by(c, F.when(c.isNotNull(), at)), "lag": lambda c: F.max_by(F.struct(c.alias("v")), at)}
    blocks = rows.groupBy(*keys, "_block").agg(*(each[kind](c).alias(f"_{n}") for n, (kind, c) in wanted.items()))
    over = Window.partitionBy(*keys).orderBy("_block")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    carry = {"sum": lambda c: F.sum(c).over(before), "max": lambda c: F.max(c).over(before), "max_before": lambda c: F.max(c).over(before), "last": lambda c: F.last(c, ignorenulls=True).over(before), "lag": lambda c: F.lag(c).over(over)}
    carried = blocks.select(*keys, "_block", *(carry[kind](f"_{n}").alias(f"_{n}") for n, (kind, _) in wanted.items()))
    own = Window.partitionBy(*keys, "_block").orderBy(*order)
    through, until = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(Window.unboundedPreceding, -1)
    within = {
        "sum": lambda c, s: F.coalesce(F.sum(c).over(through) + s, F.sum(c).over(through), s), "max": lambda c, s: F.greatest(F.max(c).over(through), s), "max_before": lambda c, s: F.greatest(F.max(c).over(until), s),
        "last": lambda c, s: F.coalesce(F.last(c, ignorenulls=True).over(through), s), "lag": lambda c, s: F.coalesce(F.lag(F.struct(c.alias("v"))).over(own), s)["v"],
    }
    return rows.join(carried, [*keys, "_block"]).select(*df.columns, *(within[kind](c, F.col(f"_{n}")).alias(n) for n, (kind, c) in wanted.items()))


def trailing_count(df: DataFrame, keys: list[str], seconds: int, ts: str = "ts", name: str = "recent", block_seconds: int = 3600) -> DataFrame:
    """``df`` with the number of its keys' rows of the last ``seconds`` up to and with each row, both ends and rows of equal time included. Rows without a time count one another.

    A sliding frame would be gone through anew for each row. Here each row is a step up at its time and one down as it leaves, and the number is a running sum of steps. A block of
    time of a key is a task of its own; a row for each block has the sum of the blocks before.
    """
    us, width = F.unix_micros(F.col(ts).cast("timestamp")), block_seconds * 10**6
    row = F.struct(*df.columns)
    none = F.lit(None).cast(df.select(row.alias("r")).schema["r"].dataType)
    up = F.struct(us.alias("us"), F.lit(1).alias("step"), row.alias("row"))
    down = F.struct((us + seconds * 10**6 + 1).alias("us"), F.lit(-1).alias("step"), none.alias("row"))
    steps = df.select(*keys, F.explode(F.when(us.isNull(), F.array(up)).otherwise(F.array(up, down))).alias("_s"))
    steps = steps.select(*keys, F.floor(F.col("_s.us") / width).alias("_block"), F.col("_s.us").alias("_us"), F.col("_s.step").cast("long").alias("_step"), F.col("_s.row").alias("_row"))
    blocks = steps.filter("_block IS NOT NULL").groupBy(*keys, "_block").agg(F.sum("_step").alias("_step"))
    before = F.sum("_step").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    carried = blocks.select(*keys, "_block", (F.col("_block") * width - 1).alias("_us"), F.coalesce(before, F.lit(0)).alias("_step"), none.alias("_row"))
    through = Window.partitionBy(*keys, "_block").orderBy("_us").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return steps.unionByName(carried).withColumn("_n", F.sum("_step").over(through)).filter("_row IS NOT NULL").select("_row.*", F.col("_n").alias(name))
