"""Joins in time: as-of, nearest, interval and bucket joins, for all keys in one plan.

An as-of join is a union and a window over key and time bin that carries the last right row forward; the last right row before each bin comes from a table
with one row for each key and bin. So a hot key is as many tasks as it has bins, there is no range join, and nothing blows up whatever the numbers of rows.
What comes next is found in descending order: a frame that reaches to the end of its window is gone through anew for each row, a frame from its start isn't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodemark.storage import save

#: Width of the time bins.
BIN_SECONDS = 6 * 3600


def _around(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, order: list[str], right_first: bool, bin_seconds: int) -> DataFrame:
    """The left rows (keys, ``_left``) with ``_back``, the last right row before them, and ``_ahead``, the first after them, as structs.

    At equal times, right rows count as before left rows if ``right_first``, else as after them. Rows without a time find nothing and aren't found.
    """
    others = [c for c in right.columns if c not in keys]
    l_row, r_row = F.struct(*(c for c in left.columns if c not in keys)), F.struct(*others)
    l_none = F.lit(None).cast(left.select(l_row.alias("x")).schema["x"].dataType)
    r_none = F.lit(None).cast(right.select(r_row.alias("x")).schema["x"].dataType)
    no_tie = F.lit(None).cast("array<string>")
    ls = left.select(*keys, F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"), no_tie.alias("_tie"), l_row.alias("_left"), r_none.alias("_right"))
    tie = F.array(*(F.col(c).cast("string") for c in order)).cast("array<string>")
    rs = right.filter(F.col(right_ts).isNotNull()).select(*keys, F.col(right_ts).alias("_ts"), F.lit(0 if right_first else 2).alias("_side"), tie.alias("_tie"), l_none.alias("_left"), r_row.alias("_right"))
    rows = ls.unionByName(rs).withColumns({"_bin": F.floor(F.unix_seconds(F.col("_ts").cast("timestamp")) / bin_seconds), "_edge": F.lit(0)})
    place = F.when(F.col("_right").isNotNull(), F.struct("_ts", "_tie"))
    bins = rows.groupBy(*keys, "_bin").agg(F.min_by("_right", place).alias("_first"), F.max_by("_right", place).alias("_last"))
    up, down = (Window.partitionBy(*keys).orderBy(place).rowsBetween(Window.unboundedPreceding, -1) for place in (F.col("_bin").asc(), F.col("_bin").desc()))
    bins = bins.withColumns({"_before": F.last("_last", True).over(up), "_after": F.last("_first", True).over(down)})
    edges = F.explode(F.array(F.struct(F.lit(-1).alias("e"), F.col("_before").alias("r")), F.struct(F.lit(1).alias("e"), F.col("_after").alias("r"))))
    edges = bins.filter("_bin IS NOT NULL").select(*keys, "_bin", edges.alias("x")).filter("x.r IS NOT NULL")
    edges = edges.select(*keys, F.lit(None).cast(rows.schema["_ts"].dataType).alias("_ts"), F.lit(0).alias("_side"), no_tie.alias("_tie"), l_none.alias("_left"), F.col("x.r").alias("_right"), "_bin", F.col("x.e").alias("_edge"))
    places = [F.col(c) for c in ("_edge", "_ts", "_side", "_tie")]
    back, ahead = (F.last("_right", True).over(Window.partitionBy(*keys, "_bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) for order in ([c.asc() for c in places], [c.desc() for c in places]))
    found = rows.unionByName(edges).withColumns({"_back": back, "_ahead": ahead}).filter(F.col("_left").isNotNull())
    known = F.col("_bin").isNotNull()
    return found.select(*keys, "_left", F.when(known, F.col("_back")).alias("_back"), F.when(known, F.col("_ahead")).alias("_ahead"))


def asof_join(
    left: DataFrame, right: DataFrame, keys: list[str], ts: str = "ts", right_ts: str | None = None, direction: str = "backward", tie: list[str] | None = None, exact: bool = True, prefix: str = "r_", bin_seconds: int = BIN_SECONDS,
) -> DataFrame:
    """Each left row with the last right row of its key at or before its time ("backward") or the first at or after it ("forward").

    ``exact``: whether the same time counts. Of right rows with one time, ``tie`` columns (as text) decide: the last one
    backward, the first one forward. Right columns but the keys get ``prefix``; they are null where nothing is found.
    """
    forward = direction == "forward"
    out = _around(left, right, keys, ts, right_ts or ts, tie or [], exact != forward, bin_seconds)
    found = "_ahead" if forward else "_back"
    return out.select(*(F.col(c) if c in keys else F.col(f"_left.{c}") for c in left.columns), *(F.col(f"{found}.{c}").alias(prefix + c) for c in right.columns if c not in keys))


def nearest_join(left: DataFrame, right: DataFrame, keys: list[str], ts: str = "ts", prefix: str = "r_", bin_seconds: int = BIN_SECONDS) -> DataFrame:
    """Each left row with the right row nearest in time; of two equally far ones, the earlier."""
    both = _around(left, right, keys, ts, ts, [], True, bin_seconds)

    def gap(side: str) -> Column:
        return F.abs(F.unix_micros(F.col(f"_left.{ts}").cast("timestamp")) - F.unix_micros(F.col(f"{side}.{ts}").cast("timestamp")))

    use_back = F.col("_back").isNotNull() & (F.col("_ahead").isNull() | (gap("_back") <= gap("_ahead")))
    others = [c for c in right.columns if c not in keys]
    return both.select(*(F.col(c) if c in keys else F.col(f"_left.{c}") for c in left.columns), *(F.when(use_back, F.col(f"_back.{c}")).otherwise(F.col(f"_ahead.{c}")).alias(prefix + c) for c in others))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], start: Column, end: Column, ts: str, bin_seconds: int, how: str = "left", right_ts: str | None = None) -> DataFrame:
    """Rows of equal keys whose right time is between ``start`` and ``end`` of the left row, both ends included.

    Both sides are dealt by key and time bin, so that a hot key spreads over its bins; a left row goes to each bin that it touches.
    """
    right_ts = right_ts or ts

    def place(c: Column) -> Column:
        return F.floor(F.unix_seconds(c.cast("timestamp")) / bin_seconds)

    l2 = left.withColumns({"_start": start, "_end": end}).withColumn("_bin", F.explode(F.sequence(place(F.col("_start")), place(F.col("_end")))))
    r2 = right.withColumnRenamed(right_ts, "_r_ts").withColumn("_r_bin", place(F.col("_r_ts")))
    matched = l2.join(r2.withColumnsRenamed({k: f"_r_{k}" for k in keys}), [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys] + [F.col("_bin") == F.col("_r_bin"), F.col("_r_ts").between(F.col("_start"), F.col("_end"))])
    found = matched.select(*left.columns, *(F.col("_r_ts").alias(f"r_{right_ts}") if c == right_ts else F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys))
    if how == "inner":
        return found
    lone = _without(left, right, keys, start, end, right_ts)
    return found.unionByName(lone, allowMissingColumns=True)


def _without(left: DataFrame, right: DataFrame, keys: list[str], start: Column, end: Column, right_ts: str) -> DataFrame:
    """Left rows whose next right row at or after ``start`` is after ``end``: an as-of join tells."""
    marked = left.withColumns({"_start": start, "_end": end})
    nearest = asof_join(marked, right.select(*keys, right_ts).distinct(), keys, "_start", right_ts, direction="forward", prefix="_n_")
    return nearest.filter(F.col(f"_n_{right_ts}").isNull() | (F.col(f"_n_{right_ts}") > F.col("_end"))).select(*left.columns)


#: Right rows of all bins of ``gathered``, each counted in every bin that it is in, up to which these are broadcast.
GATHERED = 2_000_000


def gathered(left: DataFrame, right: DataFrame, keys: list[str], start: Column, end: Column, seconds: int, name: str, ts: str = "ts") -> DataFrame:
    """Each left row with ``name``: its keys' right rows from ``start`` to ``end``, both included, as structs (time first) in order. Empty where there are none, or no time.

    ``end`` must be no more than ``seconds`` after ``start``. Left rows are neither multiplied nor grouped: the right rows within reach of a key's time bin are one row, from which each left
    row takes its own. So all right rows of a key within 1.25 times ``seconds`` must fit in memory, as bars do.
    """
    width = max(1, seconds // 4)
    reach = -(-seconds // width)

    def place(c: Column) -> Column:
        return F.floor(F.unix_seconds(c.cast("timestamp")) / width)

    row = F.struct(ts, *(c for c in right.columns if c not in (*keys, ts)))
    near = right.filter(F.col(ts).isNotNull()).select(*(F.col(k).alias(f"_r_{k}") for k in keys), F.explode(F.sequence(place(F.col(ts)) - reach, place(F.col(ts)))).alias("_r_bin"), row.alias("_r"))
    near = save(near.groupBy(*(f"_r_{k}" for k in keys), "_r_bin").agg(F.array_sort(F.collect_list("_r")).alias("_near")), "near")
    size = near.agg(F.sum(F.size("_near"))).first()[0] or 0
    rows = left.withColumns({"_start": start, "_end": end}).withColumn("_bin", place(F.col("_start")))
    met = rows.join(F.broadcast(near) if size <= GATHERED else near, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys] + [F.col("_bin") == F.col("_r_bin")], "left")
    held = F.filter("_near", lambda r: (r[ts] >= F.col("_start")) & (r[ts] <= F.col("_end")))
    return met.select(*left.columns, F.coalesce(held, F.array().cast(near.schema["_near"].dataType)).alias(name))


def bucket_join(left: DataFrame, right: DataFrame, keys: list[str], unit: str = "hour", ts: str = "ts", how: str = "left") -> DataFrame:
    """Equi-join on the keys and the truncated time of both sides; the right side's time is dropped."""
    at = F.date_trunc(unit, ts).cast("timestamp_ntz")
    return left.withColumn("_b", at).join(right.withColumn("_b", at).drop(ts), [*keys, "_b"], how).drop("_b")


def lagged_return(linkage: DataFrame, bars: DataFrame, key: str = "symbol", hours: int = 1) -> DataFrame:
    """Percent change from the last close at or before an article to the first close after it, within ``hours``."""
    both = _around(linkage, bars.select(key, "ts", "close"), [key], "ts", "ts", [], True, BIN_SECONDS)
    near = F.col("_ahead.ts") <= F.col("_left.ts") + F.make_dt_interval(hours=F.lit(hours))
    change = F.when(near, F.try_divide(100 * (F.col("_ahead.close") - F.col("_back.close")), F.col("_back.close")))
    return both.select(*(F.col(c) if c == key else F.col(f"_left.{c}") for c in linkage.columns), F.round(change, 6).alias("price_change"))
