"""Keys, order and rows: latest per key, last n, splits, filling, pages, upserts and retention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window


def latest(df: DataFrame, keys: list[str], order: str, tie: str | None = None) -> DataFrame:
    """One row for each key: the last in order. An aggregate, combined before the shuffle; no sort of a key's rows."""
    by = F.struct(order, tie) if tie else F.col(order)
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), by).alias("_r")).select("_r.*")


def last_n(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def keep_first(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row for each key, the first in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def chronological_split(df: DataFrame, keys: list[str], order: str, part: float) -> DataFrame:
    w, whole = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys)
    first = F.row_number().over(w) <= F.greatest(F.lit(1), F.floor(F.lit(part) * F.count("*").over(whole)))
    return df.withColumn("part", F.when(first, "train").otherwise("valid"))


def sequences(df: DataFrame, keys: list[str], order: str, columns: list[str], n: int) -> DataFrame:
    """Rows with ``sequence``: the n rows before, as arrays of columns; rows with fewer before them are left out."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-n, -1)
    return df.withColumn("sequence", F.collect_list(F.array(*columns)).over(w)).filter(F.size("sequence") == n)


def fill_chain(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Nulls become the last value before them, else the mean of the key, else 0."""
    w, whole = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    return df.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.avg(c).over(whole), F.lit(0.0)) for c in columns})


def standardise(df: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    w = Window.partitionBy(*keys)
    return df.withColumns({new: F.try_divide(F.col(c) - F.avg(c).over(w), F.nullif(F.stddev_pop(c).over(w), F.lit(0.0))) for new, c in columns.items()})


def all_of(*conditions: Column | None) -> Column:
    """Conjunction of the conditions that are given."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """The ``number``-th page (from 1); ``order`` must be total."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], update: list[str] | None = None) -> DataFrame:
    """``base`` with ``delta`` merged in: new keys are added, ``update`` columns (all by default) of known keys are replaced.

    The last row of a key in ``delta`` (by ``_order``, if there is such a column) wins.
    """
    if "_order" in delta.columns:
        delta = latest(delta, keys, "_order").drop("_order")
    update = [c for c in base.columns if c not in keys] if update is None else update
    b, d = F.struct(*base.columns), F.struct(*base.columns)
    joined = base.select(*keys, b.alias("_b")).join(delta.select(*keys, d.alias("_d")), keys, "full_outer")
    return joined.select(*(F.when(F.col("_d").isNotNull() & (F.col("_b").isNull() | F.lit(c in update or c in keys)), F.col(f"_d.{c}")).otherwise(F.col(f"_b.{c}")).alias(c) for c in base.columns))


def insert_new(base: DataFrame, delta: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of ``delta`` with keys that ``base`` doesn't have: of each key the first in ``order``."""
    first = F.min_by(F.struct(*delta.columns), F.struct(*order))
    return delta.join(base.select(*keys), keys, "left_anti").groupBy(*keys).agg(first.alias("_row")).select("_row.*")


def activate_latest(df: DataFrame, keys: list[str], order: str, flag: str = "is_active", tie: str | None = None) -> DataFrame:
    """Marks the one row with the greatest ``order`` of its keys; of equal ones that with the greatest ``tie``, a column without repeats within keys and order."""
    place = F.struct(order, *([tie] if tie else []))
    newest = df.groupBy(*keys).agg(F.max(place).alias("_newest"))
    return df.join(newest, keys).withColumn(flag, place == F.col("_newest")).select(*df.columns, flag)


def retention(df: DataFrame, ts: str, as_of: Column, days: int) -> tuple[DataFrame, DataFrame]:
    """Rows to keep and rows to archive or drop."""
    young = F.col(ts) >= as_of - F.make_dt_interval(days=F.lit(days))
    return df.filter(young), df.filter(~young)


def valid(df: DataFrame, rule: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that keep a rule, and the others, for which it is false or null."""
    ok = F.coalesce(rule, F.lit(False))
    return df.filter(ok), df.filter(~ok)


def numeric_columns(df: DataFrame, excluded: set[str] = frozenset()) -> list[str]:
    """Names of the numeric columns in their order, without the target and others that a model mustn't see."""
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in excluded]
