"""CSV and JSON lines, with stated schemas; values that don't parse become null."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    raw = spark.read.csv(path, header=True)
    return raw.select(*(F.trim(F.col(f.name)).try_cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)))


def read_jsonl(spark: SparkSession, path: str, schema: str = "text string") -> DataFrame:
    return spark.read.schema(schema).json(path)


def non_negative_ticks(rows: DataFrame, columns: tuple[str, ...] = ("open", "high", "low", "close", "volume")) -> DataFrame:
    """Rows whose values all parse and are not negative."""
    values = [F.col(c).try_cast("double") for c in columns]
    return rows.withColumns(dict(zip(columns, values, strict=True))).dropna(subset=list(columns)).filter(F.least(*(F.col(c) for c in columns)) >= 0)


def require(spark: SparkSession, *tables: str) -> None:
    """Raises an error that names the tables and views that a job needs and the catalog doesn't have."""
    lacking = [t for t in tables if not spark.catalog.tableExists(t)]
    if lacking:
        raise LookupError(f"no table {', '.join(lacking)}")
