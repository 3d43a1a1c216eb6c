"""Writers: tables by partition, upserts of touched partitions, chunked SQL files, CSV, JSON lines, registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodemark.functions.text import sql_literal

from .relational import upsert


def append(df: DataFrame, path: str, partitions: list[str]) -> None:
    df.write.mode("append").partitionBy(*partitions).parquet(path)


def upsert_partitions(df: DataFrame, path: str, keys: list[str], partitions: list[str]) -> None:
    """Merges rows into a partitioned table: only partitions that ``df`` touches are read and written again.

    The merged rows are written beside the table first, so a failure halfway leaves the old partitions as they were.
    """
    from lodemark.storage import save

    spark = df.sparkSession
    touched = df.select(*partitions).distinct()
    base = spark.read.parquet(path)
    merged = save(upsert(base.join(touched, partitions, "left_semi").select(*df.columns), df, keys), "upsert")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def select_known(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that the target has, in its order."""
    return df.select(*(c for c in columns if c in df.columns))


def write_sql(df: DataFrame, path: str, table: str, kinds: dict[str, str], rows_per_file: int, conflict: str = "") -> None:
    """INSERT statements, one per row, at most ``rows_per_file`` in a file."""
    values = F.concat_ws(", ", *(sql_literal(F.col(c), k) for c, k in kinds.items()))
    end = f" ON CONFLICT {conflict};" if conflict else ";"
    line = F.concat(F.lit(f"INSERT INTO {table} ({', '.join(kinds)}) VALUES ("), values, F.lit(")" + end))
    df.select(line.alias("value")).write.option("maxRecordsPerFile", rows_per_file).text(path)


def write_csv(df: DataFrame, path: str, by: str = "symbol") -> None:
    df.write.partitionBy(by).option("header", "true").csv(path)


def write_jsonl(df: DataFrame, path: str, column: str = "text") -> None:
    df.select(F.to_json(F.struct(column)).alias("value")).write.text(path)


def next_versions(registry: DataFrame, new: DataFrame) -> DataFrame:
    """New models with versions one above the highest known of their name (v1, v2, ...)."""
    known = registry.groupBy("model_name").agg(F.max(F.expr("try_cast(substr(model_version, 2) AS INT)")).alias("_v"))
    return new.join(known, "model_name", "left").withColumn("model_version", F.concat(F.lit("v"), (F.coalesce("_v", F.lit(0)) + 1).cast("string"))).drop("_v")


def delete_cascade(parents: DataFrame, children: DataFrame, gone: Column, key: str, foreign: str) -> tuple[DataFrame, DataFrame]:
    """Parents without the ``gone`` ones, and children without those of gone parents."""
    lost = parents.filter(gone).select(F.col(key).alias(foreign))
    return parents.filter(~F.coalesce(gone, F.lit(False))), children.join(lost, foreign, "left_anti")
