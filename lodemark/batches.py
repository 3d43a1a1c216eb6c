"""Sizes of the batches that Python workers get."""

from __future__ import annotations

from pyspark.sql import SparkSession


def bound_bytes(spark: SparkSession, size: int = 8 << 20) -> None:
    """Lowers the bytes of an Arrow batch for the session; rows a batch stay as they are, so only batches of long texts get shorter."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).lower().removesuffix("b")
    if not now.isdigit() or not 0 < int(now) <= size:
        spark.conf.set(key, str(size))
