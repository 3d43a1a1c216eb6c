"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, as in tests, a temporary folder stands in, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="lodemark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: What this driver has written and not removed.
_written: list[str] = []


def save(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends here and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_as = path
    return out


def folder(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, which ``cleanup`` removes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(df: DataFrame) -> None:
    """Removes a table that ``save`` wrote and that nothing reads any more."""
    _remove(df.sparkSession, df.saved_as)
    if df.saved_as in _written:
        _written.remove(df.saved_as)


def cleanup(spark: SparkSession) -> int:
    """Removes all tables that this driver has saved, for the end of a job whose results have been read or written elsewhere; returns their number."""
    n = len(_written)
    while _written:
        _remove(spark, _written.pop())
    return n
