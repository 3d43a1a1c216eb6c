"""What the operators of this subpackage share: table access, batches and text conventions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemark.operators.skew import light  # noqa: F401

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 400) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, as a text may be long; ``bound_bytes`` sees to their bytes."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def by_slices(texts: pd.Series, run: Callable[[list], np.ndarray], rows: int = 400) -> pd.Series:
    """What ``run`` gives for lists of at most ``rows`` texts."""
    return pd.Series(np.concatenate([run(list(texts.iloc[k : k + rows])) for k in range(0, len(texts), rows)] or [np.zeros(0)]))


def fresh(df: DataFrame, name: str) -> str:
    """A name for a column of one's own that ``df`` doesn't have."""
    name = f"_{name}"
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def fold(key: str | Column) -> Column:
    """crc32 of the id as text, modulo 5; rows with 0 are held out from every fit."""
    return F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")) % 5
