"""Where queries and their SQL twins are registered."""

from __future__ import annotations

from collections.abc import Callable

from .tables import twin

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *tables: str) -> Callable:
    """Registers a function (spark, sf_dir) under its name; ``sql`` may use the named domain tables."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = twin(sql, *tables)
        return f

    return add


def rounded(df, *columns: str, digits: int = 6):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.round(c, digits) for c in columns})
