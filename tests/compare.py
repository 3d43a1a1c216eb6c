"""Order-insensitive comparison of a DataFrame with what DuckDB says."""

import decimal
import math


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)


def rows_of_sql(duck, sql):
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    columns = sorted(names)
    places = [names.index(c) for c in columns]
    return columns, sorted((tuple(norm(r[i]) for i in places) for r in found.fetchall()), key=repr)
