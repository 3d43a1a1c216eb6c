"""Every query with a SQL twin equals it."""

import pytest
from compare import rows_of, rows_of_sql

from lodemark.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, duck, data, name):
    assert rows_of(QUERIES[name](spark, data)) == rows_of_sql(duck, ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
