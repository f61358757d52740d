"""Every query with SQL gives the rows of its SQL."""

import pytest

from rowlattice import queries
from tests.conftest import same

queries.load()


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, sf, duck, name):
    df = queries.QUERIES[name](spark, sf)
    if name in queries.SQL:
        same(df, duck.execute(queries.SQL[name]))
    else:
        assert df.columns and df.collect() is not None


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
