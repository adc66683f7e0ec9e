"""Every query of the core that SQL can express gives the rows of its SQL; the others run."""

import pytest

from recallix.plans import catalogue
from tests.oracle import connect, rows_of_query, rows_of_sql


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, small, con, name):
    names, rows = rows_of_query(catalogue.QUERIES[name](spark, small))
    assert names
    if name in catalogue.SQL:
        assert (names, rows) == rows_of_sql(con, catalogue.SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
