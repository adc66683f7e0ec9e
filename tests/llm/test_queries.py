"""Every llm query that SQL can express gives the rows of its SQL on whole tables; the others run."""

import pytest

from recallix.llm import queries
from tests.oracle import connect, rows_of_query, rows_of_sql


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, medium, name):
    names, rows = rows_of_query(queries.QUERIES[name](spark, medium))
    assert rows and (names, rows) == rows_of_sql(connect(medium), queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, small, name):
    names, rows = rows_of_query(queries.QUERIES[name](spark, small))
    assert names and rows
