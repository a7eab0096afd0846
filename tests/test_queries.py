"""Every query that has SQL gives the SQL's rows on the smallest tables."""

import harness
import pytest
from conftest import SF

from corvane import catalogue_of_queries as c

SQL = c.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    assert harness.compare(spark, con, SF, c.queries()[name], SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(c.queries()) - set(SQL)))
def test_others_have_rows(spark, name):
    assert c.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
