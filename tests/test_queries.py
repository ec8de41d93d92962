import pytest

from quaverlake.plans import catalogue
from tests.support import DATA, check

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    check(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, str(DATA / "sf0.001")).count() >= 1


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
