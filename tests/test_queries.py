import pytest

from folio import queries as Q

from .compare import spark_rows, sql_rows

QUERIES, SQL = Q.queries(), Q.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_rows_of_its_sql(spark, data, name):
    assert spark_rows(QUERIES[name](spark, data)) == sql_rows(SQL[name], data)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as E

    assert E.entry(spark).count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
