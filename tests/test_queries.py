"""Each registered query gives the rows of its DuckDB form."""

import pytest

from quirelake.plans import catalogue
from tests.duck import rows, views


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_sql(spark, sf, name):
    got = catalogue.QUERIES[name](spark, sf).toPandas()
    want = views(sf).sql(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
