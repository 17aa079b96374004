import pytest
from oracle import check

import shutterloom.file_queries  # noqa: F401 - registers its queries
import shutterloom.function_queries  # noqa: F401 - registers its queries
from shutterloom.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf, name):
    check(spark, QUERIES[name], SQL[name], sf)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
