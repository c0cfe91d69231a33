"""Every query against its SQL, and the registry's shape."""

import pytest

from findwell.plans.registry import ORACLE_SQL, QUERIES
from tests.harness import connect, rows_of_spark, rows_of_sql


def test_registry_names_agree():
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, small, name):
    assert rows_of_spark(QUERIES[name](spark, small)) == rows_of_sql(connect(small), ORACLE_SQL[name])


def test_entry_module_imports(spark, small):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.queries()["search_full_pages"](spark, small).columns == ["rank", "page_id", "url", "score"]


def test_every_registered_oracle_is_sql(small):
    import __spark_entry__ as e

    con = connect(small)
    for sql in e.oracle_sql().values():
        con.sql(f"EXPLAIN {sql}")
