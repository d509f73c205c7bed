"""Every core query against its SQL on whole tables."""

import pytest

from compare import compare, database
from factweave.plans import fact_queries, record_queries, store_queries

SQL = {**fact_queries.oracle_sql(), **record_queries.oracle_sql(), **store_queries.oracle_sql()}
QUERIES = {**fact_queries.queries(), **record_queries.queries(), **store_queries.queries()}


@pytest.fixture(scope="module")
def con(sf_dir):
    return database(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, sf_dir, name):
    only_spark, only_sql, _ = compare(spark, con, QUERIES[name], SQL[name], sf_dir)
    assert not only_spark and not only_sql, (list(only_spark)[:3], list(only_sql)[:3])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() >= 0
