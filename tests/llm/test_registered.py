import pytest

from askmill.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, data, same_as_sql, name):
    same_as_sql(spark, data, registry.queries()[name], registry.oracle_sql()[name])
