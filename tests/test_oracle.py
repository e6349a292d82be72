import pytest

from askmill.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, same_as_sql, name):
    same_as_sql(spark, data, registry.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_without_sql_does_not_depend_on_the_shuffle(spark, data, name):
    few = sorted(map(repr, registry.queries()[name](spark, data).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert few and few == sorted(map(repr, registry.queries()[name](spark, data).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
