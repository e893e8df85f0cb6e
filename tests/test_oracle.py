"""Every query with SQL gives the SQL's rows; the others give rows."""

import pytest
from tests.oracle import spark_rows, sql_rows

from acrelight.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    columns, found = spark_rows(registry.queries()[name](spark, SF))
    wanted_columns, wanted = sql_rows(registry.oracle_sql()[name], SF)
    assert columns == wanted_columns
    assert found == wanted


@pytest.mark.parametrize("name", sorted(registry.queries().keys() - registry.oracle_sql().keys()))
def test_query_without_sql_gives_rows(spark, name):
    assert registry.queries()[name](spark, SF).limit(1).count() == 1
