import pytest
from oracle import connect, difference

from attestry.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_its_sql(spark, duck, name):
    found = catalogue.queries()[name](spark, SF)
    sql = catalogue.oracle_sql().get(name)
    if sql:
        assert difference(found, duck, sql) == ""
    else:
        assert found.count() > 0
