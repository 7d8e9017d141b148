import pytest

from plotloom.plans.all_queries import QUERIES, SQL
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", SQL)
def test_query(spark, duck, name):
    compare(QUERIES[name](spark, SF), duck, SQL[name])
