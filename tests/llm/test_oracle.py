import pytest

from plotloom.llm import queries
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_sql(spark, name):
    compare(queries.queries()[name](spark, SF), connect(SF), queries.oracle_sql()[name])
