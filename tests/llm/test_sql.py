import pytest

from spindrift.llm import queries
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    compare(spark, name, queries.QUERIES[name], queries.ORACLES[name])
