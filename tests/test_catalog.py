import pytest

from spindrift.plans import catalog
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, name):
    compare(spark, name, catalog.QUERIES[name], catalog.ORACLES[name])
