import pytest

from spindrift.plans import catalog, studies
from tests.oracle import compare

NAMES = sorted(n for n, f in catalog.QUERIES.items() if f.__module__ == studies.__name__)


@pytest.mark.parametrize("name", [n for n in NAMES if n in catalog.ORACLES])
def test_same_as_sql(spark, name):
    compare(spark, name, catalog.QUERIES[name], catalog.ORACLES[name])
