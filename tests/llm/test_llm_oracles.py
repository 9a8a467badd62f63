"""Every query of the folder with SQL, on the smallest tables."""

import pytest

from oracle import difference
from sessionloom.llm import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    assert difference(catalog.QUERIES[name](spark, FOLDER), FOLDER, catalog.ORACLES[name]) is None
