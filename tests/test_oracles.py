"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle import difference
from sessionloom.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, name):
    frame = entry.queries()[name](spark, FOLDER)
    assert difference(frame, FOLDER, entry.oracle_sql()[name]) is None


def test_entry_runs(spark):
    frame = entry.entry(spark)
    assert frame.count() > 0
    assert "first_message" in frame.columns
