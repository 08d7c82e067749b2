"""Every catalogue query against its SQL on the smallest tables."""

import pytest
from compare import compare

from inkloom.plans import catalog
from inkloom.plans.oracle import all_sql

SF = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(catalog.all_queries()) == set(all_sql())


@pytest.mark.parametrize("name", list(catalog.all_queries()))
def test_query_matches_sql(spark, name):
    ok, text = compare(spark, name, SF)
    assert ok, text


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["image_id", "r", "g", "b", "mass", "rank", "share"]
    assert df.count() > 0
