"""Every query against its SQL in an independent engine, and those without SQL for their columns."""

import pytest
from oracle import differences

from phrasemill.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    assert not differences(spark, name, catalog.QUERIES[name], catalog.ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entries

    assert entries.entry(spark).count() > 0
    assert set(entries.oracle_sql()) <= set(entries.queries())
