"""Every query of the engine against its SQL on the smallest tables, and the driver contract."""

import pytest

from compare import matches
from quillspark.plans.catalogue import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    matches(spark, QUERIES[name], ORACLES[name])


def test_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
