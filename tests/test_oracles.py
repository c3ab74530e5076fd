"""Every query of the catalogue against its SQL."""

from __future__ import annotations

import pytest

from buildlens.plans import catalogue


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query_equals_its_sql(name, same, small):
    same(catalogue.QUERIES[name], catalogue.ORACLES[name], small)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["key", "total"]
    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
