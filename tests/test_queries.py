"""Every registered query against its SQL, or for a stable schema where it has none."""

from __future__ import annotations

import pytest

from flowspark.plans import ORACLES, QUERIES

from .conftest import SF
from .oracle import same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    same(QUERIES[name](spark, SF), ORACLES[name], SF)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["symbol", "bar_start_ns", "ofi", "mid", "delta_mid", "delta_mid_lead1", "n_events", "valid"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
