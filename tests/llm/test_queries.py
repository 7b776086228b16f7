"""Every query of the subpackage against its SQL."""

from __future__ import annotations

import pytest

from flowspark.llm.registry import ORACLES, QUERIES

from ..conftest import SF
from ..oracle import same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    same(QUERIES[name](spark, SF), ORACLES[name], SF)


def test_all_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
