"""Fits and conclusions where no two bars in a row are valid: every bar mixes epochs."""

from __future__ import annotations

import shutil

import duckdb
import pytest

from flowspark.operators import validate
from flowspark.plans import ORACLES, QUERIES, replays

from .conftest import SF
from .oracle import same


@pytest.fixture(scope="module")
def mixed(tmp_path_factory):
    at = tmp_path_factory.mktemp("mixed") / "sf"
    shutil.copytree(SF, at, copy_function=shutil.copyfile)
    duckdb.sql(f"COPY (SELECT * REPLACE (event_id * 2500 AS event_id, TIMESTAMP '2024-01-01' + to_minutes(event_id) AS ts) FROM '{SF}/events.parquet') TO '{at}/events.parquet' (FORMAT parquet)")
    return str(at)


@pytest.mark.parametrize("name", ["mlofi_validation", "mlofi_conclusions", "ofi_conclusions", "ofi_conclusions_qualified"])
def test_without_fits(spark, mixed, name):
    same(QUERIES[name](spark, mixed), ORACLES[name], mixed)


@pytest.fixture(scope="module")
def few(tmp_path_factory):
    """Two symbols of six tapes with ids in turn: epochs of three hours, so that 4 and 5 bars of two hours
    follow another valid one."""
    at = tmp_path_factory.mktemp("few") / "sf"
    shutil.copytree(SF, at, copy_function=shutil.copyfile)
    events = "SELECT e.* REPLACE (event_id * 6 + i AS event_id) FROM '/root/testdata/sf0.1/events.parquet' e, (SELECT unnest(range(6)) AS i) WHERE user_id % 8 IN (4, 7)"
    duckdb.sql(f"COPY ({events}) TO '{at}/events.parquet' (FORMAT parquet)")
    return str(at)


@pytest.mark.parametrize("name", ["mlofi_validation", "ofi_validation"])
def test_fits_of_few_pairs(spark, few, name):
    same(QUERIES[name](spark, few), ORACLES[name], few)


def test_conclusion_of_few_pairs(spark, few):
    """Conclusions rest on fits of few pairs, too: of two-hour bars here, by the query's SQL with that width."""
    out = validate.ofi_conclusions(replays._rounded(replays._every_fit(spark, few)), ("symbol",), 7200.0)
    sql = ORACLES["ofi_conclusions"].replace("WHERE tau_s = 3600", "WHERE tau_s = 7200")
    same(out, sql, few)
