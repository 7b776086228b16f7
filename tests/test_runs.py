"""A tape of many runs as one scan."""

from __future__ import annotations

import time

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from flowspark.sources import tape

from .conftest import SF

DAY = 86_400_000_000_000
NAMES = ["A", "A:B c+d%2", "é=x", None, "x[1]*?"]


def test_odd_names_come_back(spark, tmp_path):
    rows = [("x/y", s, i * DAY, i, i, 1.0, 1.0, 1) for i, s in enumerate(NAMES)]
    root = str(tmp_path / "tape")
    for run in ("r1", "r2"):
        tape.write(spark.createDataFrame(rows, tape.SCHEMAS["trades"]), f"{root}/{run}", "trades")
    got = sorted(tape.scan(spark, root, "trades", row_id=True).select("exchange", "symbol", "trade_id").collect(), key=str)
    assert got == sorted([(r[0], r[1], r[4]) for r in rows] * 2, key=str)
    for i, name in enumerate(NAMES):
        if name is not None:
            one = tape.scan(spark, root, "trades", exchange="x/y", symbol=name)
            assert {r["trade_id"] for r in one.collect()} == {i} and one.count() == 2
            assert len(tape.part_files(spark, root, "trades", symbol=name)) == 2
    assert tape.scan(spark, root, "trades", date="1970-01-02").count() == 2
    assert tape.scan(spark, root, "trades", symbol="none").count() == tape.scan(spark, root, "deltas").count() == tape.scan(spark, str(tmp_path / "gone"), "trades").count() == 0
    assert tape.stored_bytes(spark, root, "trades").where("bytes > 0").count() == len(NAMES)


def test_two_thousand_runs_are_planned_at_once(spark, tmp_path):
    root, n = tmp_path / "tape", 2000
    inside = pa.table({"ts_event_ns": [1], "ts_recv_ns": [2], "trade_id": [3], "price": [1.0], "qty": [1.0], "aggressor_sign": pa.array([1], pa.int8())})
    for i in range(n):
        at = root / f"run-{i:05d}" / "trades" / "exchange=x" / f"symbol=S{i % 4}" / "date=1970-01-01"
        at.mkdir(parents=True)
        pq.write_table(inside, at / "part-0.parquet")
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", "8")  # tasks of the listing job; 10,000 as Spark has it
    start = time.perf_counter()
    rows = tape.scan(spark, str(root), "trades", exchange="x")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert time.perf_counter() - start < 5
    assert "Union" not in plan
    assert rows.groupBy("symbol").count().orderBy("symbol").collect() == [(f"S{k}", n // 4) for k in range(4)]
    spark.conf.unset("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    assert tape.scan(spark, str(root), "trades", symbol="S1").select(F.sum("trade_id")).first()[0] == 3 * n // 4


def test_a_query_writes_the_kinds_that_it_reads(spark, monkeypatch):
    from flowspark.plans import replays

    monkeypatch.setattr(replays, "_TAPES", {})
    replays.vpin_from_tape(spark, SF)
    root = replays._root(spark, SF, "trades")
    there = lambda: {k for k in tape.SCHEMAS if tape.exists(spark, f"{root}/{k}")}
    assert there() == {"trades"}
    assert replays._root(spark, SF) == root and there() == set(tape.SCHEMAS)
    assert tape.scan(spark, root, "trades").count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_lines_are_shuffled_once(spark):
    """By order, which serves their levels, the arrays of these and the join with orders."""
    from flowspark.plans import views

    plan = views.deltas(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "side#" in line]
