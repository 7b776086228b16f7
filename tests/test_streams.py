"""The merged source of frame logs, and books kept on a stream, by hand-made logs."""

from __future__ import annotations

import json
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from flowspark.sources import frame_log, wire
from flowspark.streaming import books, processors


def run(rows, out, checkpoint) -> list[int]:
    """Runs a stream until nothing is left; the rows that each micro-batch read."""
    query = rows.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).start()
    try:
        query.processAllAvailable()
        return [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    finally:
        query.stop()


@pytest.fixture
def place(tmp_path):
    return tmp_path / "logs", tmp_path / "out", tmp_path / "checkpoint"


def collected(spark, out):
    return spark.read.parquet(str(out)).orderBy("arrival").collect()


def test_fair_order_limits_and_restarts(spark, place):
    """A fast and a slow socket, segments of odd sizes, batches of at most 60, a restart in the middle."""
    root, out, checkpoint = place
    fast, slow = frame_log.Appender(str(root), "fast"), frame_log.Appender(str(root), "slow")
    for k in range(3):
        fast.append([(k * 1000 + i * 10, "S", f"{k}-{i}") for i in range(100)])
    slow.append([(i * 500, None, "x" * i) for i in range(5)])
    slow.append([])
    slow.append([(2500, None, None)])
    stream = lambda: frame_log.stream(spark, str(root), str(checkpoint), max_rows=60)
    sizes = run(stream(), out, checkpoint)
    assert max(sizes) == 60 and len(sizes) >= 5
    rows = collected(spark, out)
    assert rows[-1]["ts_recv_ns"] == 2500  # fast's later frames wait for slow
    slow.end()
    assert sum(run(stream(), out, checkpoint)) == 306 - len(rows)
    fast.append([(3000, "S", "more")])
    frame_log.Appender(str(root), "third").append([(3000, "T", "late socket")])
    fast.end()
    run(stream(), out, checkpoint)
    rows = collected(spark, out)
    assert [r["arrival"] for r in rows] == list(range(308))
    assert all((a["ts_recv_ns"], a["socket"]) <= (b["ts_recv_ns"], b["socket"]) for a, b in pairwise(rows))
    for socket in ("fast", "slow", "third"):
        assert [r["place"] for r in rows if r["socket"] == socket] == list(range(sum(r["socket"] == socket for r in rows)))
    assert max(r["backlog"] for r in rows) == 306  # the high-water mark: all that had landed
    assert run(stream(), out, checkpoint) == []


def test_a_batch_fails_and_runs_again(spark, place):
    """Nothing is lost or read twice when a micro-batch fails after it was planned."""
    root, out, checkpoint = place
    log = frame_log.Appender(str(root), "a")
    log.append([(i, "S", str(i)) for i in range(50)])
    log.end()
    seen = []

    def write(fail: bool):
        def batch(rows, n):
            if fail and n == 2:
                raise RuntimeError("lost")
            seen.extend(r["arrival"] for r in rows.collect())

        return batch

    for fail in (True, False):
        query = frame_log.stream(spark, str(root), str(checkpoint), max_rows=10).writeStream.foreachBatch(write(fail)).option("checkpointLocation", str(checkpoint)).start()
        try:
            query.processAllAvailable()
        except Exception as e:
            assert fail and "lost" in str(e)
        finally:
            query.stop()
    assert sorted(seen) == list(range(50))


def test_bytes_and_patience(spark, place):
    root, out, checkpoint = place
    talks, silent = frame_log.Appender(str(root), "talks"), frame_log.Appender(str(root), "silent")
    silent.append([(0, None, "x")])
    talks.append([(i * 1_000_000, None, "y" * 40) for i in range(100)])
    stream = frame_log.stream(spark, str(root), str(checkpoint), max_bytes=100, patience_ms=50)
    sizes = run(stream, out, checkpoint)
    assert max(sizes) <= 3 and sum(sizes) == 101  # `silent` is 99 ms behind and no longer waited for
    with pytest.raises(ValueError, match="order of receipt"):
        talks.append([(2, None, ""), (1, None, "")])


def test_empty_root(spark, place):
    root, out, checkpoint = place
    root.mkdir()
    assert run(frame_log.stream(spark, str(root), str(checkpoint)), out, checkpoint) == []


def test_backlog_is_observed(spark, place):
    root, out, checkpoint = place
    log = frame_log.Appender(str(root), "a")
    log.append([(i, "S", "") for i in range(30)])
    log.end()
    from flowspark.streaming import recorder

    listener = recorder.BacklogLog()
    spark.streams.addListener(listener)
    try:
        run(recorder.with_backlog(frame_log.stream(spark, str(root), str(checkpoint), max_rows=20)), out, checkpoint)
        for _ in range(100):
            if listener.batches == 2:
                break
            import time

            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert (listener.high_water, listener.batches, listener.most) == (30, 2, 20)


DAY_MS = 86_400_000


def update(u: int, ts: int, bids=(), asks=(), pu: int | None = None, first: int | None = None) -> tuple:
    body = {"e": "depthUpdate", "E": DAY_MS + ts, "s": "a", "U": u if first is None else first, "u": u, "pu": u - 1 if pu is None else pu, "b": [list(map(str, x)) for x in bids], "a": [list(map(str, x)) for x in asks]}
    return (ts * 10, None, json.dumps(body))


def snapshot(u: int, ts: int, bids=((100, 1),), asks=((101, 2),)) -> tuple:
    return (ts * 10, "a", json.dumps({"E": DAY_MS + ts, "lastUpdateId": u, "bids": [list(map(str, x)) for x in bids], "asks": [list(map(str, x)) for x in asks]}))


def events(spark, place, frames, rows_a_batch, *carried):
    root, _, checkpoint = place
    for socket, some in frames.items():
        log = frame_log.Appender(str(root), socket)
        log.append(some)
        log.end()
    return wire.book_events(frame_log.stream(spark, str(root), str(checkpoint), max_rows=rows_a_batch), "arrival", *carried)


def test_snapshots_on_time(spark, place):
    """Ticks come from later rows and from the watermark; a gap silences them until the next snapshot,
    a snapshot within the chain changes nothing."""
    frames = [
        update(10, 5, first=8), snapshot(9, 6), update(11, 1500, [(99, 5), (98, 1)]), update(12, 2000, [(99, 0)]), snapshot(12, 2100, [(7, 7)], [(8, 8)]), update(13, 3500, [], [(101, 0), (102, 3)]),
        update(20, 4200, [(1, 1)]), update(30, 5500, [(100, 9)], pu=20), snapshot(29, 6500, [(90, 1)], [(91, 1)]), update(31, 9000, [(89, 1)]),
    ]
    # Update 20 names 19 where 13 was the last; what follows is held until snapshot 29, which 30 does not bracket.
    frames[7] = update(30, 5500, [(90, 9)], pu=20, first=28)
    stream = events(spark, place, {"x": frames}, 3)
    rows = processors.drained(books.timed(stream, books.BookSnapshots(1000, block=1), "100 milliseconds"), str(place[1]), str(place[2]), at_once=False)
    got = {}
    for r in rows.orderBy("side", "block").collect():
        assert len(r["levels"]) == 1
        got.setdefault((r["tick_ms"] - DAY_MS, r["last_update_id"]), []).append((r["side"], r["levels"][0]["price"], r["levels"][0]["qty"]))
    start = [("ask", 101.0, 2.0), ("bid", 100.0, 1.0)]
    assert got == {
        (1000, 10): start, (2000, 12): [("ask", 101.0, 2.0), ("bid", 100.0, 1.0), ("bid", 98.0, 1.0)], (3000, 12): [("ask", 101.0, 2.0), ("bid", 100.0, 1.0), ("bid", 98.0, 1.0)],
        (4000, 13): [("ask", 102.0, 3.0), ("bid", 100.0, 1.0), ("bid", 98.0, 1.0)], (7000, 30): [("ask", 91.0, 1.0), ("bid", 90.0, 9.0)], (8000, 30): [("ask", 91.0, 1.0), ("bid", 90.0, 9.0)],
    }


def test_probes_on_the_stream(spark, place):
    """Aligned at once, after updates, past its id, over a gap, after a snapshot in between, out of patience."""
    depth = [snapshot(10, 0), update(12, 20, [(99, 4)], pu=10), update(15, 40, [(100, 3)], pu=12), update(18, 50, [(98, 1)], pu=16), snapshot(30, 60), update(35, 80, pu=30, bids=[(97, 2)])]
    probes = [(10, 5), (14, 25), (12, 26), (17, 45), (33, 70), (90, 85)]  # ids and times
    frames = {"depth": depth, "probes": [snapshot(i, ts, [(100, 3)], [(101, 2)]) for i, ts in probes]}
    stream = events(spark, place, frames, 2, "socket").withColumn("probe", F.when(F.col("socket") == "probes", F.col("final_update_id"))).drop("socket")
    rows = processors.drained(books.timed(stream, books.ProbeAlign(5, 1000), "5 seconds"), str(place[1]), str(place[2]), at_once=False)
    got = {r["probe"]: (r["aligned_u"], r["stale"], r["batches"], [(x["price"], x["qty"]) for x in r["bids"]]) for r in rows.collect()}
    assert got == {
        10: (10, False, 0, [(100.0, 1.0)]), 14: (15, False, 1, [(100.0, 3.0), (99.0, 4.0)]), 12: (12, False, 0, [(100.0, 1.0), (99.0, 4.0)]),
        17: (None, True, 1, []), 33: (35, False, 1, [(100.0, 1.0), (97.0, 2.0)]),
    }


def test_small_segments_share_tasks_and_are_counted_once(spark, place, monkeypatch):
    """Forty segments of 5 frames are one task, not forty; a batch that starts inside a segment goes on there."""
    root, _, _ = place
    log = frame_log.Appender(str(root), "a")
    for k in range(40):
        log.append([(k * 5 + i, "S", f"{k}-{i}") for i in range(5)])
    log.end()
    counted = []
    count = frame_log.pq.read_metadata
    monkeypatch.setattr(frame_log.pq, "read_metadata", lambda p, **more: counted.append(p) or count(p, **more))
    reader, start, told = frame_log.FrameLogReader({"path": str(root), "max_rows": "83"}), None, []
    for n_tasks in (1, 1, 1):
        start = start or reader.initialOffset()
        end = reader.latestOffset()
        tasks = reader.partitions(start, end)
        assert len(tasks) == n_tasks
        told += [tuple(r) for t in tasks for b in reader.read(t) for r in zip(*(b.column(i).to_pylist() for i in (0, 2, 5)), strict=True)]
        start = end
    assert told == [(n, n, f"{n // 5}-{n % 5}") for n in range(200)]
    assert len(counted) == 40
    monkeypatch.setattr(frame_log, "TASK_ROWS", 12)
    assert len(frame_log.FrameLogReader({"path": str(root)}).partitions(reader.initialOffset(), end)) == 20


def test_levels_reach_books_as_numbers(spark):
    """Not as a dict for each level, which took most of a row's time."""
    rows = spark.createDataFrame([("S", [(1.0, 2.0), (3.0, 4.0)], []), ("S", None, [(5.0, 0.0)])], "symbol string, bids array<struct<price: double, qty: double>>, asks array<struct<price: double, qty: double>>")
    got = processors.taken(rows, books.BookStates())
    assert dict(got.dtypes)["bids"] == "array<double>"
    assert [[books.plain(x) for x in r] for r in got.select("bids", "asks").toPandas().to_numpy()] == [[[(1.0, 2.0), (3.0, 4.0)], []], [[], [(5.0, 0.0)]]]


def test_a_frame_is_parsed_once(spark):
    """Filters on the payload don't parse it again."""
    frames = spark.createDataFrame([(1, "s", "{}", 1)], "ts_recv_ns long, symbol string, raw string, arrival long")
    for rows in (wire.book_events(frames, "arrival"), wire.depth_updates(frames, "x"), wire.rest_snapshots(frames, "x"), wire.prints(frames, "x"), wire.probe_events(frames)):
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1


def test_segments_grow_with_a_log():
    """Logs of a few thousand frames have several segments, a large one a bounded number of its size."""
    from flowspark.plans import streams

    assert [streams._segment_rows(n) for n in (0, 15_000, 1_000_000, 54_000_000)] == [2_000, 2_000, 3_906, 16_384]


def test_rows_come_by_arrival_from_whole_columns():
    import pandas as pd

    batch = lambda *rows: pd.DataFrame(rows, columns=["arrival", "is_snapshot", "bids"])
    got = list(books.in_order(iter([batch((3, False, [1.0, 2.0])), batch((1, True, None), (2, False, []))]), "arrival", "is_snapshot", "bids"))
    assert got == [(1, True, []), (2, False, []), (3, False, [(1.0, 2.0)])]


def test_planning_looks_ahead_by_bytes_too(spark, place, monkeypatch):
    """A batch of few bytes looks at the times of few frames, whatever its limit of rows, and at none twice."""
    root, _, _ = place
    log = frame_log.Appender(str(root), "a")
    for k in range(60):
        log.append([(k * 10 + i, "S", "x" * 100) for i in range(10)])
    log.end()
    monkeypatch.setattr(frame_log, "TASK_ROWS", 20)
    read, opened = [], frame_log.pq.ParquetFile
    monkeypatch.setattr(frame_log.pq, "ParquetFile", lambda f, **more: read.append(1) or opened(f, **more))
    reader, sizes = frame_log.FrameLogReader({"path": str(root), "max_rows": "1000", "max_bytes": "4000"}), []
    start = reader.initialOffset()
    while (end := reader.latestOffset()) != start:
        reader.partitions(start, end)
        if not sizes:
            assert len(read) <= 2 * frame_log.AT_ONCE
        sizes.append(end["arrivals"] - start["arrivals"])
        start = end
    assert sizes == [40] * 15 and len(read) == 60


def test_few_keys_have_tasks_of_their_own(spark):
    keys = ["B0", "B1", "B2", "B3"]
    n = processors.apart(spark, keys)
    at = spark.createDataFrame([(k,) for k in keys], "symbol string").repartition(n, "symbol").select(F.spark_partition_id().alias("p")).distinct().count()
    assert at == 4 and n <= 16
    assert processors.apart(spark, [str(i) for i in range(1000)]) == processors.apart(spark, []) == int(spark.conf.get("spark.sql.shuffle.partitions"))
