"""The synchroniser's decisions over several micro-batches, and its pure rule."""

from __future__ import annotations

import json

import pytest

from flowspark.streaming import processors as P


@pytest.mark.parametrize(("last", "synced", "ids", "want"), [
    (1000, False, (900, 950, 880), P.STALE), (1000, False, (995, 1003, 994), P.APPLY), (1000, False, (990, 1000, 989), P.APPLY), (1000, False, (1001, 1005, 1000), P.RESYNC),
    (1003, True, (1012, 1015, 1011), P.RESYNC), (1003, True, (1004, 1008, 1003), P.APPLY),
])
def test_rule(last, synced, ids, want):
    assert P.decide(last, synced, *ids) == want


LV = "array<struct<price:double,qty:double>>"
SCHEMA = f"symbol string, arrival long, is_snapshot boolean, first_update_id long, final_update_id long, prev_final_update_id long, bids {LV}, asks {LV}"


def test_book_sync(spark, tmp_path):
    lv = lambda *x: [{"price": p, "qty": q} for p, q in x]
    up = lambda n, a, b, c, bids=(): {"symbol": "a", "arrival": n, "is_snapshot": False, "first_update_id": a, "final_update_id": b, "prev_final_update_id": c, "bids": lv(*bids), "asks": []}
    sn = lambda n, u: {"symbol": "a", "arrival": n, "is_snapshot": True, "first_update_id": u, "final_update_id": u, "prev_final_update_id": u, "bids": lv((100, 1)), "asks": lv((101, 2))}
    batches = [[up(0, 90, 95, 85), up(1, 98, 102, 95, [(100.5, 3)]), up(2, 103, 104, 102, [(100.5, 0)])], [sn(3, 100), up(4, 110, 112, 108)], [up(5, 113, 115, 112), sn(6, 113)]]
    src = tmp_path / "in"
    src.mkdir()
    for i, b in enumerate(batches):
        (src / f"{i}.json").write_text("\n".join(map(json.dumps, b)))
        import os

        os.utime(src / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(src))
    out = P.drained(P.stateful(stream, P.BookSync()), str(tmp_path / "out"), str(tmp_path / "state"))
    got = [(r["arrival"], r["decision"], r["bid_px"]) for r in out.collect()]
    by = {}
    for a, dec, px in got:
        by.setdefault(a, []).append((dec, px))
    final = {a: [x for x in v if x[0] != P.BUFFERED][-1:] or v for a, v in by.items()}
    assert final[0][0][0] == P.STALE and final[1] == [(P.APPLY, 100.5)] and final[2] == [(P.APPLY, 100.0)]
    assert final[3] == [("SNAPSHOT", 100.0)] and final[4][0][0] == P.RESYNC and final[6] == [("SNAPSHOT", 100.0)]
    assert final[5][0][0] == P.APPLY


def landed(path, batches):
    import os

    path.mkdir()
    for i, b in enumerate(batches):
        (path / f"{i}.json").write_text("\n".join(map(json.dumps, b)))
        os.utime(path / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    return str(path)


def test_disconnect_and_full_buffer(spark, tmp_path):
    none = {"bids": [], "asks": [], "disconnect": False}
    up = lambda n, u: {"symbol": "a", "arrival": n, "is_snapshot": False, "first_update_id": u, "final_update_id": u, "prev_final_update_id": u - 1} | none
    sn = lambda n, u: up(n, u) | {"is_snapshot": True, "bids": [{"price": 100.0, "qty": 1.0}], "asks": [{"price": 101.0, "qty": 1.0}]}
    batches = [[up(0, 5), up(1, 6), up(2, 7)], [sn(3, 6)], [up(4, 7), up(5, 8) | {"disconnect": True}, up(6, 9)], [sn(7, 9), up(8, 10)]]
    source = landed(tmp_path / "in", batches)
    stream = spark.readStream.schema(SCHEMA + ", disconnect boolean").option("maxFilesPerTrigger", 1).json(source)
    out = P.drained(P.stateful(stream, P.BookSync(2)), str(tmp_path / "out"), str(tmp_path / "state")).collect()
    by = {}
    for r in sorted(out, key=lambda r: (r["arrival"], r["decision"] != P.BUFFERED)):
        by.setdefault(r["arrival"], []).append(r["decision"])
    assert by[2] == [P.BUFFERED] and max(r["n_dropped"] for r in out) == 1
    assert by[3] == ["SNAPSHOT"] and by[1] == [P.BUFFERED, P.APPLY] and by[0] == [P.BUFFERED, P.STALE]
    assert by[4] == [P.APPLY] and by[5] == ["DISCONNECT"]
    assert by[6] == [P.BUFFERED, P.APPLY] and by[8] == [P.APPLY]


def test_late_states_are_stale(spark, tmp_path):
    st = lambda seq, b, q: {"symbol": "a", "seq": seq, "epoch": 1, "ts_event_ns": seq, "bid_px": b, "bid_qty": q, "ask_px": b + 1, "ask_qty": 1.0}
    batches = [[st(1, 10.0, 1.0), st(2, 10.0, 3.0)], [st(2, 9.0, 9.0), st(3, 10.0, 4.0)], [st(1, 1.0, 1.0)], [st(4, 10.0, 4.5)]]
    stream = spark.readStream.schema("symbol string, seq long, epoch long, ts_event_ns long, bid_px double, bid_qty double, ask_px double, ask_qty double").option("maxFilesPerTrigger", 1).json(landed(tmp_path / "in", batches))
    out = P.drained(P.stateful(stream, P.Ofi()), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted((r["seq"], r["e"]) for r in out.collect()) == [(2, 2.0), (3, 1.0), (4, 0.5)]


def test_recorded_frames(spark, tmp_path):
    from flowspark.operators import capture
    from flowspark.sources import tape
    from flowspark.streaming import recorder as R

    depth = lambda u, p, t: json.dumps({"stream": "x", "data": {"e": "depthUpdate", "E": t, "s": "ab", "U": p + 1, "u": u, "pu": p, "b": [["100.5", "2"]], "a": [["101", "0"]]}})
    trade = json.dumps({"e": "aggTrade", "E": 4, "T": 3, "s": "ab", "a": 7, "p": "100.5", "q": "2", "m": True})
    body = json.dumps({"lastUpdateId": 10, "E": 1, "bids": [["100", "1"]], "asks": [["102", "1"]]})
    frame = lambda raw, symbol=None: {"raw": raw, "ts_recv_ns": 9_000_000, "symbol": symbol}
    source = landed(tmp_path / "in", [[frame(body, "ab"), frame(depth(11, 10, 2))], [frame(trade), frame("junk"), frame(depth(12, 11, 3))]])
    root = str(tmp_path / "tape")
    R.record(R.frames_of(spark, source, 1), root, "x", str(tmp_path / "check")).awaitTermination()
    assert [tape.scan(spark, root, k).count() for k in ("snapshots", "deltas", "trades")] == [1, 2, 1]
    R.write_batch(spark.read.schema("raw string, ts_recv_ns long, symbol string").json(f"{source}/1.json"), root, "x", 1)
    assert tape.scan(spark, root, "deltas").count() == 2
    assert [(r["bid_px"], r["ask_px"]) for r in capture.book_states(spark, root).orderBy("seq").collect()] == [(100.0, 102.0), (100.5, 102.0), (100.5, 102.0)]


def test_command_line(spark, tmp_path, capsys):
    from flowspark.__main__ import main
    from flowspark.settings import Settings

    from .test_replay import stored

    root = stored(spark, str(tmp_path / "t"))
    assert main(["stats", root, "--symbol", "A"], spark) == 0
    assert "| x | A | 3 | 4 | 8 |" in capsys.readouterr().out
    assert main(["check", root], spark) == 1
    assert Settings.of({"Data_Dir": "/d", "OTHER": "1"}) == Settings("/d", "INFO")


def test_watchdog(spark, tmp_path):
    """A symbol whose depth goes silent is told once; trades keep nobody alive."""
    import time

    from flowspark.streaming import recorder as R

    source = landed(tmp_path / "in", [[{"symbol": "a", "kind": "depth"}, {"symbol": "b", "kind": "trade"}]])
    stream = R.watched(spark.readStream.schema("symbol string, kind string").json(source), 500)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", P.ROCKSDB)
    try:
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="500 milliseconds").start()
        got = []
        for _ in range(120):
            time.sleep(0.5)
            if not query.isActive:
                break
            got = spark.read.schema(R.Watchdog.SCHEMA).parquet(str(tmp_path / "out")).collect() if (tmp_path / "out" / "_spark_metadata").exists() else []
            if got:
                break
        query.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert [r["symbol"] for r in got] == ["a"] and got[0]["noticed_ms"] >= got[0]["last_arrival_ms"] + 500
