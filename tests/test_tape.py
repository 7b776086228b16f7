"""Book, chain, quality, feed and position goldens over small synthetic tapes."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from flowspark.operators import book, chain, convert, quality, regress
from flowspark.sources import tape, wire

from .conftest import rows

T0, MS = 1_725_235_200_000_000_000, 1_000_000
K = ("symbol",)
LV = "array<struct<price:double,qty:double>>"


def snap(uid, bids=((100, 10), (99, 5)), asks=((101, 8), (102, 3)), ts=0):
    return ("a", T0 + ts * MS, T0 + (ts + 1) * MS, uid, [tuple(map(float, x)) for x in bids], [tuple(map(float, x)) for x in asks])


def delta(first, final, prev, bids=(), asks=(), ts=1):
    return ("a", T0 + ts * MS, T0 + (ts + 1) * MS, first, final, prev, [tuple(map(float, x)) for x in bids], [tuple(map(float, x)) for x in asks])


def frames(spark, snaps, deltas):
    s = spark.createDataFrame([(*r, i) for i, r in enumerate(snaps)], f"symbol string, ts_event_ns long, ts_recv_ns long, last_update_id long, bids {LV}, asks {LV}, row_id long")
    d = spark.createDataFrame([(*r, i) for i, r in enumerate(deltas)], f"symbol string, ts_event_ns long, ts_recv_ns long, first_update_id long, final_update_id long, prev_final_update_id long, bids {LV}, asks {LV}, row_id long")
    return s, d


CLEAN = ([snap(100), snap(110, bids=((100, 12), (99, 5)), asks=((102, 2),), ts=2)], [delta(95, 105, 90, bids=[(100, 12)], asks=[(101, 0)]), delta(106, 110, 105, asks=[(102, 2)], ts=2)])


def levels(df):
    return {(r["side"], r["price"]): r["qty"] for r in df.collect()}


def test_book_at_time(spark):
    s, d = frames(spark, [snap(100)], [*CLEAN[1], delta(111, 115, 110, bids=[(99, 0)], ts=3)])
    at = lambda ms: levels(chain.book_at_time(s, d, K, T0 + ms * MS)[0])
    assert at(0) == {("bid", 100): 10, ("bid", 99): 5, ("ask", 101): 8, ("ask", 102): 3}
    assert at(1) == {("bid", 100): 12, ("bid", 99): 5, ("ask", 102): 3}
    assert at(3) == {("bid", 100): 12, ("ask", 102): 2}
    assert chain.book_at_time(s, d, K, T0 - 1)[1].count() == 0
    s, d = frames(spark, [snap(100)], [delta(200, 201, 199)])
    assert chain.book_at_time(s, d, K, T0 + MS)[1].first()["n_gaps"] == 1


def test_book_at_id(spark):
    s, d = frames(spark, [snap(100)], [delta(98, 105, 97, bids=[(100, 5)]), delta(106, 110, 105, bids=[(100, 7)], ts=2)])
    for rest, qty, u, n in ((100, 10, 100, 0), (110, 7, 110, 2), (108, 7, 110, 2), (103, 5, 105, 1)):
        got, status = chain.book_at_id(s, d, K, rest)
        assert levels(got)[("bid", 100)] == qty
        assert tuple(status.select("aligned_u", "n_batches", "n_gaps").first()) == (u, n, 0)
    assert chain.book_at_id(s, d, K, 50)[1].count() == 0
    assert chain.book_at_id(s, d, K, 200)[1].first()["aligned_u"] is None


def test_top_of_book(spark):
    s, _ = frames(spark, [snap(100)], [])
    b = book.depth(book.live_levels(book.changes(s.withColumn("seq", F.lit(0)), K, "seq"), K), K, 2)
    from flowspark.functions import scalars

    bid, ask = book.level_at("bids", 1), book.level_at("asks", 1)
    r = b.select(scalars.mid(bid["price"], ask["price"]), scalars.spread(bid["price"], ask["price"]), scalars.microprice(bid["price"], bid["qty"], ask["price"], ask["qty"]), scalars.imbalance("bids", "asks", 1), scalars.imbalance("bids", "asks", 2),
                 book.level_at("bids", 3), book.padded("bids", "price", 3)).first()
    assert tuple(r)[:3] == (100.5, 1.0, pytest.approx(1810 / 18)) and r[3] == pytest.approx(2 / 18) and r[4] == pytest.approx(4 / 26)
    assert r[5] is None and r[6] == [100.0, 99.0, None]
    with pytest.raises(ValueError):
        book.depth(b, K, 0)


def walk(spark, snaps, deltas):
    s, d = frames(spark, snaps, deltas)
    return chain.select(chain.headers(s, d, K), K)


def test_select(spark):
    got = rows(walk(spark, *CLEAN).select("seq", "uid", "is_snapshot", "fate"))
    # The first delta can't continue an unknown book; its snapshot comes first in id order.
    assert [(r[1], r[3]) for r in got] == [(100, "kept"), (105, "kept"), (110, "kept"), (110, "periodic")]
    got = rows(walk(spark, [snap(305, ts=6)], [delta(299, 305, 290, bids=[(100.5, 2)]), delta(306, 310, 305)]).select("seq", "uid", "is_snapshot", "fate"))
    assert [(r[1], r[2], r[3]) for r in got] == [(305, True, "kept"), (305, False, "kept"), (310, False, "kept")]
    got = rows(walk(spark, [snap(100), snap(300)], [delta(1, 2, 0), delta(90, 95, 85), delta(200, 201, 199), delta(301, 305, 300)]).select("seq", "uid", "fate"))
    assert [r[1:] for r in got] == [(2, "off_chain"), (95, "off_chain"), (100, "kept"), (201, "off_chain"), (300, "kept"), (305, "kept")]


def test_restamp_and_states(spark):
    snaps = [snap(100), snap(300, bids=((100, 1),), ts=6)]
    deltas = [delta(95, 105, 90, bids=[(100, 5)]), delta(299, 305, 290, bids=[(100.5, 2)], ts=5)]
    kept, moves = chain.replay(*frames(spark, snaps, deltas), K)
    got = rows(kept.select("seq", "ts_event_ns"))
    assert [r[1] for r in got] == sorted({r[1] for r in got})
    s = rows(chain.states(kept, moves, K).select("seq", "epoch", "new_epoch", "bid_px", "bid_qty"))
    assert s == [(0, 0, True, 100.0, 10.0), (1, 0, False, 100.0, 5.0), (2, 1, True, 100.0, 1.0), (3, 1, False, 100.5, 2.0)]
    top = rows(book.swept(moves, kept, K, 1).select("seq", book.level_at("bids", 1)["price"].alias("p")))
    assert [r[1] for r in top] == [100.0, 100.0, 100.0, 100.5]


def test_interval_join_is_replay(spark):
    """Random changes: the best prices after each step, replayed in plain Python."""
    rng = random.Random(5)
    moves, want, state = [], [], {"bid": {}, "ask": {}}
    for seq in range(200):
        for pos in range(rng.randint(0, 3)):
            side = rng.choice(["bid", "ask"])
            price, qty = float(rng.randint(1, 6) + (10 if side == "ask" else 0)), float(rng.choice([0, 1, 2]))
            moves.append(("a", 0, seq, pos, side, price, qty))
            state[side].pop(price, None)
            if qty:
                state[side][price] = qty
        b, a = max(state["bid"], default=None), min(state["ask"], default=None)
        if b is not None or a is not None:
            want.append((seq, b, state["bid"].get(b), a, state["ask"].get(a)))
    m = spark.createDataFrame(moves, "symbol string, group long, seq long, pos int, side string, price double, qty double")
    at = spark.range(200).selectExpr("'a' AS symbol", "0L AS group", "id AS seq")
    for chunk in (7, 512):
        assert rows(book.best_at(m, at, K, chunk).select("seq", "bid_px", "bid_qty", "ask_px", "ask_qty"), "seq") == want


@pytest.mark.parametrize(("snaps", "deltas", "epochs", "breaks"), [
    ([], [], 1, 0), ([snap(300)], [delta(299, 305, 290)], 2, 0), ([snap(300)], [delta(301, 305, 300)], 2, 0), ([], [delta(120, 125, 118)], 1, 1),
])
def test_audit(spark, snaps, deltas, epochs, breaks):
    s, d = frames(spark, CLEAN[0] + snaps, CLEAN[1] + deltas)
    assert tuple(chain.audit(d, s, K).select("epochs", "breaks").first()) == (epochs, breaks)


def tape_trades(spark, items):
    return spark.createDataFrame([("a", T0 + i * MS, T0 + i * MS + 1, n, float(p), float(q), sg) for i, (n, p, q, sg) in enumerate(items)], "symbol string, ts_event_ns long, ts_recv_ns long, trade_id long, price double, qty double, aggressor_sign byte")


def test_quality(spark):
    s, d = frames(spark, [*CLEAN[0], snap(400, bids=((102, 1),))], CLEAN[1])
    t = tape_trades(spark, [(1, 100, 1, 1), (2, 100, 0, -1), (2, 100.5, 1, 1)])
    r = quality.summary(s, d, t, K, tick=1.0).first()
    assert (r["n_crossed"], r["n_duplicate_ids"], r["n_zero_qty"], r["n_off_grid"], r["ok"], len(r["issues"]), len(r["warnings"])) == (1, 1, 1, 1, False, 3, 1)
    r = quality.summary(*frames(spark, *CLEAN), tape_trades(spark, [(1, 100, 1, 1)]), K).first()
    assert r["ok"] and r["n_off_grid"] is None and len(r["warnings"]) == 1


def test_gaps_and_distributions(spark):
    _, d = frames(spark, [], [delta(1, 1, 0, ts=100), delta(2, 2, 1, ts=200), delta(3, 3, 2, ts=700)])
    got = rows(quality.gaps(d, K, 200 * MS, "final_update_id").where("clock = 'event'").select("gap_ns"))
    assert got == [(500 * MS,)]
    df = spark.createDataFrame([("a", x) for x in range(10_000)], "symbol string, v long")
    r = quality.distribution(df, K, "v").first()
    assert (r["p50"], r["p90"], r["p99"], r["p99_9"]) == (4999.5, pytest.approx(8999.1), pytest.approx(9899.01), pytest.approx(9989.001))


def test_compare_top(spark):
    s = "symbol string, side string, price double, qty double"
    local = spark.createDataFrame([("a", "bid", 100.0, 10.0), ("a", "bid", 99.0, 5.0), ("a", "ask", 101.0, 8.0), ("a", "ask", 102.0, 3.0)], s)
    rest = spark.createDataFrame([("a", "bid", 100.0, 10.0), ("a", "bid", 99.0, 4.0), ("a", "ask", 101.0, 8.0), ("a", "ask", 102.0, 3.0)], s)
    r = quality.compare_top(local, rest, K, 20).first()
    assert (r["compared"], r["mismatches"], r["most"], len(r["details"])) == (4, 1, 1.0, 1)


def test_feed(spark):
    snaps = [snap(100, bids=((100, 10), (98, 0))), snap(300, bids=((100, 1),), asks=(), ts=9)]
    deltas = [delta(95, 105, 90, bids=[(97, 5)], asks=[(101, 0)]), delta(106, 110, 105, ts=2), delta(400, 401, 399, ts=10)]
    s, d = frames(spark, snaps, deltas)
    t = tape_trades(spark, [(1, 100, 1, 1), (-2, 100, 2, -1), (3, 100, 0, 1)])
    initial, feed, counters = convert.replay_feed(s, d, t, K)
    assert initial.count() == 3 and counters.first()["gap"] == 0
    got = feed.collect()
    from flowspark.functions.scalars import DEPTH_CLEAR_EVENT, KIND_MASK, TRADE_EVENT

    assert all(r["local_ts"] > r["exch_ts"] for r in got)
    kinds = [r["ev"] & KIND_MASK for r in got]
    assert kinds[0] == TRADE_EVENT and kinds.count(TRADE_EVENT) == 2 and kinds.count(DEPTH_CLEAR_EVENT) == 1
    clear = next(r for r in got if r["ev"] & KIND_MASK == DEPTH_CLEAR_EVENT)
    assert clear["px"] == 97.0  # as deep as the old book went
    assert {r["order_id"] for r in got if r["ev"] & KIND_MASK == TRADE_EVENT} == {0, 1}


def test_ops(spark):
    s, d = frames(spark, [snap(100, bids=((100, 10), (99, 0)))], [delta(1, 2, 0, bids=[(99, 0)], asks=[(101, 2)])])
    got = rows(convert.snapshot_ops(s, K, 1.0).select("pos", "action", "flags", "order_id"))
    assert got == [(0, "clear", 32, None), (1, "add", 0, 100), (2, "add", 0, 101), (3, "add", 128, 102)]
    assert rows(convert.delta_ops(d, K, 1.0).select("pos", "action", "flags")) == [(0, "delete", 0), (1, "update", 128)]


def test_quotes(spark):
    df = spark.createDataFrame([(100.0, 10.0, 99.9, 100.1), (100.0, -10.0, 99.9, 100.1), (100.0, 0.0, 99.9, 100.1), (100.05, 0.0, 100.0, 100.1)], "m double, e double, b double, a double")
    got = [tuple(r[0]) for r in df.select(convert.maker_quotes("m", "e", "b", "a", 0.1, 1, 1.0)).collect()]
    assert got == [(1000, 1002), (998, 1000), (999, 1001), (999, 1001)]


def test_positions(spark):
    steps = [(1, 2, 100, 0), (1, 2, 110, 0), (-1, 1, 120, 0), (-1, 5, 90, 0), (1, 2, 80, 0)]
    want = [(2, 100, 0), (4, 105, 0), (3, 105, 15), (-2, 90, -30), (0, 0, -10)]
    for n, w in enumerate(want, 1):
        f = spark.createDataFrame([("a", i, i, s, float(q), float(p), float(fee)) for i, (s, q, p, fee) in enumerate(steps[:n])], "symbol string, ts long, fill_id long, sign int, qty double, price double, fee double")
        assert rows(convert.positions(f, K))[0][1:] == tuple(map(float, w))
    f = spark.createDataFrame([("a", 0, 0, 1, 1.0, 5.0, 0.5), ("a", 1, 1, -1, 1.0, 5.0, 0.25)], "symbol string, ts long, fill_id long, sign int, qty double, price double, fee double")
    assert rows(convert.positions(f, K))[0][1:] == (0.0, 0.0, -0.75)


def test_multi_ols(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 2))
    y = 1 + x @ [2, -3] + rng.normal(size=60)
    df = spark.createDataFrame([("a", float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "symbol string, x1 double, x2 double, y double")
    r = regress.ols_multi(df, K, ["x1", "x2"], "y").first()
    a = np.column_stack([np.ones(60), x])
    c, *_ = np.linalg.lstsq(a, y, rcond=None)
    assert r["coefficients"] == pytest.approx(c.tolist())
    assert r["r2"] == pytest.approx(1 - ((y - a @ c) ** 2).sum() / ((y - y.mean()) ** 2).sum())


def test_tape_files(spark, tmp_path):
    root = str(tmp_path / "base")
    assert tape.scan(spark, root, "trades").columns == tape.SCHEMAS["trades"].names
    t = tape_trades(spark, [(1, 100, 1, 1), (2, 100, 1, -1)]).withColumn("exchange", F.lit("x"))
    tape.write(t, f"{root}/run1", "trades")
    tape.write(t.withColumn("trade_id", F.col("trade_id") + 10).withColumn("ts_event_ns", F.col("ts_event_ns") + 86_400_000_000_000), f"{root}/run2", "trades")
    assert [r[0] for r in tape.read(spark, root, "trades", exchange="x").select("trade_id").collect()] == [1, 2, 11, 12]
    assert tape.scan(spark, root, "trades", date="2024-09-02").count() == 2
    assert tape.scan(spark, root, "trades", symbol="z").count() == 0
    assert len(tape.capture_dirs(spark, root)) == 2
    spec = {"exchange": "x", "symbol": "a", "tick_size": "0.00001", "lot_size": "1"}
    with pytest.raises(tape.NoInstrument):
        tape.resolve_instrument(spark, root, "a")
    tape.write_instrument(spark, f"{root}/run1", spec)
    r = tape.resolve_instrument(spark, root, "a").first()
    assert (r["price_precision"], r["size_precision"]) == (5, 0)
    with pytest.raises(ValueError):
        tape.resolve_instrument(spark, root, "b")
    tape.write_instrument(spark, f"{root}/run2", spec | {"tick_size": "0.1"})
    with pytest.raises(ValueError):
        tape.instrument(spark, root)


def test_wire(spark):
    raw = [
        '{"e":"depthUpdate","E":1725235200123,"T":1725235200120,"s":"BTCUSDT","U":1027025,"u":1027030,"pu":1027024,"b":[["60000.10","1.250"],["59999.90","0"]],"a":[["60000.20","0.800"]]}',
        '{"stream":"x","data":{"e":"aggTrade","E":1725235200456,"s":"BTCUSDT","a":5933014,"p":"60000.20","q":"0.005","T":1725235200450,"m":true}}',
        "broken",
    ]
    f = spark.createDataFrame([(x, 5) for x in raw], "raw string, ts_recv_ns long")
    r = wire.depth_updates(f, "x").first()
    assert (r["ts_event_ns"], r["final_update_id"], r["prev_final_update_id"], r["bids"][1]["qty"], r["asks"][0]["price"]) == (1725235200123 * MS, 1027030, 1027024, 0.0, 60000.20)
    r = wire.prints(f, "x").first()
    assert (r["ts_event_ns"], r["trade_id"], r["aggressor_sign"], r["qty"]) == (1725235200450 * MS, 5933014, -1, 0.005)
    assert tuple(wire.rejected(f).first()) == (3, 1)
    assert wire.probe_events(f).count() == 2
    body = spark.createDataFrame([('{"lastUpdateId":1027024,"bids":[["60000.00","2.000"]],"asks":[]}', 7, "btcusdt")], "raw string, ts_recv_ns long, symbol string")
    r = wire.rest_snapshots(body, "x").first()
    assert (r["symbol"], r["ts_event_ns"], r["last_update_id"], r["bids"][0]["qty"]) == ("BTCUSDT", 7, 1027024, 2.0)
