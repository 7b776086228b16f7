"""Replay order on messy tapes, stored tapes, and what keeps a hot symbol from being one task."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from flowspark.functions import ordered
from flowspark.operators import audit, capture, chain, convert, flow, lookup, quality, validate
from flowspark.plans import views
from flowspark.sources import tape

from .conftest import SF, rows

HEAD = "symbol string, uid long, first_id long, prev_id long, is_snapshot boolean, ts_event_ns long, ts_recv_ns long, row_id long"


def holds(entries):
    """What must hold of one symbol's headers in replay order, each (header, fate): ids never fall, and a
    header is on the chain exactly if it continues the last one that was."""
    on = [i for i, (_, fate) in enumerate(entries) if fate != "off_chain"]
    kept = [i for i, (_, fate) in enumerate(entries) if fate == "kept"]
    for i, ((_, uid, first, prev, is_snapshot, *_), fate) in enumerate(entries):
        at = max((j for j in on if j < i), default=None)
        reached = None if at is None else entries[at][0][1]
        opened = any(entries[j][0][4] for j in kept[: sum(j < i for j in kept)][-1:])
        if is_snapshot:
            assert fate == ("periodic" if uid == reached else "kept")
        else:
            continues = reached is not None and (prev == reached or (opened and first <= reached <= uid))
            assert fate == ("kept" if continues else "off_chain")
        if i + 1 < len(entries):
            (after, _), own = entries[i + 1], entries[i][0]
            assert after[1] >= uid
            if after[1] == uid:
                # A snapshot changes places with the delta right before it, if that one is off the chain.
                swapped = i + 2 < len(entries) and not entries[i + 2][0][4] and entries[i + 2][0][1] == uid
                assert fate != "off_chain" or is_snapshot or not after[4] or swapped
                assert (own[4], own[7]) < (after[4], after[7]) or (own[4] and not after[4])


def messy(rng, symbol, n):
    heads, uid = [], 100
    for i in range(n):
        first, prev = uid + 1, uid
        uid += rng.choice([1, 1, 2, 5, 40])
        kind = rng.random()
        if kind < 0.1:
            prev -= 1
        elif kind < 0.15:
            first -= 3
        heads.append((symbol, uid, first, prev, False, i * 10, i * 10 + rng.randrange(3), i))
        if rng.random() < 0.1:
            heads.append((symbol, uid, first, prev - rng.randrange(2), False, i * 10, i * 10, 10_000 + i))
        if rng.random() < 0.15:
            for k in range(rng.randrange(1, 3)):
                heads.append((symbol, uid - rng.choice([0, 0, 0, 1, 2]), 0, None, True, i * 10, i * 10, 20_000 + 10 * i + k))
    return [h for h in heads if rng.random() > 0.03]


@pytest.mark.parametrize("chunk", [7, 1 << 20])
def test_selection_holds(spark, monkeypatch, chunk):
    monkeypatch.setattr(chain, "CHUNK", chunk)
    rng = random.Random(chunk)
    every = {s: messy(rng, s, 150) for s in "abcdef"}
    df = spark.createDataFrame([h for x in every.values() for h in x], HEAD)
    got = {}
    for r in chain.select(df, ("symbol",)).collect():
        got.setdefault(r["symbol"], []).append((r["seq"], r["row_id"], r["fate"]))
    fates = set()
    for s, heads in every.items():
        by_row = {h[7]: h for h in heads}
        found = sorted(got[s])
        assert [x[0] for x in found] == list(range(len(heads))) and {x[1] for x in found} == set(by_row)
        holds([(by_row[row], fate) for _, row, fate in found])
        fates |= {x[2] for x in found}
    assert fates == {"kept", "periodic", "off_chain"}


def test_chunked_extremes(spark):
    rng = random.Random(1)
    data = [("ab"[i % 2], i, None if rng.random() < 0.3 else rng.randrange(1000)) for i in range(400)]
    df = spark.createDataFrame(data, "k string, i long, v long")
    order = ordered.Order(("k",), ("i",), F.expr("i div 37"))
    out = ordered.following_min(ordered.running_max(df, order, up=F.col("v")), order, down=F.col("v"))
    for k in "ab":
        own = [(i, v) for s, i, v in data if s == k]
        for _, i, v, up, down in rows(out.where(F.col("k") == k).select("k", "i", "v", "up", "down"), "i"):
            assert up == max((x for j, x in own if j <= i and x is not None), default=None)
            assert down == min((x for j, x in own if j >= i and x is not None), default=None)


def test_no_frame_up_to_the_end(spark):
    """Spark works such a frame out anew for each row, so a chunk would cost its square."""
    from flowspark.operators import flow

    heads = spark.range(10).select(F.lit("a").alias("symbol"), F.col("id").alias("seq"), F.col("id").alias("ts_event_ns"), F.col("id").alias("ts_recv_ns"))
    states = heads.select("symbol", "seq", "ts_event_ns", F.lit(0).cast("long").alias("epoch"), *(F.lit(x).alias(c) for c, x in (("bid_px", 1.0), ("bid_qty", 1.0), ("ask_px", 2.0), ("ask_qty", 1.0))))
    for out in (chain.restamp(heads, ("symbol",)), flow.time_bars(states, ("symbol",), 2)):
        assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()


def test_a_hot_symbol_is_many_tasks(spark, monkeypatch):
    """One symbol holds nine tenths of all headers; no task gets more than a few chunks of it."""
    monkeypatch.setattr(chain, "CHUNK", 500)
    n = 20_000
    i = F.col("id")
    hot = F.when(i % 10 != 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), i % 7))
    df = spark.range(n).select(hot.alias("symbol"), (i * 2 + 1).alias("uid"), (i * 2).alias("first_id"), (i * 2 - 1).alias("prev_id"), F.lit(False).alias("is_snapshot"), i.alias("ts_event_ns"), i.alias("ts_recv_ns"), i.alias("row_id"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        for out in (chain.select(df, ("symbol",)), chain.restamp(df, ("symbol",), "uid"), quality.inter_arrival(df.withColumn("t", F.col("uid") * 100_000_000_000), ("symbol",), "t", "row_id")):
            at = [r["at"] for r in out.withColumn("at", F.spark_partition_id()).collect()]
            assert len(at) > n * 0.9 and max(map(at.count, set(at))) < 0.2 * n
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def levels(*x):
    return [{"price": float(p), "qty": float(q)} for p, q in x]


def stored(spark, root):
    snap = lambda u, t, b, a: {"exchange": "x", "symbol": "A", "ts_event_ns": t, "ts_recv_ns": t + 5, "last_update_id": u, "bids": levels(*b), "asks": levels(*a)}
    delta = lambda f, u, p, t, b=(), a=(): {"exchange": "x", "symbol": "A", "ts_event_ns": t, "ts_recv_ns": t + 5, "first_update_id": f, "final_update_id": u, "prev_final_update_id": p, "bids": levels(*b), "asks": levels(*a)}
    tape.write(tape.events_frame(spark, "snapshots", [snap(10, 1000, [(99, 2), (98, 1)], [(101, 3)]), snap(30, 5000, [(98, 4)], [(100, 1)]), snap(12, 2500, [(99, 7)], [(101, 3)])]), root, "snapshots")
    tape.write(tape.events_frame(spark, "deltas", [delta(9, 11, 8, 2000, [(99, 5)]), delta(12, 12, 11, 2400, [], [(101, 0), (102, 2)]), delta(20, 22, 19, 3000, [(99, 1)]), delta(31, 31, 30, 6000, [(98, 0), (97, 3)])]), root, "deltas")
    tape.write(tape.events_frame(spark, "trades", [{"exchange": "x", "symbol": "A", "ts_event_ns": 10 * i, "ts_recv_ns": 10 * i, "trade_id": i, "price": 100.0, "qty": float(i % 3), "aggressor_sign": 1 if i % 2 else -1} for i in range(8)]), root, "trades")
    return root


def test_tape_entry_points(spark, tmp_path):
    root = stored(spark, str(tmp_path / "t"))
    states = rows(capture.book_states(spark, root).select("seq", "epoch", "new_epoch", "bid_px", "bid_qty", "ask_px", "ask_qty"), "seq")
    assert [x[1:] for x in states] == [
        (0, True, 99.0, 2.0, 101.0, 3.0), (0, False, 99.0, 5.0, 101.0, 3.0), (0, False, 99.0, 5.0, 102.0, 2.0), (1, True, 98.0, 4.0, 100.0, 1.0), (1, False, 97.0, 3.0, 100.0, 1.0)]
    assert [r[0] for r in capture.ofi_events(spark, root).orderBy("seq").select("e").collect()] == [3.0, 0.0 + 3.0, -4.0]
    deep = capture.mlofi_events(spark, root, 2).orderBy("seq").collect()
    assert [r["e"][0] for r in deep] == [3.0, 3.0, -4.0] and deep[0]["e"][1] is None
    assert [r["cvd"] for r in capture.cvd(spark, root).orderBy("trade_id").collect()] == [0.0, 1.0, -1.0, -1.0, -2.0, 0.0, 0.0, 1.0]
    assert capture.vpin(spark, root, 2.0, 2).count() == 2
    ops, prints = capture.ops(spark, root, 1.0)
    assert ops.where("action = 'clear'").count() == 2 and prints.count() == 5
    stats = capture.stats(spark, root).first()
    assert (stats["n_snapshots"], stats["n_deltas"], stats["n_trades"], stats["n_event_gaps"]) == (3, 4, 8, 0) and min(stats[f"bytes_{k}"] for k in tape.SCHEMAS) > 100
    assert capture.gaps(spark, root, 900).count() == 2
    assert capture.check(spark, root).first()["n_off_grid"] is None
    tape.write_instrument(spark, root, {"exchange": "x", "symbol": "A", "tick_size": "2.0"})
    checked = capture.check(spark, root).first()
    assert checked["n_off_grid"] == 8 and not checked["ok"]
    assert [(r["ok"], r["crossed"]) for r in capture.mid_snapshot_check(spark, root, "x", "A").collect()] == [(True, False)]
    assert capture.mid_snapshot_check(spark, root, "x", "none").count() == 0
    live = spark.createDataFrame([("x", "A", "bid", 97.0, 3.0), ("x", "A", "ask", 100.0, 1.0)], "exchange string, symbol string, side string, price double, qty double")
    assert capture.end_check(spark, root, live, 9000).first()["ok"]
    assert not capture.end_check(spark, root, live.withColumn("qty", F.col("qty") + 1), 9000).first()["ok"]


def test_probe_sidecar(spark, tmp_path):
    root = stored(spark, str(tmp_path / "t"))
    path = str(tmp_path / "probes.jsonl")
    book = lambda n, b, a: {"ts_local_ns": n, "last_update_id": n, "symbol": "A", "n_levels": 2, "bids": levels(*b), "asks": levels(*a)}
    LV = "array<struct<price: double, qty: double>>"
    tape.write_probes(spark.createDataFrame([book(11, [(99, 5), (98, 1)], [(101, 3)]), book(12, [(99, 1)], [(103, 3)]), book(25, [(1, 1)], [(2, 1)])], f"ts_local_ns long, last_update_id long, symbol string, n_levels int, bids {LV}, asks {LV}"), path)
    got = capture.audit_probes(spark, root, path, "x", 2)
    assert {r["rest_id"]: r["verdict"] for r in got.collect()} == {11: "ok", 12: "breach", 25: "stale"}
    assert capture.exit_code(got) == 1 and capture.exit_code(got.where("rest_id <> 12")) == 0
    tape.write_clock_samples(spark.createDataFrame([("start", 1, 2, 3)], "phase string, local_before_ns long, server_time_ns long, local_after_ns long"), str(tmp_path / "clock"))
    assert rows(tape.clock_samples(spark, str(tmp_path / "clock"))) == [("start", 1, 2, 3)]


def test_sink_guards(spark, tmp_path):
    one = tape.events_frame(spark, "trades", [{"exchange": "x", "symbol": "A", "ts_event_ns": 1, "ts_recv_ns": 1, "trade_id": 1, "price": 1.0, "qty": 1.0, "aggressor_sign": 1}])
    with pytest.raises(Exception, match="not of x"):
        tape.write(one, str(tmp_path / "a"), "trades", exchange="y")
    with pytest.raises(tape.LowDisk):
        tape.write(one, str(tmp_path / "b"), "trades", least_free=1 << 62)
    assert tape.scan(spark, str(tmp_path / "b"), "trades").count() == 0
    legacy = tape.resolve_instrument(spark, str(tmp_path), "btcusdt").first()
    assert (str(legacy["tick_size"]).rstrip("0"), legacy["price_precision"]) == ("0.1", 1)
    with pytest.raises(tape.NoInstrument):
        tape.resolve_instrument(spark, str(tmp_path), "ETHUSDT")


def test_pairs_of_bars(spark):
    """A change of mid counts only where both of its bars are valid."""
    bars = spark.createDataFrame([("a", t, float(t), float(10 * t), float(t + 5), t != 3) for t in range(6)], "symbol string, bar_start_ns long, ofi double, delta_mid double, delta_mid_lead1 double, valid boolean")
    got = rows(validate.paired(bars, ("symbol",), ["ofi"]), "spec", "t")
    assert [(s, t, y) for _, s, t, _, y in got] == [("contemporaneous", t, 10.0 * t) for t in (1, 2, 5)] + [("lead1", t, t + 5.0) for t in (0, 1, 4)]


def test_position_turns(spark):
    fills = [(1, 1, 1, 2.0, 10.0, 0.0), (2, 2, 1, 2.0, 20.0, 1.0), (3, 3, -1, 5.0, 30.0, 0.0), (4, 4, 1, 1.0, 25.0, None)]
    df = spark.createDataFrame([("m", *f) for f in fills], "k string, ts long, fill_id long, sign int, qty double, price double, fee double")
    assert rows(convert.positions(df, ("k",))) == [("m", 0.0, 0.0, -1.0 + 4 * 15.0 + 5.0)]
    assert rows(convert.positions(df.where("ts < 4"), ("k",))) == [("m", -1.0, 30.0, 59.0)]
    assert convert.positions(df.limit(0), ("k",)).count() == 0


def test_position_in_chunks(spark):
    """However a key is cut, its position is that of one fold; null keys are a key."""
    rng = random.Random(4)
    fills, want = [], {}
    for key, n in (("hot", 900), (None, 40), ("one", 1)):
        qty = avg = gain = 0.0
        for i in range(n):
            sign, q, price, fee = rng.choice((1, -1)), float(rng.randint(1, 9)), 90.0 + rng.randint(0, 40) / 2, 0.25
            fills.append((key, i // 3, i, sign, q, price, fee))
            left = qty + sign * q
            gain -= fee
            if qty * sign >= 0:
                avg = (abs(qty) * avg + q * price) / abs(left)
            else:
                gain += min(abs(qty), q) * (price - avg) * (1 if qty > 0 else -1)
                avg = 0.0 if not left else avg if left * qty > 0 else price
            qty = left
        want[key] = (qty, avg, gain)
    rng.shuffle(fills)
    df = spark.createDataFrame(fills, "k string, ts long, fill_id long, sign int, qty double, price double, fee double")
    for chunks in (1, 3, 16):
        got = {r["k"]: (r["qty"], r["avg_px"], r["realized"]) for r in convert.positions(df, ("k",), chunks).collect()}
        assert got.keys() == want.keys()
        for k, w in want.items():
            assert got[k] == pytest.approx(w, rel=1e-9, abs=1e-7)


def _told(spark, df):
    """df, and an accumulator of how many of its rows were worked out."""
    n = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            n.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), n


def _looked_up(s, d):
    asked = s.select("symbol", F.col("row_id").alias("query"), (F.col("last_update_id") + 35).alias("rest_id"))
    levels, status = lookup.books_at_ids(s, d, ("symbol",), asked)
    return status.join(levels, ["symbol", "query"])


def _probed(s, d):
    probes = s.select("symbol", F.col("row_id").alias("probe"), (F.col("last_update_id") - 3).alias("rest_id"), "bids", "asks")
    return audit.audit_probes(s, d, probes, ("symbol",), 20)


@pytest.mark.parametrize("times, run", [
    (1, lambda s, d: chain.select(chain.headers(s, d, ("symbol",)), ("symbol",))), (1, lambda s, d: chain.kept_headers(s, d, ("symbol",))),
    (2, lambda s, d: convert.replay_feed(s, d, views.trades(s.sparkSession, SF), ("symbol",))[1]), (1, _probed), (1, _looked_up)])
def test_deltas_are_worked_out_once(spark, times, run):
    """Once for ids, once for levels: every step of a replay, an audit or a lookup that took them anew would
    join and order the whole tape again."""
    d, n = _told(spark, views.deltas(spark, SF))
    run(views.snapshots(spark, SF), d).write.format("noop").mode("overwrite").save()
    assert n.value == times * views.deltas(spark, SF).count()


def test_books_are_walked_once(spark, monkeypatch):
    """States are read twice for the imbalance, and once for where they begin."""
    s, d = views.snapshots(spark, SF), views.deltas(spark, SF)
    kept, moves = chain.replay(s, d, ("symbol",))
    told = []

    def swept(*a, f=chain.swept):
        out, n = _told(spark, f(*a))
        told.append(n)
        return out

    monkeypatch.setattr(chain, "swept", swept)
    flow.events(chain.level_states(kept, moves, ("symbol",), 3), ("symbol",), 3).write.format("noop").mode("overwrite").save()
    assert [n.value for n in told] == [kept.count()]
