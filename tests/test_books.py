"""Sweeps over deep books, and books at many times and ids, against plain replays."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from flowspark.operators import book, lookup

K = ("symbol",)
LV = "array<struct<price:double,qty:double>>"
MOVES = "symbol string, group long, seq long, pos int, side string, price double, qty double"
SNAPS = f"symbol string, last_update_id long, ts_event_ns long, bids {LV}, asks {LV}"
DELTAS = f"symbol string, first_update_id long, final_update_id long, prev_final_update_id long, ts_event_ns long, bids {LV}, asks {LV}"


@pytest.mark.parametrize("m", [1, 3, None])
@pytest.mark.parametrize("chunk", [1, 7, 4096])
def test_sweep_is_replay(spark, m, chunk):
    """Groups that start empty, steps without marks, marks without changes, repeated prices in a step."""
    rng = random.Random(chunk)
    moves, marks, want = [], [], []
    for group in range(3):
        state = {"bid": {}, "ask": {}}
        for seq in range(group * 100, group * 100 + 60):
            for pos in range(rng.randint(0, 4)):
                side, price, qty = rng.choice(["bid", "ask"]), float(rng.randint(1, 9)), float(rng.choice([0, 0, 1, 2]))
                moves.append(("a", group, seq, pos, side, price, qty))
                state[side].pop(price, None)
                if qty:
                    state[side][price] = qty
            if rng.random() < 0.3:
                marks.append(("a", group, seq))
                want.append((group, seq, sorted(state["bid"].items(), reverse=True)[:m], sorted(state["ask"].items())[:m]))
    rng.shuffle(moves)
    got = book.swept(spark.createDataFrame(moves, MOVES), spark.createDataFrame(marks, "symbol string, group long, seq long"), K, m, chunk).collect()
    assert sorted((r["group"], r["seq"], [tuple(x) for x in r["bids"]], [tuple(x) for x in r["asks"]]) for r in got) == want


def test_a_deep_book_costs_its_changes(spark):
    """4,000 live levels and 20,000 states: what is spread over chunks is levels, and one symbol is many tasks."""
    n, depth = 20_000, 4_000
    moves = spark.range(n + depth).select(
        F.lit("a").alias("symbol"), F.lit(0).cast("long").alias("group"), F.greatest(F.lit(0), F.col("id") - depth).alias("seq"), F.col("id").cast("int").alias("pos"), F.lit("bid").alias("side"),
        (F.col("id") % depth).cast("double").alias("price"), (F.lit(1.0) + F.col("id") % 7).alias("qty"))
    at = spark.range(n).select(F.lit("a").alias("symbol"), F.lit(0).cast("long").alias("group"), F.col("id").alias("seq"))
    marked = at.select("symbol", "group", (F.col("seq") - F.col("seq") % 1000).alias("s")).select("symbol", "group", F.expr("s div 1000").alias("__c")).distinct()
    assert book.seeds(moves, marked, K, 1000).count() == 19 * depth
    top = book.best_at(moves, at, K, 1000)
    assert top.count() == n and top.where((F.col("bid_px") == depth - 1) & F.col("ask_px").isNull()).count() == n
    # The best price changes its quantity once in `depth` states.
    assert top.select("bid_qty").distinct().count() > 1


def tape(rng):
    """Snapshots and deltas with ties in time, breaks, ids over snapshots, repeated ids."""
    levels = lambda n: [{"price": float(rng.randint(1, 6)), "qty": float(rng.choice([0, 1, 2, 3]))} for _ in range(n)]
    snaps, deltas = [], []
    for symbol in "ab":
        uid = 10
        for ts in range(0, 200, 3):
            first, prev, uid = uid + 1, uid - (rng.random() < 0.1), uid + rng.randint(1, 4)
            deltas.append((symbol, first, uid, prev, ts, levels(3), levels(3)))
            if rng.random() < 0.12:
                distinct = lambda: [{"price": p, "qty": 2.0} for p in rng.sample([1.0, 2.0, 3.0, 4.0, 5.0], 3)]
                snaps.append((symbol, uid - rng.randint(0, 1), ts + rng.randint(0, 1), distinct(), distinct()))
    return snaps, deltas


def book_of(snap, used):
    live = {}
    for side, i in (("bid", 0), ("ask", 1)):
        for levels in [(snap[3], snap[4])[i], *((d[5], d[6])[i] for d in used)]:
            for x in levels:
                live[side, x["price"]] = x["qty"]
    return {k: q for k, q in live.items() if q > 0}


def breaks(snap, used):
    at, n = snap[1], 0
    for i, (_, first, final, prev, *_) in enumerate(used):
        n += prev != at and not (i == 0 and first <= at <= final)
        at = final
    return n


def compared(levels, status, columns):
    books = {}
    for r in levels.collect():
        books.setdefault((r["symbol"], r["query"]), {})[r["side"], r["price"]] = r["qty"]
    return {(r["symbol"], r["query"]): (*(r[c] for c in columns), books.get((r["symbol"], r["query"]), {})) for r in status.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_many_times(spark, monkeypatch, seed):
    monkeypatch.setattr(lookup, "CHUNK_NS", 17)
    snaps, deltas = tape(random.Random(seed))
    queries = [(s, ts, ts - 2) for s in "ab" for ts in range(205)] + [("c", 1, 50)]
    want = {}
    for s, q, ts in queries:
        known = [x for x in snaps if x[0] == s and x[2] <= ts]
        if known:
            snap = max(known, key=lambda x: (x[2], x[1]))
            used = sorted((d for d in deltas if d[0] == s and snap[2] < d[4] <= ts), key=lambda d: (d[4], d[2]))
            want[s, q] = (snap[1], breaks(snap, used), book_of(snap, used))
    got = lookup.books_at_times(spark.createDataFrame(snaps, SNAPS), spark.createDataFrame(deltas, DELTAS), K, spark.createDataFrame(queries, "symbol string, query long, ts_event_ns long"))
    assert compared(*got, ["snapshot_id", "n_gaps"]) == want


@pytest.mark.parametrize("seed", [3, 4])
def test_many_ids(spark, monkeypatch, seed):
    monkeypatch.setattr(lookup, "CHUNK_IDS", 13)
    snaps, deltas = tape(random.Random(seed))
    snaps = list({(x[0], x[1]): x for x in snaps}.values())
    top = max(d[2] for d in deltas)
    queries = [(s, i, i) for s in "ab" for i in range(5, top + 5)]
    want = {}
    for s, q, rest in queries:
        known = [x for x in snaps if x[0] == s and x[1] <= rest]
        if known:
            snap = max(known, key=lambda x: (x[1], x[2]))
            after = sorted((d for d in deltas if d[0] == s and d[2] > snap[1]), key=lambda d: d[2])
            stop = next((d[2] for d in after if d[2] >= rest), None)
            used = [d for d in after if stop is not None and d[2] <= stop and snap[1] != rest]
            want[s, q] = (snap[1], breaks(snap, used), rest if snap[1] == rest else stop, len(used), book_of(snap, used))
    got = lookup.books_at_ids(spark.createDataFrame(snaps, SNAPS), spark.createDataFrame(deltas, DELTAS), K, spark.createDataFrame(queries, "symbol string, query long, rest_id long"))
    assert compared(*got, ["snapshot_id", "n_gaps", "aligned_u", "n_batches"]) == want
