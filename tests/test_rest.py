"""Parts that no registered query reaches."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from flowspark.functions import scalars as S
from flowspark.operators import convert, latency, quality
from flowspark.sources import tape, wire

from .conftest import SF, rows
from .test_replay import stored


def test_parts_and_streamed_sink(spark, tmp_path):
    root = stored(spark, str(tmp_path / "t"))
    files = tape.part_files(spark, root, "trades", symbol="A")
    assert files == sorted(files) and len(files) == 1 and "symbol=A" in files[0]
    assert tape.part_files(spark, root, "trades", symbol="B") == []
    source = str(tmp_path / "in")
    tape.scan(spark, root, "trades").coalesce(1).write.json(source)
    stream = spark.readStream.schema(tape.SCHEMAS["trades"]).json(source)
    tape.write_stream(stream, str(tmp_path / "u"), "trades", str(tmp_path / "c")).awaitTermination()
    assert rows(tape.scan(spark, str(tmp_path / "u"), "trades")) == rows(tape.scan(spark, root, "trades"))
    ids = [r[0] for r in tape.scan(spark, root, "deltas", row_id=True).select("row_id").collect()]
    assert len(set(ids)) == len(ids) == 4


def test_exchange_info(spark):
    filters = [{"filterType": "PRICE_FILTER", "tickSize": "0.10", "minPrice": "1", "maxPrice": "9"}, {"filterType": "LOT_SIZE", "stepSize": "0.001", "minQty": "0.001", "maxQty": "5"}, {"filterType": "MIN_NOTIONAL", "notional": "7"}]
    body = json.dumps({"symbols": [{"symbol": "AB", "baseAsset": "A", "quoteAsset": "B", "filters": filters}]})
    got = wire.instruments(spark.createDataFrame([(body,)], "raw string"), "x").first()
    assert tuple(got) == ("x", "AB", "A", "B", "0.10", "0.001", "1", "9", "0.001", "5", "7")
    assert wire.stream_urls("wss://h", "AB") == {"combined": "wss://h/stream?streams=ab@aggTrade/ab@depth@100ms", "depth": "wss://h/ws/ab@depth@100ms", "trade": "wss://h/ws/ab@aggTrade"}


def test_trade_frames_of_both_kinds(spark):
    frame = lambda e, n: json.dumps({"e": e, "E": 5, "T": 4, "s": "ab", n: 7, "p": "1.5", "q": "2", "m": False})
    df = spark.createDataFrame([(frame("aggTrade", "a"), 9), (frame("trade", "t"), 9), ("{", 9), (None, 9)], "raw string, ts_recv_ns long")
    for event in ("aggTrade", "trade"):
        assert rows(wire.prints(df, "x", event)) == [("x", "AB", 4_000_000, 9, 7, 1.5, 2.0, 1)]
    assert rows(wire.rejected(df)) == [(4, 2)]
    assert rows(wire.probe_events(df).select("kind", "ts_exchange_e_ns", "ts_exchange_t_ns")) == [("trade", 5_000_000, 4_000_000)] * 2


def test_orders_and_fills(spark):
    orders = spark.createDataFrame([(1, "limit", 1.0, 5.0), (2, "limit", 1.0, None), (3, "market", 1.0, None), (4, "market", 0.0, None)], "id int, type string, qty double, price double")
    assert [r["valid"] for r in convert.checked_orders(orders).orderBy("id").collect()] == [True, False, True, False]
    fills = spark.createDataFrame([(7, 2, 1, 5.0), (7, 1, 2, 6.0), (8, 3, 3, 7.0)], "order_id long, ts long, fill_id long, price double")
    assert rows(convert.harvest(fills)) == [(7, 1, 2, 6.0), (8, 3, 3, 7.0)]
    held = spark.createDataFrame([(2.0, 10.0, 12.5)], "qty double, avg_px double, mark double")
    assert held.select(convert.unrealized("mark")).first()[0] == 5.0
    best = spark.createDataFrame([(99.5, 100.0)], "b double, a double")
    assert tuple(best.select(convert.crossing_quotes("b", "a", 0.5).alias("q")).first()["q"]) == (200, 199)


def test_counters(spark):
    frames = spark.createDataFrame([("a", 1, 10, 9), ("a", 2, 11, 10), ("a", 3, 13, 12), ("b", 1, 5, 4)], "symbol string, at long, final_update_id long, prev_final_update_id long")
    assert rows(quality.sequence_gaps(frames, ("symbol",), "at")) == [("a", 3, 1), ("b", 1, 0)]
    signs = spark.createDataFrame([(1,), (-1,), (0,)], "s int").select(S.side_of_sign("s").alias("side"))
    assert [r[0] for r in signs.collect()] == ["bid", "ask", None]
    assert spark.range(1).select(S.rtt_ns(F.lit(3), F.lit(9))).first()[0] == 6
    decisions = spark.createDataFrame([("a", d, n) for d, n in (("BUFFER", 0), ("SNAPSHOT", 0), ("APPLY", 1), ("RESYNC", 1), ("SNAPSHOT", 2), ("DROP_STALE", 2))], "symbol string, decision string, n_dropped long")
    trades = spark.createDataFrame([("a", 0, 2_400_000), ("a", 0, 7_900_000)], "symbol string, ts_event_ns long, ts_recv_ns long")
    got = latency.feed_stats(decisions, trades, ("symbol",)).first().asDict()
    assert (got["gaps"], got["resyncs"], got["snapshots_applied"], got["deltas_applied"], got["stale"], got["held"], got["dropped"], got["trades"], got["least"], got["most"]) == (1, 1, 2, 1, 1, 1, 2, 2, 2_400_000, 7_900_000)
    gaps = spark.createDataFrame([(1,), (5,), (9,)], "g long")
    assert gaps.agg(latency.n_gaps_over("g", 4)).first()[0] == 2
    empty = latency.offset_summary(spark.createDataFrame([], "local_before_ns long, server_time_ns long, local_after_ns long")).first()
    assert empty["n"] == 0 and empty["mean_ns"] is None


def test_percentiles_are_exact(spark):
    """Small groups, ties, and groups larger than the sketch."""
    import random

    import numpy as np

    rng = random.Random(3)
    data = {"one": [5], "two": [1, 9], "five": [3, 1, 4, 1, 5], "ties": [7] * 3000 + [8] * 20_000 + [9], "many": [rng.randrange(10**9) for _ in range(40_000)]}
    df = spark.createDataFrame([(k, v) for k, x in data.items() for v in x] + [("none", None), ("five", None)], "k string, v long")
    got = {r["k"]: r for r in quality.distribution(df, ("k",), "v").collect()}
    assert set(got) == set(data)
    for k, x in data.items():
        want = np.percentile(np.array(x, float), [50, 90, 99, 99.9])
        assert np.allclose([got[k][c] for c in quality.PERCENTS], want, rtol=1e-12), k
        assert (got[k]["n"], got[k]["least"], got[k]["most"]) == (len(x), min(x), max(x))


def test_rows_of_a_distribution_stay_where_they_lie(spark):
    """However small the tables that Spark would broadcast by itself, rows meet their brackets without a shuffle by key."""
    df = spark.range(40_000).selectExpr("id % 2 AS k", "id % 977 AS v")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = quality.distribution(df, ("k",), "v")
        assert out._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin") == 2
        got = {r["k"]: (r["n"], r["least"], r["p50"], r["most"]) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for k in (0, 1):
        own = sorted(i % 977 for i in range(40_000) if i % 2 == k)
        assert got[k] == (20_000, own[0], (own[9999] + own[10_000]) / 2, own[-1])


def test_headers_of_derived_deltas_are_from_orders_alone(spark):
    from flowspark.plans import views

    heads, whole = views.delta_headers(spark, SF), views.deltas(spark, SF)
    assert not any("lineitem" in f for f in heads.inputFiles())
    assert rows(heads) == rows(whole.select(*heads.columns))
