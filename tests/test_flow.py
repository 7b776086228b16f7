"""Hand-computed goldens of book-event imbalance and its bars."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from flowspark.functions import ordered, scalars
from flowspark.operators import flow

from .conftest import rows

S = 1_000_000_000
K = ("symbol",)
STATES = "symbol string, epoch long, seq long, ts_event_ns long, bid_px double, bid_qty double, ask_px double, ask_qty double"


def states(spark, bp, bq, ap, aq, ts=None, epoch=None):
    n = len(bp)
    ts, epoch = ts or list(range(n)), epoch or [0] * n
    return spark.createDataFrame([("a", epoch[i], i, ts[i], *map(float, (bp[i], bq[i], ap[i], aq[i]))) for i in range(n)], STATES)


def golden(spark, **more):
    return states(spark, [100, 100, 100.5, 100.5], [10, 12, 5, 5], [101, 101, 101, 100.8], [8, 8, 6, 4], **more)


def test_events(spark):
    assert rows(flow.events(golden(spark), K).select("seq", "e")) == [(1, 2.0), (2, 7.0), (3, -4.0)]
    bid = states(spark, [9, 9.5, 9, 9], [4, 6, 3, 7], [10] * 4, [1] * 4)
    assert [r[1] for r in rows(flow.events(bid, K).select("seq", "e"))] == [6.0, -6.0, 4.0]
    ask = states(spark, [9] * 4, [1] * 4, [10, 9.8, 10.2, 10.2], [4, 6, 3, 7])
    assert [r[1] for r in rows(flow.events(ask, K).select("seq", "e"))] == [-6.0, 6.0, -4.0]
    assert flow.events(states(spark, [1], [1], [2], [1]), K).count() == 0


def test_event_windows(spark):
    e = flow.events(golden(spark), K)
    assert [r[2] for r in rows(flow.event_windows(e, K, 2).select("window", "n_events", "e"))] == [9.0]
    assert [r[2] for r in rows(flow.event_windows(e, K, 2, partial=True).select("window", "n_events", "e"))] == [9.0, -4.0]
    assert [r[2] for r in rows(flow.event_windows(e, K, 1).select("window", "n_events", "e"))] == [2.0, 7.0, -4.0]
    with pytest.raises(ValueError):
        flow.event_windows(e, K, 0)


def test_time_bars(spark):
    ms = 1_000_000
    t = states(spark, [100, 100, 101, 101], [10, 12, 12, 12], [102, 102, 102, 103], [8] * 4, ts=[0, 500 * ms, 1500 * ms, 2500 * ms])
    got = rows(flow.time_bars(t, K, S), "bar_start_ns")
    e = [r[1] for r in rows(flow.events(t, K).select("seq", "e"))]
    assert [r[1] for r in got] == [0, S, 2 * S]
    assert [r[2] for r in got] == e
    assert [r[3] for r in got] == [101.0, 101.5, 102.0]
    assert got[0][4] is None and got[-1][5] is None
    assert [r[7] for r in got] == [True] * 3


def test_bar_of_two_epochs_is_not_valid(spark):
    ms = 1_000_000
    t = states(spark, [1, 1, 1], [1, 1, 1], [2, 2, 2], [1, 1, 1], ts=[0, 300 * ms, 600 * ms], epoch=[0, 0, 1])
    (bar,) = rows(flow.time_bars(t, K, S))
    assert bar[-1] is False and bar[-2] == 2


def test_empty_bars_between_epochs(spark):
    ts = [0, 0, S // 2, 10 * S, 10 * S + S // 2]
    t = states(spark, [1] * 5, [1] * 5, [2] * 5, [1] * 5, ts=ts, epoch=[0, 0, 0, 1, 1])
    got = rows(flow.time_bars(t, K, S), "bar_start_ns")
    assert [r[6] for r in got] == [2, *[0] * 9, 2]
    assert [r[7] for r in got] == [True, *[False] * 9, True]


def test_rolling(spark):
    t = states(spark, [100] * 3, [10, 12, 12], [101] * 3, [8] * 3, ts=[0, 100, S + 200])
    assert [r[1] for r in rows(flow.rolling(flow.events(t, K), K, S).select("seq", "rolling"))] == [2.0, 0.0]


def test_levels(spark):
    one = golden(spark)
    many = one.select("symbol", "epoch", "seq", "ts_event_ns", *(F.array(F.col(c), F.when(F.col("seq") != 2, F.col(c) + d)).alias(c) for c, d in (("bid_px", -1), ("bid_qty", 0), ("ask_px", 1), ("ask_qty", 0))))
    got = rows(flow.events(many, K, 2).select("seq", "e"))
    assert [r[1][0] for r in got] == [2.0, 7.0, -4.0]
    assert [r[1][1] for r in got] == [2.0, None, None]
    assert flow.level_weights(3, "inverse") == [1, 1 / 2, 1 / 3] and flow.level_weights(2) == [1, 1]
    with pytest.raises(ValueError):
        flow.level_weights(2, "none")
    bars = rows(flow.time_bars(many, K, S, levels=2), "bar_start_ns")
    assert [r[2] for r in bars] == [r[2] for r in rows(flow.time_bars(one, K, S), "bar_start_ns")]


def test_chunks_do_not_show(spark):
    """Results do not depend on where a sequence is cut."""
    df = spark.createDataFrame([("ab"[i % 2], i, float(i * i % 7)) for i in range(60)], "k string, i long, v double")
    want = None
    for size in (1, 7, 1000):
        o = ordered.Order(("k",), ("i",), scalars.floor_div("i", size))
        got = ordered.previous(ordered.running_sum(df, o, s=F.col("v")), o, ["v"])
        got = rows(got.select("k", "i", "s", "prev.v"), "k", "i")
        want = want or got
        assert got == want
    dense = df.where("k = 'a'").withColumn("n", scalars.floor_div("i", 2))
    a = [rows(ordered.rolling_by_index(dense, ("k",), "n", 4, F.col("v"), "r", chunk=c).select("n", "r")) for c in (4, 5, 1000)]
    assert a[0] == a[1] == a[2]
    assert a[0][0][1] == 0.0 and len(a[0]) == 30


def test_scalars(spark):
    df = spark.createDataFrame([(-7, 1788379892526000001, 2.5)], "a long, b long, c double")
    r = df.select(
        scalars.floor_div("a", 2), scalars.floor_div("b", 7), scalars.ticks("c", 1.0), scalars.utc_date(F.lit(1725235200000000000)), scalars.order_id(F.lit(0.1), 1.0),
        scalars.local_ts(F.lit(5), F.lit(5)), scalars.clock_offset_ns(F.lit(900), F.lit(1034), F.lit(1100)), scalars.reconnect_backoff(F.lit(10)), scalars.decimals(F.lit("0.00001000")), scalars.decimals(F.lit("1")),
        F.round(scalars.normal_cdf(F.lit(1.0)), 6), F.round(scalars.normal_cdf_exact(F.lit(-1.0)), 6), F.date_format(scalars.ns_to_timestamp(F.lit(1725235200000001999)), "yyyy-MM-dd HH:mm:ss.SSSSSS"),
    ).first()
    assert tuple(r) == (-4, 255482841789428571, 2, "2024-09-02", 1, 6, -34, 30.0, 5, 0, 0.841345, 0.158655, "2024-09-02 00:00:00.000001")
