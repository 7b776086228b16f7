"""Goldens of cumulative delta, equal-volume buckets and toxicity; random tapes against numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from flowspark.operators import volume

from .conftest import rows

S = 1_000_000_000
K = ("symbol",)


def trades(spark, price, qty, sign, ts=None):
    n = len(qty)
    ts = ts or list(range(n))
    return spark.createDataFrame([("a", ts[i], i, float(price[i]), float(qty[i]), sign[i]) for i in range(n)], "symbol string, ts_event_ns long, trade_id long, price double, qty double, aggressor_sign byte")


def test_cvd(spark):
    got = rows(volume.cvd(trades(spark, [1] * 3, [1, 2, 3], [1, -1, 1]), K).select("trade_id", "delta", "cvd"))
    assert got == [(0, 1.0, 1.0), (1, -2.0, -1.0), (2, 3.0, 2.0)]
    with pytest.raises(Exception, match="aggressor_sign"):
        volume.cvd(trades(spark, [1], [1], [0]), K).collect()


def test_cvd_bars(spark):
    t = trades(spark, [1] * 3, [1, 2, 3], [1, -1, 1], ts=[0, S + 5, 3 * S])
    assert rows(volume.cvd_bars(t, K, S), "bar_start_ns") == [("a", 0, 1.0, 1.0), ("a", S, -2.0, -1.0), ("a", 2 * S, 0.0, -1.0), ("a", 3 * S, 3.0, 2.0)]
    t = trades(spark, [1] * 3, [1, 1, 1], [1, 1, 1], ts=[7 * S, 2 * S, 2 * S + 1])
    assert [(r[1], r[2]) for r in rows(volume.cvd_bars(t, K, 5 * S, 2 * S), "bar_start_ns")] == [(2 * S, 2.0), (7 * S, 1.0)]


CASES = [
    ([1] * 4, [1] * 4, 2, [1, -1, 1, 1], [(1, 1, 1), (2, 0, 1)], 0),
    ([1] * 3, [1] * 3, 2, [1, 1, 1], [(2, 0, 1)], 1),
    ([1, 2], [1.5, 1.5], 2, [1, -1], [(1.5, 0.5, 2)], 1),
    ([5], [5], 2, [-1], [(0, 2, 5), (0, 2, 5)], 1),
    ([10, 11, 12, 13], [1] * 4, 2, [1] * 4, [(2, 0, 11), (2, 0, 13)], 0),
    ([1] * 3, [0.7, 0.1, 0.2], 1, [1] * 3, [(1, 0, 1)], 0),
    ([1, 9, 2], [1, 0, 1], 2, [1, 1, -1], [(1, 1, 2)], 0),
]


@pytest.mark.parametrize(("price", "qty", "size", "sign", "want", "left"), CASES)
def test_buckets(spark, price, qty, size, sign, want, left):
    t = trades(spark, price, qty, sign)
    got = rows(volume.volume_buckets(t, K, size), "bucket")
    assert [(round(r[2], 9), round(r[3], 9), r[4]) for r in got] == [tuple(map(float, w)) for w in want]
    assert rows(volume.remainder(t, K, size))[0][1:] == (len(want), pytest.approx(left, abs=1e-9))


def test_vpin(spark):
    t = trades(spark, [1] * 6, [1] * 6, [1, 1, -1, -1, 1, -1])
    for n, want in ((1, [1, 1, 0]), (2, [1, 0.5]), (3, [2 / 3])):
        assert [r[2] for r in rows(volume.vpin(t, K, 2, n), "bucket")] == pytest.approx(want)
    with pytest.raises(ValueError):
        volume.vpin(t, K, 2, 1, "other")


def test_bulk_classification(spark):
    t = trades(spark, [100, 101, 100], [1, 1, 2], [1] * 3)
    b = volume.bulk_classified(volume.volume_buckets(t, K, 2), volume.first_prices(t, K), K, 2)
    z = 1 / np.std([1, -1], ddof=1)
    phi = lambda x: 0.5 * (1 + math.erf(x / math.sqrt(2)))
    assert [r[2] for r in rows(b, "bucket")] == pytest.approx([2 * phi(z), 2 * phi(-z)], abs=1e-6)
    flat = trades(spark, [5] * 4, [1] * 4, [1] * 4)
    b = volume.bulk_classified(volume.volume_buckets(flat, K, 2), volume.first_prices(flat, K), K, 2)
    assert [r[2] for r in rows(b, "bucket")] == pytest.approx([1, 1], abs=1e-6)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 30), st.sampled_from([-1, 1])), min_size=1, max_size=40), st.integers(2, 40))
def test_random_tapes(spark, tape, size):
    """Interpolated cumulative buys at the borders, as numpy has them."""
    qty, sign = np.array([q for q, _ in tape], float), np.array([s for _, s in tape])
    cum = np.concatenate([[0], qty.cumsum()])
    grid = size * np.arange(0, int(cum[-1] // size) + 1)
    buys = np.diff(np.interp(grid, cum, np.concatenate([[0], (qty * (sign > 0)).cumsum()])))
    got = rows(volume.volume_buckets(trades(spark, [1] * len(qty), qty, sign.tolist()), K, size), "bucket")
    assert [r[2] for r in got] == pytest.approx(buys.tolist(), abs=1e-9)
