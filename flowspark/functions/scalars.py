"""Column functions: integer bars, ticks, sides, times, flags."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NS_PER_MS = 1_000_000
NS_PER_S = 1_000_000_000

#: Fixed values of the simulator feed's event word.
EXCH_EVENT, LOCAL_EVENT, BUY_EVENT, SELL_EVENT = 1 << 31, 1 << 30, 1 << 29, 1 << 28
DEPTH_EVENT, TRADE_EVENT, DEPTH_CLEAR_EVENT, DEPTH_SNAPSHOT_EVENT = 1, 2, 3, 4
KIND_MASK = 0xFF
FLAG_LAST, FLAG_SNAPSHOT = 128, 32


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def floor_div(x: Column | str, w: int | Column) -> Column:
    """Floor division of longs, exact at nanosecond magnitude and for negative x: the rest is
    taken off first, so that SQL's integer `div` has nothing to round."""
    x = col(x)
    w = F.lit(w).cast("long") if isinstance(w, int) else w
    return F.call_function("div", x - F.pmod(x, w), w)


def bar_start(ts: Column | str, width: int, origin: int = 0) -> Column:
    """Start of the bar of `width` that holds ts."""
    ts = col(ts)
    return ts - F.pmod(ts - F.lit(origin), F.lit(width).cast("long"))


def mid(bid: Column | str, ask: Column | str) -> Column:
    return (col(bid) + col(ask)) / 2.0


def spread(bid: Column | str, ask: Column | str) -> Column:
    return col(ask) - col(bid)


def microprice(bid: Column | str, bid_qty: Column | str, ask: Column | str, ask_qty: Column | str) -> Column:
    """Mid weighted by the opposite queue; null where both queues are empty."""
    return F.try_divide(col(ask) * col(bid_qty) + col(bid) * col(ask_qty), col(bid_qty) + col(ask_qty))


def imbalance(bids: Column | str, asks: Column | str, levels: int) -> Column:
    """(sum of bid - sum of ask) / sum over the first `levels` of arrays of struct(price, qty)."""
    total = lambda c: F.aggregate(F.slice(col(c), 1, levels), F.lit(0.0), lambda a, x: a + x["qty"])
    b, a = total(bids), total(asks)
    return F.try_divide(b - a, b + a)


def sign_of_maker_flag(m: Column | str) -> Column:
    """Aggressor sign of a print: a buying maker was hit by a seller."""
    return F.when(col(m), F.lit(-1)).otherwise(F.lit(1)).cast("byte")


def side_of_sign(sign: Column | str) -> Column:
    return F.when(col(sign) > 0, "bid").when(col(sign) < 0, "ask")


def ticks(price: Column | str, tick: float) -> Column:
    """Nearest tick number, halves to even."""
    return F.rint(col(price) / F.lit(tick)).cast("long")


def price_of_ticks(n: Column | str, tick: float) -> Column:
    return F.bround(col(n) * F.lit(tick), 10)


def order_id(price: Column | str, tick: float) -> Column:
    """Price in ticks as an order id, never 0."""
    return F.greatest(F.lit(1).cast("long"), ticks(price, tick))


def ms_to_ns(ms: Column | str) -> Column:
    return col(ms).cast("long") * NS_PER_MS


def ns_to_ms(ns: Column | str) -> Column:
    return floor_div(ns, NS_PER_MS)


def ns_to_timestamp(ns: Column | str) -> Column:
    """UTC timestamp, cut to microseconds."""
    return F.timestamp_micros(floor_div(ns, 1000))


def timestamp_to_ns(ts: Column | str) -> Column:
    return F.unix_micros(col(ts)) * 1000


def utc_date(ns: Column | str) -> Column:
    """yyyy-MM-dd of the UTC day, whatever the session's time zone."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), floor_div(ns, 86_400 * NS_PER_S).cast("int")), "yyyy-MM-dd")


def observed_latency_ns(event: Column | str, recv: Column | str) -> Column:
    return col(recv) - col(event)


def clock_offset_ns(before: Column | str, server: Column | str, after: Column | str) -> Column:
    """Local minus server time at the probe's midpoint."""
    return floor_div(col(before) + col(after), 2) - col(server)


def rtt_ns(before: Column | str, after: Column | str) -> Column:
    return col(after) - col(before)


def reconnect_backoff(attempt: Column | str, base: float = 0.5, cap: float = 30.0) -> Column:
    """Seconds to wait before the given attempt (from 0)."""
    return F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), col(attempt)))


def reconnect_delay(attempt: Column | str, seed: int, base: float = 0.5, cap: float = 30.0) -> Column:
    """The backoff with up to as much again of jitter, never over the cap."""
    return F.least(F.lit(cap), reconnect_backoff(attempt, base, cap) * (F.lit(1.0) + F.rand(seed)))


def decimals(text: Column | str) -> Column:
    """Decimal places of a fixed-point string, trailing zeros aside."""
    return F.length(F.regexp_extract(F.regexp_replace(col(text), r"(\.\d*?)0+$", "$1"), r"\.(\d+)$", 1))


def local_ts(exch: Column | str, recv: Column | str) -> Column:
    """The receive time, moved to just after the exchange time where it is not later."""
    return F.greatest(col(recv), col(exch) + 1)


def event_word(kind: int | Column, is_bid: Column) -> Column:
    kind = F.lit(kind).cast("long") if isinstance(kind, int) else kind.cast("long")
    both = F.lit(EXCH_EVENT | LOCAL_EVENT).cast("long")
    return kind.bitwiseOR(both).bitwiseOR(F.when(is_bid, F.lit(BUY_EVENT)).otherwise(F.lit(SELL_EVENT)).cast("long"))


def event_kind(ev: Column | str) -> Column:
    return col(ev).bitwiseAND(F.lit(KIND_MASK).cast("long"))


def normal_cdf(z: Column | str) -> Column:
    """Phi by Abramowitz & Stegun 7.1.26 (error below 1.5e-7), inside whole-stage codegen."""
    x = F.abs(col(z)) / F.lit(2.0**0.5)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * x)
    poly = t * (F.lit(0.254829592) + t * (F.lit(-0.284496736) + t * (F.lit(1.421413741) + t * (F.lit(-1.453152027) + t * F.lit(1.061405429)))))
    tail = F.lit(0.5) * poly * F.exp(-x * x)
    return F.when(col(z) >= 0, F.lit(1.0) - tail).otherwise(tail)


def normal_cdf_of(z: np.ndarray) -> np.ndarray:
    """The same of an array."""
    x = np.abs(z) / 2.0**0.5
    t = 1.0 / (1.0 + 0.3275911 * x)
    tail = 0.5 * t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-x * x)
    return np.where(z >= 0, 1.0 - tail, tail)


def normal_cdf_exact(z: Column | str) -> Column:
    """Phi by math.erf, Arrow batch by Arrow batch."""
    @F.pandas_udf("double")
    def phi(x: pd.Series) -> pd.Series:
        erf = np.array([math.erf(v) for v in x.to_numpy(float) / math.sqrt(2.0)], float)
        return pd.Series(0.5 * (1.0 + erf))

    return phi(col(z))
