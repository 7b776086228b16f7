"""Book-event imbalance from consecutive states, at one level or many, and its bars.

States are rows of (keys, epoch, seq, ts_event_ns, bid_px, bid_qty, ask_px, ask_qty), the last
four doubles or, for many levels, arrays of doubles. Missing is NULL and gives NULL. No event
spans two epochs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import Order, dense, previous, rolling_by_range, row_index
from ..functions.scalars import bar_start, floor_div, mid

BOOK = ["bid_px", "bid_qty", "ask_px", "ask_qty"]
CHUNK = 100_000


def contribution(bp: Column, bq: Column, ap: Column, aq: Column, bp0: Column, bq0: Column, ap0: Column, aq0: Column) -> Column:
    """Signed queue change between a state and the one before (index 0)."""
    on = lambda condition, qty: condition.cast("double") * qty  # noqa: E731  a null quantity stays null
    return on(bp >= bp0, bq) - on(bp <= bp0, bq0) - on(ap <= ap0, aq) + on(ap >= ap0, aq0)


def state_order(keys: tuple[str, ...]) -> Order:
    return Order(keys, ("seq",), floor_div("seq", CHUNK))


def _paired(states: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """States with `prev`, the state before of the same key whatever its epoch."""
    return previous(states, state_order(keys), ["epoch", *BOOK])


def _level_event(i: Column | None = None) -> Column:
    now = [F.col(c) for c in BOOK]
    before = [F.col(f"prev.{c}") for c in BOOK]
    if i is not None:
        now, before = [F.get(c, i) for c in now], [F.get(c, i) for c in before]
    return contribution(*now, *before)


def _event(levels: int | None) -> Column:
    if levels is None:
        return _level_event()
    return F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda i: _level_event(i))


def events(states: DataFrame, keys: tuple[str, ...], levels: int | None = None) -> DataFrame:
    """keys, epoch, seq, ts_event_ns, e (an array for `levels`): one row per state that follows
    another of its epoch."""
    rows = _paired(states, keys).where("prev is not null and prev.epoch = epoch")
    return rows.select(*keys, "epoch", "seq", "ts_event_ns", _event(levels).alias("e"))


def level_weights(levels: int, scheme: str = "equal") -> list[float]:
    if levels < 1:
        raise ValueError("levels must be >= 1")
    if scheme == "equal":
        return [1.0] * levels
    if scheme == "inverse":
        return [1.0 / m for m in range(1, levels + 1)]
    raise ValueError(f"unknown scheme {scheme!r}")


def weighted(e: Column | str, weights: list[float]) -> Column:
    """Weighted sum of a level array."""
    w = F.array(*(F.lit(float(x)) for x in weights))
    return F.aggregate(F.zip_with(e, w, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)


def event_windows(rows: DataFrame, keys: tuple[str, ...], width: int, value: str = "e", partial: bool = False, levels: int | None = None, weights: list[float] | None = None) -> DataFrame:
    """keys, window, n_events, value: sums over consecutive groups of `width` rows per key. For
    `levels` the value is an array, and so are its sums; with weights these collapse to one number."""
    if width < 1:
        raise ValueError("width must be >= 1")
    if weights is not None and len(weights) != levels:
        raise ValueError("one weight a level")
    indexed = row_index(rows, state_order(keys), "__n").withColumn("window", floor_div("__n", width))
    parts = [F.col(value)] if levels is None else [F.get(value, F.lit(m)) for m in range(levels)]
    out = indexed.groupBy(*keys, "window").agg(F.count("*").alias("n_events"), *(F.sum(p).alias(f"__{m}") for m, p in enumerate(parts)))
    sums = F.array(*(f"__{m}" for m in range(len(parts))))
    total = F.col("__0") if levels is None else sums if weights is None else weighted(sums, weights)
    out = out.select(*keys, "window", "n_events", total.alias(value))
    return out if partial else out.where(F.col("n_events") == width)


def time_bars(states: DataFrame, keys: tuple[str, ...], width: int, origin: int = 0, levels: int | None = None) -> DataFrame:
    """keys, bar_start_ns, ofi (ofi_1.. for levels), mid, delta_mid, delta_mid_lead1, n_events,
    valid. Every bar from the first event to the last. An event across epochs adds nothing but
    counts, as part of the later epoch. A bar that mixes epochs, or an empty one between two
    epochs, is not valid, nor is one without a mid."""
    names = ["ofi"] if levels is None else [f"ofi_{m + 1}" for m in range(levels)]
    paired = _paired(states, keys).withColumns({"e": _event(levels), "bar_start_ns": bar_start("ts_event_ns", width, origin)})
    same = F.col("prev.epoch") == F.col("epoch")
    parts = [F.col("e")] if levels is None else [F.get("e", F.lit(m)) for m in range(levels)]
    is_event = F.col("prev").isNotNull()
    top = F.col("bid_px") if levels is None else F.get("bid_px", F.lit(0))
    low = F.col("ask_px") if levels is None else F.get("ask_px", F.lit(0))
    # One pass: event sums and the last mid of each bar come from the same aggregation.
    bars = paired.groupBy(*keys, "bar_start_ns").agg(
        *(F.sum(F.when(is_event & same, F.coalesce(p, F.lit(0.0))).otherwise(0.0)).alias(n) for n, p in zip(names, parts, strict=True)),
        F.count_if(is_event).alias("n_events"),
        F.min(F.when(is_event, F.col("epoch"))).alias("__lo"),
        F.max(F.when(is_event, F.col("epoch"))).alias("__hi"),
        F.max_by(mid(top, low), "seq").alias("__mid"),
    )
    first = bars.where("n_events > 0").groupBy(*keys).agg(F.min("bar_start_ns").alias("__first"), F.max("bar_start_ns").alias("__last"))
    bars = bars.join(first, list(keys)).where("bar_start_ns between __first and __last").drop("__first", "__last")
    bars = dense(bars, keys, "bar_start_ns", width)
    w = Window.partitionBy(*keys).orderBy("bar_start_ns")
    back = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # From the end backwards, as a frame up to the end costs the square of the bars.
    ahead = Window.partitionBy(*keys).orderBy(F.desc("bar_start_ns")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bars = bars.withColumns({
        "mid": F.last("__mid", ignorenulls=True).over(back),
        "n_events": F.coalesce("n_events", F.lit(0)).cast("long"),
        "__prev": F.last("__hi", ignorenulls=True).over(back),
        "__next": F.last("__lo", ignorenulls=True).over(ahead),
        **{n: F.coalesce(n, F.lit(0.0)) for n in names},
    })
    mixed = F.when(F.col("n_events") > 0, F.col("__lo") != F.col("__hi")).otherwise(F.col("__prev") != F.col("__next"))
    return bars.select(
        *keys, "bar_start_ns", *names, "mid", (F.col("mid") - F.lag("mid").over(w)).alias("delta_mid"),
        (F.lead("mid").over(w) - F.col("mid")).alias("delta_mid_lead1"), "n_events", (~mixed & F.col("mid").isNotNull()).alias("valid"),
    )


def rolling(rows: DataFrame, keys: tuple[str, ...], width_ns: int) -> DataFrame:
    """Events with `rolling`, the sum of e over the trailing width, both ends included."""
    return rolling_by_range(rows, keys, "ts_event_ns", width_ns, F.col("e"), "rolling")


def rolling_at_states(states: DataFrame, keys: tuple[str, ...], width_ns: int) -> DataFrame:
    """keys, seq, ts_event_ns, rolling of every state: the same sum of the events up to then, 0
    before the first one."""
    paired = _paired(states, keys)
    e = F.when(F.col("prev").isNotNull() & (F.col("prev.epoch") == F.col("epoch")), _event(None)).otherwise(0.0)
    rows = rolling_by_range(paired.withColumn("__e", F.coalesce(e, F.lit(0.0))), keys, "ts_event_ns", width_ns, F.col("__e"), "rolling")
    return rows.select(*keys, "seq", "ts_event_ns", "rolling")
