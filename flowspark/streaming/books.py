"""Books kept on a stream: top-of-book states that feed other processors, periodic snapshots of the
whole book, and probes aligned with frozen copies.

All take rows of `wire.book_events` with `arrival`, in which order the rows of a micro-batch are
taken; a symbol's whole book is its state, of which changed prices alone are written back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from . import processors
from .processors import APPLY, BUFFER, RESYNC, decide

NS_PER_MS = 1_000_000
LEVEL = "array<struct<price: double, qty: double>>"
Levels = list[tuple[float, float]]


def flat(events: DataFrame) -> DataFrame:
    """Events with each side as one array of prices and quantities in turn: pandas gets numbers, where it
    would get a dict for each level."""
    pairs = lambda c: F.flatten(F.transform(c, lambda x: F.array(x["price"].cast("double"), x["qty"].cast("double"))))
    return events.withColumns({c: pairs(c) for c in ("bids", "asks")})


def plain(levels: Any) -> Levels:
    if levels is None:
        return []
    if isinstance(levels, np.ndarray):
        levels = levels.tolist()
    if len(levels) and isinstance(levels[0], float):  # flat
        each = iter(levels)
        return list(zip(each, each, strict=True))
    return [(float(x["price"]), float(x["qty"])) for x in levels]


def structs(levels: Any) -> list[dict[str, float]]:
    return [{"price": p, "qty": q} for p, q in levels]


def in_order(rows: Iterator[pd.DataFrame], *names: str) -> Iterator[tuple]:
    """The named columns of all rows by arrival, numbers as Python's own and levels as pairs. Columns
    are turned into lists as a whole, as a dict for each row would cost more than its book."""
    df = pd.concat(list(rows)).sort_values("arrival", kind="stable")
    return zip(*(map(plain, df[c].to_numpy()) if c in ("bids", "asks") else df[c].tolist() for c in names), strict=True)


class Sides:
    """Bids and asks of one book, and which prices have changed since they were read."""

    def __init__(self, bids: dict[float, float], asks: dict[float, float]):
        self.sides, self.touched = (bids, asks), (set(), set())

    def clear(self) -> None:
        for side, touched in zip(self.sides, self.touched, strict=True):
            touched.update(side)
            side.clear()

    def apply(self, bids: Levels, asks: Levels) -> None:
        for side, touched, levels in zip(self.sides, self.touched, (bids, asks), strict=True):
            for price, qty in levels:
                touched.add(price)
                if qty > 0:
                    side[price] = qty
                else:
                    side.pop(price, None)

    def reset(self, bids: Levels, asks: Levels) -> None:
        self.clear()
        self.apply(bids, asks)

    def top(self) -> tuple[float, float, float, float] | None:
        """Best bid and ask with their quantities, if both are there."""
        bids, asks = self.sides
        if not bids or not asks:
            return None
        bid, ask = max(bids), min(asks)
        return bid, bids[bid], ask, asks[ask]

    def best(self, n: int | None = None) -> tuple[Levels, Levels]:
        bids, asks = self.sides
        return sorted(bids.items(), reverse=True)[:n], sorted(asks.items())[:n]


def stored(bids, asks) -> Sides:
    """The book of two map states."""
    return Sides(*({k[0]: v[0] for k, v in m.iterator()} for m in (bids, asks)))


def store(book: Sides, bids, asks) -> None:
    """Writes the prices that have changed."""
    for state, side, touched in zip((bids, asks), book.sides, book.touched, strict=True):
        for price in touched:
            if price in side:
                state.updateValue((price,), (side[price],))
            elif state.containsKey((price,)):
                state.removeKey((price,))


class _Book(StatefulProcessor):
    """A processor whose state is a book that follows snapshots and chained updates: updates before
    a snapshot are held (up to `buffer`), a gap forgets the book, and a snapshot in an unbroken
    chain is skipped unless `every_snapshot`. Each row may also be looked at before it is taken."""

    every_snapshot = False
    taken = staticmethod(flat)

    def __init__(self, buffer: int = BUFFER):
        self.buffer = buffer

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ids = handle.getValueState("ids", "last long, ready boolean, synced boolean, epoch long, valid boolean")
        self.bids = handle.getMapState("bids", "price double", "qty double")
        self.asks = handle.getMapState("asks", "price double", "qty double")
        self.held = handle.getListState("held", f"arrival long, ts_event_ns long, first long, final long, prev long, bids {LEVEL}, asks {LEVEL}")

    def load(self) -> None:
        self.last, self.ready, self.synced, self.epoch, self.valid = self.ids.get() if self.ids.exists() else (0, False, False, 0, False)
        self.book = stored(self.bids, self.asks)
        self.waiting = [tuple(x) for x in self.held.get()] if self.held.exists() else []
        self.waited = len(self.waiting)

    def save(self) -> None:
        self.ids.update((int(self.last), bool(self.ready), bool(self.synced), int(self.epoch), bool(self.valid)))
        store(self.book, self.bids, self.asks)
        if self.waiting:
            self.held.put(self.waiting)
        elif self.waited:
            self.held.clear()

    def take(self, rows: Iterator[pd.DataFrame], before: Callable[[int], None], after: Callable[[int, int, int, bool], None]) -> None:
        """Runs the rows through the book; `before` hears each row's event time, `after` arrival, event time, id and whether it was a
        snapshot, of all that was applied."""
        def update(arrival, ts, first, final, prev, bids, asks) -> None:
            if not self.ready:
                if len(self.waiting) < self.buffer:
                    self.waiting.append((int(arrival), int(ts), int(first), int(final), int(prev), structs(bids), structs(asks)))
                return
            decision = decide(self.last, self.synced, first, final, prev)
            if decision == APPLY:
                self.book.apply(bids, asks)
                self.last, self.synced = final, True
                after(arrival, ts, final, False)
            elif decision == RESYNC:
                self.ready = self.synced = False
                self.book.clear()

        for arrival, ts, is_snapshot, first, final, prev, bids, asks in in_order(rows, "arrival", "ts_event_ns", "is_snapshot", "first_update_id", "final_update_id", "prev_final_update_id", "bids", "asks"):
            before(ts)
            if not is_snapshot:
                update(arrival, ts, first, final, prev, bids, asks)
            elif self.every_snapshot or not (self.ready and self.synced):
                self.book.reset(bids, asks)
                self.last, self.ready, self.synced = final, True, False
                self.epoch += self.valid
                after(arrival, ts, final, True)
                held, self.waiting = self.waiting, []
                for x in held:
                    update(*x[:5], plain(x[5]), plain(x[6]))

    def close(self) -> None:
        pass


class BookStates(_Book):
    """The top of the book after every applied row, as processors of states take it: `seq` is the
    update id, doubled, with one more for updates, so that a snapshot stands before the update of its
    own id; the epoch counts the snapshots applied since the first valid state."""

    SCHEMA = "symbol string, seq long, epoch long, ts_event_ns long, final_update_id long, bid_px double, bid_qty double, ask_px double, ask_qty double"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self.load()
        out: list[tuple] = []

        def after(arrival: int, ts: int, final: int, is_snapshot: bool) -> None:
            if top := self.book.top():
                self.valid = True
                out.append((key[0], 2 * final + (not is_snapshot), self.epoch, ts, final, *top))

        self.take(rows, lambda _: None, after)
        self.save()
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in self.SCHEMA.split(", ")])


class BookSnapshots(_Book):
    """The whole book at every multiple of `every_ms` of event time while it is whole, in rows of at
    most `block` levels of a side. A tick is told when a later row comes, or, by a timer, when the
    watermark has passed it, so symbols without updates have their ticks, too."""

    SCHEMA = f"symbol string, tick_ms long, last_update_id long, side string, block int, levels {LEVEL}"

    def __init__(self, every_ms: int, block: int = 500, buffer: int = BUFFER):
        super().__init__(buffer)
        if every_ms < 1 or block < 1:
            raise ValueError("every_ms and block must be >= 1")
        self.every, self.block = every_ms, block

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.next = handle.getValueState("next", "ms long")

    def _told(self, key, upto_ms: int, out: list[tuple]) -> None:
        """All ticks up to a time; the next one after it is awaited."""
        while self.tick <= upto_ms:
            if self.ready:
                for side, levels in zip(("bid", "ask"), self.book.best(), strict=True):
                    out += [(key[0], self.tick, self.last, side, i // self.block, structs(levels[i : i + self.block])) for i in range(0, len(levels), self.block)]
            self.tick += self.every

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=[c.split()[0] for c in self.SCHEMA.split(", ", 5)])

    def _await(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(self.tick)
        self.next.update((self.tick,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self.load()
        out: list[tuple] = []
        self.tick = self.next.get()[0] if self.next.exists() else None

        def before(ts: int) -> None:
            if self.tick is None:
                self.tick = -(-ts // (self.every * NS_PER_MS)) * self.every
            self._told(key, (ts - 1) // NS_PER_MS, out)

        self.take(rows, before, lambda *_: None)
        self.save()
        self._await()
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.load()
        out: list[tuple] = []
        self.tick = self.next.get()[0]
        self._told(key, max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()), out)
        self._await()
        yield self._frame(out)


class ProbeAlign(StatefulProcessor):
    """Probes (rows with `probe` not null: reference books of id `final_update_id`) against the
    stream's book. A probe freezes a copy, which takes updates until the first one at or over the
    probe's id, whatever happens to the live book meanwhile. It is stale if no snapshot has come,
    if the book is already past its id, if the chain had a gap on the way, or if `patience_ms` of
    event time pass first, in rows or by the watermark. Rows must come in the order of ids."""

    SCHEMA = f"symbol string, probe long, rest_id long, aligned_u long, stale boolean, batches long, bids {LEVEL}, asks {LEVEL}, rest_bids {LEVEL}, rest_asks {LEVEL}"
    NUMBERS = ("probe", "rest_id", "until_ms", "last", "n", "gaps", "batches")
    BOOKS = ("bids", "asks", "rest_bids", "rest_asks")
    taken = staticmethod(flat)

    def __init__(self, levels: int, patience_ms: int):
        self.levels, self.patience = levels, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ids = handle.getValueState("ids", "last long, n long, gaps long")
        self.bids = handle.getMapState("bids", "price double", "qty double")
        self.asks = handle.getMapState("asks", "price double", "qty double")
        self.frozen = handle.getListState("frozen", ", ".join([*(f"{c} long" for c in self.NUMBERS), *(f"{c} {LEVEL}" for c in self.BOOKS)]))

    def _open(self) -> list[dict]:
        found = [dict(zip(self.NUMBERS + self.BOOKS, x, strict=True)) for x in self.frozen.get()] if self.frozen.exists() else []
        for x in found:
            x["rest_bids"], x["rest_asks"] = structs(plain(x["rest_bids"])), structs(plain(x["rest_asks"]))
        for x in found:
            x["book"] = Sides(dict(plain(x.pop("bids"))), dict(plain(x.pop("asks"))))
        return found

    def _keep(self, open_: list[dict]) -> None:
        rows = []
        for x in open_:
            bids, asks = x["book"].best()
            rows.append((*(x[c] for c in self.NUMBERS), structs(bids), structs(asks), x["rest_bids"], x["rest_asks"]))
        if rows:
            self.frozen.put(rows)
        else:
            self.frozen.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        for until in {x["until_ms"] for x in open_}:
            self.handle.registerTimer(until)

    def _row(self, key, x: dict, aligned: int | None, stale: bool) -> tuple:
        bids, asks = ([], []) if stale else x["book"].best(self.levels)
        return (key[0], x["probe"], x["rest_id"], None if stale else aligned, stale, x["batches"], structs(bids), structs(asks), x["rest_bids"], x["rest_asks"])

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        rows = pd.DataFrame(out, columns=["symbol", "probe", "rest_id", "aligned_u", "stale", "batches", "bids", "asks", "rest_bids", "rest_asks"])
        return rows.astype({"probe": "int64", "rest_id": "int64", "aligned_u": "Int64", "stale": "bool", "batches": "int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, n, gaps = self.ids.get() if self.ids.exists() else (None, 0, 0)
        book = stored(self.bids, self.asks)
        open_, out = self._open(), []

        def gap(at: dict, first: int, final: int, prev: int) -> bool:
            return prev != at["last"] and not (at["n"] == 0 and first <= at["last"] <= final)

        for ts, probe, is_snapshot, first, final, prev, bids, asks in in_order(rows, "ts_event_ns", "probe", "is_snapshot", "first_update_id", "final_update_id", "prev_final_update_id", "bids", "asks"):
            ts_ms = ts // NS_PER_MS
            late = [x for x in open_ if x["until_ms"] < ts_ms]
            out += [self._row(key, x, None, True) for x in late]
            open_ = [x for x in open_ if x["until_ms"] >= ts_ms]
            if not pd.isna(probe):
                x = {"probe": int(probe), "rest_id": final, "until_ms": ts_ms + self.patience, "last": last, "n": n, "gaps": gaps, "batches": 0, "rest_bids": structs(bids), "rest_asks": structs(asks)}
                if last is None or last > final or (last == final and gaps):
                    out.append(self._row(key, x, None, True))
                else:
                    x["book"] = Sides(*map(dict, book.sides))
                    if last == final:
                        out.append(self._row(key, x, final, False))
                    else:
                        open_.append(x)
            elif is_snapshot:
                book.reset(bids, asks)
                last, n, gaps = final, 0, 0
            else:
                if last is not None:
                    gaps += gap({"last": last, "n": n}, first, final, prev)
                    book.apply(bids, asks)
                    last, n = final, n + 1
                for x in open_:
                    x["gaps"] += gap(x, first, final, prev)
                    x["book"].apply(bids, asks)
                    x["last"], x["n"], x["batches"] = final, x["n"] + 1, x["batches"] + 1
                out += [self._row(key, x, x["last"], x["gaps"] > 0) for x in open_ if x["last"] >= x["rest_id"]]
                open_ = [x for x in open_ if x["last"] < x["rest_id"]]
        if last is not None:
            self.ids.update((last, n, gaps))
        store(book, self.bids, self.asks)
        self._keep(open_)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        open_ = self._open()
        over = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        self._keep([x for x in open_ if x["until_ms"] > over])
        yield self._frame([self._row(key, x, None, True) for x in open_ if x["until_ms"] <= over])

    def close(self) -> None:
        pass


def timed(stream: DataFrame, processor: StatefulProcessor, delay: str) -> DataFrame:
    """A processor with event-time timers over rows with ts_event_ns, which may come `delay` late. Spark
    leaves out later ones, and any at or before 1970."""
    rows = processors.taken(stream, processor).withColumn("event_time", F.timestamp_micros(F.expr("ts_event_ns div 1000"))).withWatermark("event_time", delay)
    return rows.groupBy("symbol").transformWithStateInPandas(statefulProcessor=processor, outputStructType=processor.SCHEMA, outputMode="Append", timeMode="EventTime")
