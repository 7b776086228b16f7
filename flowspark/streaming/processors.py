"""Incremental operators as stateful processors (transformWithStateInPandas, RocksDB state).

Rows of a micro-batch are sorted inside the processor and worked on as whole columns; the source's
maxFilesPerTrigger or maxBytesPerTrigger bounds them. Across micro-batches, book states must come in
order: a state whose seq is not above the last one's is stale, left out and counted. Trades only add
up, so Cvd takes late ones, too; Vpin cuts its buckets in the order of arrival of micro-batches. State
is bounded: a few numbers, a list of a window's length, or the live book.
"""

from __future__ import annotations

import contextlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalars import normal_cdf_of

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE, PARTITIONS = "spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"
#: Keys that are kept apart, if no more are known.
MOST_APART = 64
BUFFER = 5000
TOLERANCE = 1e-9


def _sorted(batches: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values(by, kind="stable")


def _checked(df: pd.DataFrame) -> pd.DataFrame:
    if not df["aggressor_sign"].isin([-1, 1]).all():
        raise ValueError("aggressor_sign must be +1 or -1")
    if (df["qty"] < 0).any():
        raise ValueError("qty must be non-negative")
    return df


class Cvd(StatefulProcessor):
    """Running signed volume."""

    SCHEMA = "symbol string, trade_id long, delta double, cvd double"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "v double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        df = _checked(_sorted(rows, ["ts_event_ns", "trade_id"]))
        delta = df["qty"] * df["aggressor_sign"]
        start = self.total.get()[0] if self.total.exists() else 0.0
        total = start + delta.cumsum()
        self.total.update((float(total.iloc[-1]),))
        yield pd.DataFrame({"symbol": key[0], "trade_id": df["trade_id"], "delta": delta, "cvd": total})

    def close(self) -> None:
        pass


def contributions(book: np.ndarray) -> np.ndarray:
    """Signed queue changes between consecutive states; `book` is (state, side, ...) with bid price
    and quantity, ask price and quantity as sides. Missing values give NaN."""
    bp, bq, ap, aq = (book[1:, i] for i in range(4))
    bp0, bq0, ap0, aq0 = (book[:-1, i] for i in range(4))
    e = (bp >= bp0) * bq - (bp <= bp0) * bq0 - (ap <= ap0) * aq + (ap >= ap0) * aq0
    return np.where(np.isnan(book[1:]).any(1) | np.isnan(book[:-1]).any(1), np.nan, e)


class _States(StatefulProcessor):
    """What processors of book states share: order, the last state of the batch before, stale rows."""

    SIDES = ["bid_px", "bid_qty", "ask_px", "ask_qty"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq long, epoch long, valid boolean, stale long, book array<double>")

    def joined(self, rows: Iterator[pd.DataFrame]) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
        """The batch's rows that are not stale; their books, epochs and validity, each with the last
        state's before them (one of no epoch where there is none)."""
        df = _sorted(rows, ["seq"])
        seq, epoch, valid, stale, book = self.last.get() if self.last.exists() else (None, None, False, 0, [])
        late = (df["seq"] <= seq).to_numpy() if seq is not None else np.zeros(len(df), bool)
        late |= df["seq"].duplicated().to_numpy()
        df = df[~late]
        now = self.books(df)
        before = np.array([math.nan if x is None else x for x in book], float).reshape(1, *now.shape[1:]) if len(book) and len(now) else np.full((1, *now.shape[1:]), np.nan)
        books = np.concatenate([before, now])
        epochs = np.concatenate([[-1 if epoch is None else epoch], df["epoch"].to_numpy(np.int64)])
        valids = np.concatenate([[bool(valid)], self.valid(now)])
        if len(df):
            self.last.update((int(df["seq"].iloc[-1]), int(epochs[-1]), bool(valids[-1]), int(stale + late.sum()), [None if math.isnan(x) else float(x) for x in books[-1].ravel()]))
        elif late.any():
            self.last.update((seq, epoch, valid, int(stale + late.sum()), list(book)))
        return df, books, epochs, valids

    def books(self, df: pd.DataFrame) -> np.ndarray:
        return df[self.SIDES].to_numpy(float)

    def valid(self, books: np.ndarray) -> np.ndarray:
        return ~np.isnan(books).any(1) & (books[:, 1] > 0) & (books[:, 3] > 0)

    def close(self) -> None:
        pass


class Ofi(_States):
    """Book-event imbalance; an invalid state, or another epoch, starts anew."""

    SCHEMA = "symbol string, seq long, e double"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        df, books, epochs, valid = self.joined(rows)
        event = valid[1:] & valid[:-1] & (epochs[1:] == epochs[:-1])
        yield pd.DataFrame({"symbol": key[0], "seq": df["seq"].to_numpy(np.int64)[event], "e": contributions(books)[event]})


class RollingOfi(_States):
    """For every state the sum of the imbalance over the trailing width, 0 before the first event.
    The events of one width are kept."""

    SCHEMA = "symbol string, seq long, ts_event_ns long, rolling double"

    def __init__(self, width_ns: int):
        self.width = width_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.recent = handle.getValueState("recent", "ts array<long>, e array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        df, books, epochs, valid = self.joined(rows)
        if not len(df):
            return
        event = valid[1:] & valid[:-1] & (epochs[1:] == epochs[:-1])
        old = self.recent.get() if self.recent.exists() else ([], [])
        ts = df["ts_event_ns"].to_numpy(np.int64)
        at = np.concatenate([np.array(old[0], np.int64), ts])
        e = np.concatenate([np.array(old[1], float), np.where(event, contributions(books), 0.0)])
        total = np.concatenate([[0.0], np.cumsum(e)])
        own = np.arange(len(old[0]), len(at))
        sums = total[own + 1] - total[np.searchsorted(at, ts - self.width, side="left")]
        keep = at >= ts[-1] - self.width
        self.recent.update((at[keep].tolist(), e[keep].tolist()))
        yield pd.DataFrame({"symbol": key[0], "seq": df["seq"].to_numpy(np.int64), "ts_event_ns": ts, "rolling": sums})


class Mlofi(_States):
    """The same at several levels; a missing level on either side of a pair gives null."""

    SCHEMA = "symbol string, seq long, e array<double>"

    def books(self, df: pd.DataFrame) -> np.ndarray:
        side = lambda c: np.array([[math.nan if x is None else float(x) for x in levels] for levels in df[c]], float)
        return np.stack([side(c) for c in self.SIDES], axis=1) if len(df) else np.zeros((0, 4, 1))

    def valid(self, books: np.ndarray) -> np.ndarray:
        return np.ones(len(books), bool)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        df, books, epochs, valid = self.joined(rows)
        event = valid[1:] & valid[:-1] & (epochs[1:] == epochs[:-1])
        e = contributions(books)[event] if len(df) else []
        yield pd.DataFrame({"symbol": key[0], "seq": df["seq"].to_numpy(np.int64)[event], "e": [[None if math.isnan(x) else float(x) for x in r] for r in e]})


class Vpin(StatefulProcessor):
    """Toxicity over the last `window` buckets, each of `size`; `remainder` is the volume of the open
    bucket after the micro-batch. By aggressor, or `bvc`: by price changes from close to close, over
    a fixed sigma, or over their sample deviation up to then, which makes values differ from those
    of a whole tape and is never revised."""

    SCHEMA = "symbol string, bucket long, vpin double, remainder double"

    def __init__(self, size: float, window: int, classification: str = "aggressor", sigma: float | None = None):
        if not size > 0 or window < 1:
            raise ValueError("size must be > 0 and window >= 1")
        if classification not in ("aggressor", "bvc"):
            raise ValueError(f"unknown classification: {classification!r}")
        self.size, self.window, self.bulk, self.sigma = float(size), window, classification == "bvc", sigma

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "volume double, buy double, n long, close double, mean double, m2 double, recent array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        df = _sorted(rows, ["ts_event_ns", "trade_id"])
        df = (df if self.bulk else _checked(df))[df["qty"] > 0]
        if not len(df):
            return
        qty, price = df["qty"].to_numpy(float), df["price"].to_numpy(float)
        volume, buy, n, close, mean, m2, recent = self.state.get() if self.state.exists() else (0.0, 0.0, 0, float(price[0]), 0.0, 0.0, [])
        bought = np.zeros(len(df)) if self.bulk else np.where(df["aggressor_sign"].to_numpy() > 0, qty, 0.0)
        c, b = volume + np.concatenate([[0.0], np.cumsum(qty)]), buy + np.concatenate([[0.0], np.cumsum(bought)])
        full = int(math.floor(c[-1] / self.size + TOLERANCE))
        grid = self.size * np.arange(1, full + 1)
        cum = np.interp(grid, c, b)
        if self.bulk:
            closes = price[np.minimum(np.searchsorted(c[1:], grid - self.size * TOLERANCE, side="left"), len(price) - 1)]
            fresh = np.diff(np.concatenate([[close], closes]))
        else:
            closes = np.array([close])
            fresh = np.abs(self.size - 2 * np.clip(np.diff(np.concatenate([[0.0], cum])), 0.0, self.size))
        held = np.concatenate([np.array(recent, float), fresh])
        out = []
        for i in range(full):
            if self.bulk:
                step = fresh[i] - mean
                mean += step / (n + i + 1)
                m2 += step * (fresh[i] - mean)
            last = held[max(0, len(recent) + i + 1 - self.window) : len(recent) + i + 1]
            if len(last) == self.window:
                out.append((n + i, self._value(last, m2, n + i + 1)))
        left = max(0.0, c[-1] - full * self.size)
        keep = held[max(0, len(held) - self.window) :]
        self.state.update((float(left), float(b[-1] - (cum[-1] if full else 0.0)), n + full, float(closes[-1] if full else close), float(mean), float(m2), [float(x) for x in keep]))
        yield pd.DataFrame({"symbol": key[0], "bucket": pd.Series([k for k, _ in out], dtype="int64"), "vpin": pd.Series([v for _, v in out], dtype="float64"), "remainder": left})

    def _value(self, last: np.ndarray, m2: float, n: int) -> float:
        if self.bulk:
            sigma = self.sigma if self.sigma is not None else math.sqrt(m2 / (n - 1)) if n > 1 else 0.0
            last = np.abs(self.size - 2 * self.size * (normal_cdf_of(last / sigma) if sigma > 0 else np.full(len(last), 0.5)))
        return min(1.0, max(0.0, float(last.sum()) / (self.window * self.size)))

    def close(self) -> None:
        pass


APPLY, STALE, RESYNC, BUFFERED, SNAPSHOT, DISCONNECT = "APPLY", "DROP_STALE", "RESYNC", "BUFFER", "SNAPSHOT", "DISCONNECT"


def decide(last: int, synced: bool, first: int, final: int, prev: int) -> str:
    """What a depth update with ids (first, final, prev) is to a book at `last`: stale below it;
    right after a snapshot it must bracket the id; then each must name the one before."""
    if final < last:
        return STALE
    if not synced:
        return APPLY if first <= last <= final else RESYNC
    return APPLY if prev == last else RESYNC


class BookSync(StatefulProcessor):
    """Snapshots and depth updates of a symbol -> each one's decision and the top of the book.

    Without a snapshot, updates are held, up to `buffer`; more are dropped, though decided BUFFER, and
    counted in n_dropped. A gap forgets the book and waits for the next snapshot; the update that
    shows it is not applied. A row with `disconnect` (a column that the input may lack) forgets the
    book and all held updates. Rows are taken in arrival order (`arrival`). Of the book in the state
    only changed prices are written.
    """

    SCHEMA = "symbol string, arrival long, final_update_id long, decision string, bid_px double, bid_qty double, ask_px double, ask_qty double, n_dropped long"

    def __init__(self, buffer: int = BUFFER):
        self.buffer = buffer

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ids = handle.getValueState("ids", "last long, ready boolean, synced boolean, dropped long")
        self.bids = handle.getMapState("bids", "price double", "qty double")
        self.asks = handle.getMapState("asks", "price double", "qty double")
        self.held = handle.getListState("held", "arrival long, first long, final long, prev long, bids array<array<double>>, asks array<array<double>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        df = _sorted(rows, ["arrival"])
        last, ready, synced, dropped = self.ids.get() if self.ids.exists() else (0, False, False, 0)
        stored = [{k[0]: v[0] for k, v in m.iterator()} for m in (self.bids, self.asks)]
        book = [dict(side) for side in stored]
        held = [tuple(x) for x in self.held.get()] if self.held.exists() else []
        out: list[tuple] = []

        def note(arrival, final, decision) -> None:
            shown = decision in (APPLY, SNAPSHOT)
            b, a = (max(book[0], default=None), min(book[1], default=None)) if shown else (None, None)
            out.append((key[0], arrival, final, decision, b, book[0].get(b), a, book[1].get(a), dropped))

        def forget() -> None:
            nonlocal ready, synced
            ready = synced = False
            book[0].clear()
            book[1].clear()

        def update(arrival, first, final, prev, bids, asks) -> None:
            nonlocal last, synced, dropped
            if not ready:
                if len(held) < self.buffer:
                    held.append((arrival, first, final, prev, bids, asks))
                else:
                    dropped += 1
                note(arrival, final, BUFFERED)
                return
            decision = decide(last, synced, first, final, prev)
            if decision == APPLY:
                for side, levels in zip(book, (bids, asks), strict=True):
                    side.update((p, q) for p, q in levels if q > 0)
                    for p, q in levels:
                        if q <= 0:
                            side.pop(p, None)
                last, synced = final, True
            elif decision == RESYNC:
                forget()
            note(arrival, final, decision)

        plain = lambda levels: [] if levels is None else [[float(x["price"]), float(x["qty"])] for x in levels]
        for r in df.to_dict("records"):
            if r.get("disconnect") is True:
                forget()
                held.clear()
                note(r["arrival"], last, DISCONNECT)
                continue
            bids, asks = plain(r["bids"]), plain(r["asks"])
            if r["is_snapshot"]:
                book[:] = [{p: q for p, q in side if q > 0} for side in (bids, asks)]
                last, ready, synced = int(r["final_update_id"]), True, False
                note(r["arrival"], last, SNAPSHOT)
                waiting, held = held, []
                for x in waiting:
                    update(*x)
            else:
                update(int(r["arrival"]), int(r["first_update_id"]), int(r["final_update_id"]), int(r["prev_final_update_id"]), bids, asks)
        self.ids.update((int(last), bool(ready), bool(synced), int(dropped)))
        for state, now, before in zip((self.bids, self.asks), book, stored, strict=True):
            for p in before.keys() - now.keys():
                state.removeKey((p,))
            for p, q in now.items():
                if before.get(p) != q:
                    state.updateValue((p,), (q,))
        if held:
            self.held.put(held)
        else:
            self.held.clear()
        names = [c.split()[0] for c in self.SCHEMA.split(", ")]
        yield pd.DataFrame(out, columns=names).astype({"arrival": "int64", "final_update_id": "int64", "n_dropped": "int64", "bid_px": "float64", "bid_qty": "float64", "ask_px": "float64", "ask_qty": "float64"})

    def close(self) -> None:
        pass


def taken(stream: DataFrame, processor: StatefulProcessor) -> DataFrame:
    """The stream in the form that the processor takes, if it has one of its own."""
    return processor.taken(stream) if hasattr(processor, "taken") else stream


def stateful(stream: DataFrame, processor: StatefulProcessor, key: str = "symbol") -> DataFrame:
    return taken(stream, processor).groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=processor.SCHEMA, outputMode="Append", timeMode="None")


def apart(spark: SparkSession, keys: Sequence[str]) -> int:
    """The least number of partitions in which the most of few keys have a task of their own; of over
    MOST_APART keys the session's number, as many keys are even by themselves."""
    keys = sorted(set(keys))
    if not keys or len(keys) > MOST_APART:
        return int(spark.conf.get(PARTITIONS))
    hashes = np.array([r[0] for r in spark.createDataFrame([(k,) for k in keys], "k string").select(F.hash("k")).collect()], np.int64)
    return max(range(len(keys), 4 * len(keys) + 1), key=lambda n: (len(np.unique(hashes % n)), -n))


@contextlib.contextmanager
def _set(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings while a query starts, which keeps a copy of them."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drained(stream: DataFrame, out: str, checkpoint: str, at_once: bool = True, keys: Sequence[str] = ()) -> DataFrame:
    """Runs a streaming frame over all that is there now, into Parquet at `out`, and reads it. Sources
    that plan their own batches, and watermarks that move on after the last row, need `at_once` off.
    Every partition of state costs a worker and a commit in each batch, empty ones, too; if the keys of
    state are known and few, there are just so many that they are apart."""
    spark: SparkSession = stream.sparkSession
    schema = stream.schema
    with _set(spark, {STORE: ROCKSDB} | ({PARTITIONS: str(apart(spark, keys))} if keys else {})):
        writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        query = (writer.trigger(availableNow=True) if at_once else writer).start()
        try:
            query.awaitTermination() if at_once else query.processAllAvailable()
        finally:
            query.stop()
    return spark.read.schema(schema).parquet(out)
