"""Replay order, epochs and integrity of update-id chains.

Headers are rows of (keys, uid, first_id, prev_id, is_snapshot, ts_event_ns, ts_recv_ns, row_id);
a snapshot's uid is its last update id, a delta's its final one.

Ids are cut into chunks of CHUNK, so that a hot symbol is many tasks; what crosses their borders is
one row a chunk.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain as chained

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.ordered import Order, following_min, previous, row_index, running_max, running_sum
from ..functions.scalars import floor_div
from ..sources.tape import written
from .book import best_at, changes, padded, swept, valid_top
from .lookup import books_at_ids, books_at_times

CHUNK = 1 << 20


def headers(snapshots: DataFrame, deltas: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The few columns that ordering needs; levels are never read for it. row_id is the snapshot's
    or delta's own, a column of both inputs."""
    s = snapshots.select(*keys, F.col("last_update_id").alias("uid"), F.col("last_update_id").alias("first_id"), F.lit(None).cast("long").alias("prev_id"), F.lit(True).alias("is_snapshot"), "ts_event_ns", "ts_recv_ns", "row_id")
    d = deltas.select(*keys, F.col("final_update_id").alias("uid"), F.col("first_update_id").alias("first_id"), F.col("prev_final_update_id").alias("prev_id"), F.lit(False).alias("is_snapshot"), "ts_event_ns", "ts_recv_ns", "row_id")
    return s.unionByName(d)


KEPT, PERIODIC, OFF_CHAIN = "kept", "periodic", "off_chain"


def _fates(runs: Iterable[dict]) -> Iterator[tuple[dict, str, int]]:
    """One key's runs in order, each with its fate and by how many places it moves. A run's deltas
    follow each other, so its first one's fate is that of all.

    A snapshot of the id that the chain has reached is a periodic copy; any other one starts the
    chain anew. A delta goes on from the id that it names as previous, or, first after a snapshot,
    from one that it brackets. Else it may be the change that a snapshot of its own id right after
    it has taken in: then that snapshot goes first. What is left is off the chain.
    """
    reached, just_started, asking, moved = None, False, None, 0

    def goes_on(d: dict) -> bool:
        return reached is not None and (d["prev_id"] == reached or (just_started and d["first_id"] <= reached <= d["uid"]))

    for run in chained(runs, [None]):
        if asking is not None:
            if run is not None and run["is_snapshot"] and run["uid"] == asking["uid"]:
                yield run, PERIODIC if run["uid"] == reached else KEPT, -1
                just_started |= run["uid"] != reached
                reached, moved = run["uid"], moved + 1
                if goes_on(asking):
                    yield asking, KEPT, moved
                    reached, just_started, asking = asking["last_uid"], False, None
                continue
            yield asking, OFF_CHAIN, moved
            asking = None
        if run is None:
            return
        if run["is_snapshot"]:
            yield run, PERIODIC if run["uid"] == reached else KEPT, 0
            just_started |= run["uid"] != reached
            reached = run["uid"]
        elif goes_on(run):
            yield run, KEPT, 0
            reached, just_started = run["last_uid"], False
        else:
            asking, moved = run, 0


def select(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Headers with fate and seq (replay position per key, of all rows).

    Deltas that name the one right before them as previous share its fate: they are one run, found
    inside chunks of ids. Only runs (snapshots, breaks of the chain, chunks) are walked in order.
    """
    rows = written(rows, "headers")  # read by every step below
    ids = [*keys, "__chunk"]
    order = Window.partitionBy(*ids).orderBy("uid", "is_snapshot", "row_id")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Deltas that share their id with others are runs of their own, and so is the one after them.
    rows = rows.withColumn("__chunk", floor_div("uid", CHUNK)).withColumn("__alone", (F.count("*").over(Window.partitionBy(*ids, "uid")) == 1) & ~F.col("is_snapshot"))
    before = F.lag(F.struct("uid", "__alone")).over(order)
    same = F.col("__alone") & before["__alone"] & (F.col("prev_id") == before["uid"]) & (F.col("first_id") > F.col("prev_id"))
    rows = rows.withColumns({"__head": ~F.coalesce(same, F.lit(False)), "__n": F.row_number().over(order)})
    rows = rows.withColumn("__run", F.sum(F.col("__head").cast("int")).over(upto))
    runs = rows.groupBy(*ids, "__run").agg(F.min_by(F.struct("uid", "first_id", "prev_id", "is_snapshot"), "__n").alias("h"), F.max("uid").alias("last_uid"), F.count("*").alias("__rows"))
    kinds = {f.name: f for f in rows.schema.fields}
    schema = T.StructType([*(kinds[k] for k in keys), T.StructField("__chunk", T.LongType()), T.StructField("__run", T.LongType()), T.StructField("fate", T.StringType()), T.StructField("__moved", T.LongType()), T.StructField("__rows", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (r for b in batches for r in b.to_pylist())
        ahead = next(stream, None)
        out: list[dict] = []
        while ahead is not None:
            key = tuple(ahead[k] for k in keys)

            def own(key=key) -> Iterator[dict]:
                nonlocal ahead
                while ahead is not None and tuple(ahead[k] for k in keys) == key:
                    row, ahead = ahead, next(stream, None)
                    yield row

            for row, fate, moved in _fates(own()):
                out.append({k: row[k] for k in (*ids, "__run", "__rows")} | {"fate": fate, "__moved": moved})
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
        yield pa.RecordBatch.from_pylist(out, schema=arrow)

    walked = runs.select(*ids, "__run", "__rows", "last_uid", "h.*").repartition(*keys).sortWithinPartitions(*ids, "__run").mapInArrow(run, schema)
    per_chunk = rows.groupBy(*ids).agg(F.count("*").alias("__size"))
    earlier = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_chunk.select(*ids, F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__offset"))
    got = rows.join(walked.drop("__rows"), [*ids, "__run"]).join(offsets, ids)
    return got.withColumn("seq", F.col("__offset") + F.col("__n") - 1 + F.col("__moved")).drop("__chunk", "__alone", "__head", "__n", "__run", "__moved", "__offset")


def by_seq(keys: tuple[str, ...], order: str = "seq") -> Order:
    return Order(keys, (order,), floor_div(order, CHUNK))


def _pulled(rows: DataFrame, at: Order) -> DataFrame:
    """Rows, numbered along the order by __n, with both clocks pulled back."""
    clocks = ("ts_event_ns", "ts_recv_ns")
    rows = following_min(rows, at, **{f"__least_{c}": F.col(c) - F.col("__n") for c in clocks})
    return rows.withColumns({c: F.col(f"__least_{c}") + F.col("__n") for c in clocks}).drop("__n", *(f"__least_{c}" for c in clocks))


def restamp(rows: DataFrame, keys: tuple[str, ...], order: str = "seq") -> DataFrame:
    """Kept headers with both clocks pulled back so that they strictly increase along the order."""
    at = by_seq(keys, order)
    return _pulled(row_index(rows, at, "__n"), at)


def selected(snapshots: DataFrame, deltas: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """All headers with fate and seq, written once: what follows reads them several times, and each time
    would order the whole tape anew."""
    return written(select(headers(snapshots, deltas, keys), keys), "replay-selected")


def kept_of(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The headers of `selected` that a replay applies, with strictly increasing clocks and group, the
    ordinal of the snapshot that they build on."""
    at = by_seq(keys)
    return _pulled(running_sum(rows.where(F.col("fate") == KEPT), at, __n=F.lit(1).cast("long"), group=F.col("is_snapshot").cast("long")), at)


def kept_headers(snapshots: DataFrame, deltas: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The headers that a replay applies, with seq, group and strictly increasing clocks."""
    return kept_of(selected(snapshots, deltas, keys), keys)


def level_changes(snapshots: DataFrame, deltas: DataFrame, kept: DataFrame, keys: tuple[str, ...], *more: str) -> DataFrame:
    """The level changes of kept headers, with `more` columns of these. Levels are joined to these only,
    so skipped snapshots are never shuffled."""
    ids = [*keys, "row_id"]
    s = snapshots.select(*ids, "bids", "asks").join(kept.where("is_snapshot").select(*ids, "seq", "group", *more), ids)
    d = deltas.select(*ids, "bids", "asks").join(kept.where("not is_snapshot").select(*ids, "seq", "group", *more), ids)
    return changes(s.unionByName(d), keys, "group", "seq", *more)


def replay(snapshots: DataFrame, deltas: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(kept headers, level changes): what a replay applies, both written once to the shared folder
    as several joins read them."""
    kept = written(kept_headers(snapshots, deltas, keys), "replay-headers")
    return kept, written(level_changes(snapshots, deltas, kept, keys), "replay-moves")


def _counted(kept: DataFrame, tops: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """tops (keys, group, seq, ..), the valid ones, with epoch, new_epoch and ts_event_ns. They are written
    once, as each reading would walk the books anew."""
    tops = written(tops, "replay-tops")
    first = tops.groupBy(*keys).agg(F.min_by("group", "seq").alias("__first"))  # group counts snapshots
    own = kept.select(*keys, "seq", F.col("is_snapshot").alias("new_epoch"), "ts_event_ns")
    met = own.join(tops, [*keys, "seq"]).join(F.broadcast(first), list(keys))
    states = [c for c in tops.columns if c not in (*keys, "group", "seq")]
    return met.select(*keys, "seq", (F.col("group") - F.col("__first")).alias("epoch"), "new_epoch", "ts_event_ns", *states)


def states(kept: DataFrame, moves: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, seq, epoch, new_epoch, ts_event_ns and the top of the book after every kept event
    with a valid top. The epoch counts the snapshots applied since the first valid state."""
    return _counted(kept, best_at(moves, kept, keys).where(valid_top()), keys)


def level_states(kept: DataFrame, moves: DataFrame, keys: tuple[str, ...], levels: int) -> DataFrame:
    """The same with arrays bid_px, bid_qty, ask_px and ask_qty of `levels` levels, null where
    there is none."""
    names = {"bid_px": ("bids", "price"), "bid_qty": ("bids", "qty"), "ask_px": ("asks", "price"), "ask_qty": ("asks", "qty")}
    tops = swept(moves, kept, keys, levels).where((F.size("bids") > 0) & (F.size("asks") > 0))
    return _counted(kept, tops.select(*keys, "group", "seq", *(padded(side, field, levels).alias(n) for n, (side, field) in names.items())), keys)


def by_id(keys: tuple[str, ...], *by: str) -> Order:
    return Order(keys, by, floor_div(by[0], CHUNK))


def jumps(deltas: DataFrame, snapshots: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Deltas, in id order, that do not continue the one before, with `explained`: whether a
    snapshot's id lies in [first, final] or is the previous id. Snapshot ids meet the jumps only,
    by the last id not above the delta's, found in one sorted pass over both."""
    d = deltas.select(*keys, "first_update_id", "final_update_id", "prev_final_update_id")
    d = previous(d, by_id(keys, "final_update_id", "first_update_id"), ["final_update_id"], "__last")
    d = d.where(F.col("__last").isNull() | (F.col("prev_final_update_id") != F.col("__last.final_update_id"))).drop("__last")
    ids = snapshots.select(*keys, F.col("last_update_id").alias("final_update_id")).distinct()
    both = d.withColumn("__late", F.lit(1)).unionByName(ids.withColumn("__late", F.lit(0)), allowMissingColumns=True)
    both = running_max(both, by_id(keys, "final_update_id", "__late"), __id=F.when(F.col("__late") == 0, F.col("final_update_id"))).where("__late = 1").drop("__late")
    exact = ids.select(*keys, F.col("final_update_id").alias("prev_final_update_id"), F.lit(True).alias("__same"))
    met = both.join(exact, [*keys, "prev_final_update_id"], "left")
    return met.withColumn("explained", F.coalesce(F.col("__id") >= F.col("first_update_id"), F.lit(False)) | F.coalesce("__same", F.lit(False))).drop("__id", "__same")


def audit(deltas: DataFrame, snapshots: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, epochs, breaks of the recorded chain."""
    return jumps(deltas, snapshots, keys).groupBy(*keys).agg(F.count_if("explained").alias("epochs"), F.count_if(~F.col("explained")).alias("breaks"))


def book_at_time(snapshots: DataFrame, deltas: DataFrame, keys: tuple[str, ...], ts: int) -> tuple[DataFrame, DataFrame]:
    """(levels, status): every key's book at event time ts, as `lookup.books_at_times` gives it."""
    known = snapshots.where(F.col("ts_event_ns") <= ts)
    asked = known.select(*keys).distinct().select(*keys, F.lit(0).cast("long").alias("query"), F.lit(ts).cast("long").alias("ts_event_ns"))
    return tuple(df.drop("query") for df in books_at_times(known, deltas.where(F.col("ts_event_ns") <= ts), keys, asked))


def book_at_id(snapshots: DataFrame, deltas: DataFrame, keys: tuple[str, ...], rest_id: int) -> tuple[DataFrame, DataFrame]:
    """The same at the first stored delta with final id >= rest_id, as `lookup.books_at_ids` gives it."""
    known = snapshots.where(F.col("last_update_id") <= rest_id)
    asked = known.select(*keys).distinct().select(*keys, F.lit(0).cast("long").alias("query"), F.lit(rest_id).cast("long").alias("rest_id"))
    return tuple(df.drop("query") for df in books_at_ids(known, deltas, keys, asked))
