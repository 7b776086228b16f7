"""Books at many times or ids at once.

Each query belongs to the last snapshot at or before it; deltas belong to the last snapshot before
them. Both are found by ordered passes over headers, in chunks; then one sweep walks the changes and
shows the whole book at every query, each chunk from its live levels. A query costs its book, however
far it lies from its snapshot, and a symbol with many queries or deltas is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import Order, following_min, previous, running_max, running_sum
from ..functions.scalars import floor_div
from ..sources.tape import written
from .book import changes, live_levels, swept

#: Nanoseconds, and ids, of one chunk.
CHUNK_NS, CHUNK_IDS = 60_000_000_000, 1 << 16
_NO_LEVELS = "CAST(array() AS array<struct<price: double, qty: double>>)"


def _grouped(rows: DataFrame, order: Order, own: Column) -> DataFrame:
    """rows with `group`, the last snapshot's (place, id) up to the row, written once; rows before any
    are left out. The input is written, too, as the running maximum reads it twice."""
    return written(running_max(written(rows, "lookup-events"), order, group=own).where("group is not null"), "lookup-rows")


def _order(keys: tuple[str, ...], at: str, chunk: int) -> Order:
    return Order(keys, (at, "rank", "id"), floor_div(at, chunk))


def _gaps(rows: DataFrame, keys: tuple[str, ...], at: str, chunk: int) -> DataFrame:
    """Deltas that do not continue what stands before them in their group: the snapshot, which the
    first delta may also bracket, or another delta."""
    rows = previous(rows, _order((*keys, "group"), at, chunk), ["id", "rank", "is_snapshot"], "before")
    bracket = F.col("before.is_snapshot") & (F.col("first_update_id") <= F.col("before.id")) & (F.col("before.id") <= F.col("id"))
    return rows.withColumn("gap", ~F.col("is_snapshot") & (F.col("prev_final_update_id") != F.col("before.id")) & ~bracket)


def books_at_times(snapshots: DataFrame, deltas: DataFrame, keys: tuple[str, ...], queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(levels, status) of each query (keys, query, ts_event_ns): the book from the last snapshot at that
    time and the deltas after it up to then. levels: keys, query, side, price, qty; status: keys, query,
    snapshot_id, n_gaps (deltas on the way that broke the chain). Queries before any snapshot have
    neither."""
    none = F.lit(None).cast("long")
    row = lambda df, rank, uid, *more: df.select(*keys, "ts_event_ns", F.lit(rank).alias("rank"), uid.cast("long").alias("id"), *more)
    ids = [none.alias("first_update_id"), none.alias("prev_final_update_id"), F.lit(True).alias("is_snapshot")]
    d = row(deltas, 0, F.col("final_update_id"), "first_update_id", "prev_final_update_id", F.lit(False).alias("is_snapshot"), "bids", "asks")
    s = row(snapshots, 1, F.col("last_update_id"), *ids, "bids", "asks")
    q = row(queries, 2, F.col("query"), *ids, F.expr(_NO_LEVELS).alias("bids"), F.expr(_NO_LEVELS).alias("asks"))
    rows = _grouped(d.unionByName(s).unionByName(q), _order(keys, "ts_event_ns", CHUNK_NS), F.when(F.col("rank") == 1, F.struct("ts_event_ns", "id")))
    asked = rows.where("rank = 2").select(*keys, "group", F.col("ts_event_ns").alias("seq"), F.col("id").alias("query"))
    moves = changes(rows.where("rank < 2").withColumn("uid", F.col("id")), keys, "group", "ts_event_ns", "uid")
    moves = moves.withColumns({"seq": F.col("ts_event_ns"), "pos": F.struct("uid", "pos")})
    shown = swept(moves, asked.drop("query").distinct(), keys, chunk=CHUNK_NS)
    levels = changes(shown.join(asked, [*keys, "group", "seq"]), keys, "query").drop("pos")
    headers = rows.drop("bids", "asks")
    broken = _gaps(headers.where("rank < 2"), keys, "ts_event_ns", CHUNK_NS).select(*headers.columns, "gap")
    counted = broken.unionByName(headers.where("rank = 2").withColumn("gap", F.lit(False)))
    counted = running_sum(counted, _order((*keys, "group"), "ts_event_ns", CHUNK_NS), n_gaps=F.col("gap").cast("long")).where("rank = 2")
    return levels, counted.select(*keys, F.col("id").alias("query"), F.col("group.id").alias("snapshot_id"), "n_gaps")


def books_at_ids(snapshots: DataFrame, deltas: DataFrame, keys: tuple[str, ...], queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same for queries (keys, query, rest_id): from the last snapshot not above the id up to the first
    delta at or over it. status also has aligned_u and n_batches; where no such delta is stored,
    aligned_u is null and the book is the snapshot's."""
    none = F.lit(None).cast("long")
    more = [none.alias("first_update_id"), none.alias("prev_final_update_id"), F.lit(True).alias("is_snapshot")]
    row = lambda df, rank, uid, *rest: df.select(*keys, uid.cast("long").alias("at"), F.lit(rank).alias("rank"), *rest)
    s = row(snapshots, 0, F.col("last_update_id"), F.col("last_update_id").alias("id"), *more, "ts_event_ns", "bids", "asks")
    q = row(queries, 1, F.col("rest_id"), F.col("query").cast("long").alias("id"), *more, none.alias("ts_event_ns"), F.expr(_NO_LEVELS).alias("bids"), F.expr(_NO_LEVELS).alias("asks"))
    d = row(deltas, 2, F.col("final_update_id"), F.col("final_update_id").alias("id"), "first_update_id", "prev_final_update_id", F.lit(False).alias("is_snapshot"), "ts_event_ns", "bids", "asks")
    order = _order(keys, "at", CHUNK_IDS)
    rows = _grouped(s.unionByName(q).unionByName(d), order, F.when(F.col("rank") == 0, F.struct("at", "ts_event_ns")))
    stops, rows = _stops(rows, keys, order), rows.where("rank <> 2 or id > group.at")
    headers = rows.drop("bids", "asks", "ts_event_ns")
    # What each query finds in its group: deltas below its id, breaks among them, the last one.
    broken = _gaps(headers.where("rank <> 1"), keys, "at", CHUNK_IDS).select(*headers.columns, "gap")
    found = broken.unionByName(headers.where("rank = 1").withColumn("gap", F.lit(False)))
    inside = _order((*keys, "group"), "at", CHUNK_IDS)
    is_delta = F.col("rank") == 2
    found = running_sum(found, inside, n_gaps=F.col("gap").cast("long"), n_before=is_delta.cast("long"))
    found = running_max(found, inside, last=F.when(F.col("rank") != 1, F.col("id"))).where("rank = 1")
    found = found.select(*keys, "group", F.col("id").alias("query"), F.col("at").alias("rest_id"), "n_gaps", "n_before", "last")
    found = found.join(stops, [*keys, "query"], "left").withColumn("exact", F.col("group.at") == F.col("rest_id"))
    found = written(found, "lookup-found")  # a row a query; three steps read it, and each would number all deltas anew
    through = F.col("stop.final_update_id").isNotNull() & ~F.col("exact")
    bad = (F.col("stop.prev_final_update_id") != F.col("last")) & ~((F.col("n_before") == 0) & (F.col("stop.first_update_id") <= F.col("last")) & (F.col("last") <= F.col("stop.final_update_id")))
    status = found.select(
        *keys, "query", F.col("group.at").alias("snapshot_id"), F.when(through, F.col("n_gaps") + bad.cast("long")).otherwise(0).alias("n_gaps"),
        F.when(F.col("exact"), F.col("rest_id")).otherwise(F.col("stop.final_update_id")).alias("aligned_u"), F.when(through, F.col("n_before") + 1).otherwise(0).cast("long").alias("n_batches"))
    seq = F.when(through, F.col("rest_id") - 1).otherwise(F.col("group.at"))
    asked = found.select(*keys, "group", seq.alias("seq"), "query")
    moves = changes(rows.where("rank <> 1"), keys, "group", "at").withColumn("seq", F.col("at"))
    shown = swept(moves, asked.drop("query").distinct(), keys, chunk=CHUNK_IDS).join(asked, [*keys, "group", "seq"])
    last = found.where(through).select(*keys, "query", "stop.bids", "stop.asks")
    both = changes(shown, keys, "query").withColumn("seq", F.lit(0)).unionByName(changes(last, keys, "query").withColumn("seq", F.lit(1)))
    return live_levels(both, (*keys, "query")), status


def _stops(rows: DataFrame, keys: tuple[str, ...], order: Order) -> DataFrame:
    """keys, query and `stop`: the first stored delta at or over the query's id, whole."""
    ids = rows.where("rank > 0").select(*keys, "at", "rank", "id", F.when(F.col("rank") == 2, F.col("at")).alias("u"))
    met = following_min(ids, order, stop_id=F.col("u")).where("rank = 1 and stop_id is not null").select(*keys, F.col("id").alias("query"), F.col("stop_id").alias("at"))
    whole = F.struct(F.col("at").alias("final_update_id"), "first_update_id", "prev_final_update_id", "bids", "asks")
    return met.join(rows.where("rank = 2"), [*keys, "at"]).groupBy(*keys, "query").agg(F.first(whole).alias("stop"))
