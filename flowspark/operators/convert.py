"""Tapes as simulator feeds: book operations, event rows, conservation; quotes and positions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.ordered import Order, previous, running_sum
from ..functions.scalars import (
    DEPTH_CLEAR_EVENT, DEPTH_EVENT, DEPTH_SNAPSHOT_EVENT, FLAG_LAST, FLAG_SNAPSHOT, TRADE_EVENT, event_kind, event_word, floor_div, local_ts, order_id, ticks,
)

#: Sequence numbers of one chunk of a quoting rule's targets.
CHUNK = 1 << 16


def _ops(levels: str, side: str, action: Column, tick: float, positive: bool) -> Column:
    got = F.filter(levels, lambda x: x["qty"] > 0) if positive else F.col(levels)
    return F.transform(F.coalesce(got, F.array()), lambda x: F.struct(
        (action if positive else F.when(x["qty"] == 0, "delete").otherwise("update")).alias("action"), F.lit(0).alias("flags"), F.lit(side).alias("side"),
        x["price"].alias("price"), x["qty"].alias("size"), order_id(x["price"], tick).alias("order_id")))


def _exploded(rows: DataFrame, keys: tuple[str, ...], ops: Column, sequence: str) -> DataFrame:
    rows = rows.withColumn("__ops", ops).select(*keys, F.col(sequence).alias("sequence"), "ts_event_ns", F.col("ts_recv_ns").alias("ts_init_ns"), F.size("__ops").alias("__n"), F.posexplode("__ops").alias("pos", "o"))
    last = F.when(F.col("pos") == F.col("__n") - 1, F.lit(FLAG_LAST)).otherwise(F.lit(0))
    return rows.select(*keys, "sequence", "ts_event_ns", "ts_init_ns", "pos", "o.action", F.col("o.flags").bitwiseOR(last).alias("flags"), "o.side", "o.price", "o.size", "o.order_id")


def snapshot_ops(snapshots: DataFrame, keys: tuple[str, ...], tick: float) -> DataFrame:
    """A clear and an add per level with quantity, bids first; the last one flagged."""
    clear = F.array(F.struct(F.lit("clear").alias("action"), F.lit(FLAG_SNAPSHOT).alias("flags"), F.lit(None).cast("string").alias("side"), F.lit(None).cast("double").alias("price"), F.lit(None).cast("double").alias("size"), F.lit(None).cast("long").alias("order_id")))
    return _exploded(snapshots, keys, F.concat(clear, _ops("bids", "bid", F.lit("add"), tick, True), _ops("asks", "ask", F.lit("add"), tick, True)), "last_update_id")


def delta_ops(deltas: DataFrame, keys: tuple[str, ...], tick: float) -> DataFrame:
    """A delete or an update per level; deltas without levels give nothing."""
    return _exploded(deltas, keys, F.concat(_ops("bids", "bid", F.lit(""), tick, False), _ops("asks", "ask", F.lit(""), tick, False)), "final_update_id")


def _feed(rows: DataFrame, keys: tuple[str, ...], ev: Column, px: Column | str, qty: Column | str, oid: Column, *more: Column | str) -> DataFrame:
    px, qty = (F.col(c) if isinstance(c, str) else c for c in (px, qty))
    return rows.select(*keys, ev.alias("ev"), F.col("ts_event_ns").alias("exch_ts"), local_ts("ts_event_ns", "ts_recv_ns").alias("local_ts"), px.alias("px"), qty.alias("qty"),
                       oid.cast("long").alias("order_id"), F.lit(0).cast("long").alias("ival"), F.lit(0.0).alias("fval"), *more)


def trade_rows(trades: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """A row per trade with quantity; `line` orders rows of equal times."""
    rows = trades.where("qty > 0")
    return _feed(rows, keys, event_word(TRADE_EVENT, F.col("aggressor_sign") > 0), "price", "qty", F.greatest(F.lit(0).cast("long"), "trade_id"), F.struct(F.lit(0).cast("long").alias("seq"), F.col("trade_id").alias("n")).alias("line"))


#: What level changes carry of their headers, so that no row of a feed has to look it up.
OF_HEADER = ("is_snapshot", "ts_event_ns", "ts_recv_ns")


def level_rows(moves: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(initial, feed) rows of a replay's level changes with OF_HEADER. The first snapshot gives
    the initial rows; a later one clears each side that it has levels on, out to the farthest of
    its own and the deepest price seen since the snapshot before, and then states its levels."""
    rows = moves.withColumn("is_bid", F.col("side") == "bid")
    line = F.struct("seq", (F.when(F.col("is_bid"), F.lit(0)).otherwise(F.lit(1 << 40)) + F.col("pos")).cast("long").alias("n")).alias("line")
    zero = F.lit(0)
    levels = rows.where("is_snapshot and qty > 0")
    snap_ev = event_word(DEPTH_SNAPSHOT_EVENT, F.col("is_bid"))
    initial = _feed(levels.where("group = 1"), keys, snap_ev, "price", "qty", zero, line)
    again = _feed(levels.where("group > 1"), keys, snap_ev, "price", "qty", zero, line)
    depth = _feed(rows.where("not is_snapshot"), keys, event_word(DEPTH_EVENT, F.col("is_bid")), "price", "qty", zero, line)
    deepest = rows.where("qty > 0").groupBy(*keys, "group", "is_bid").agg(F.min("price").alias("lo"), F.max("price").alias("hi"))
    reach = deepest.select(*keys, (F.col("group") + 1).alias("group"), "is_bid", F.col("lo").alias("rlo"), F.col("hi").alias("rhi"))
    own = levels.where("group > 1").groupBy(*keys, "group", "is_bid", "seq", "ts_event_ns", "ts_recv_ns").agg(F.min("price").alias("lo"), F.max("price").alias("hi"))
    clear = own.join(reach, [*keys, "group", "is_bid"], "left")
    px = F.when(F.col("is_bid"), F.least("lo", "rlo")).otherwise(F.greatest("hi", "rhi"))
    first = F.struct("seq", F.when(F.col("is_bid"), F.lit(-1)).otherwise(F.lit((1 << 40) - 1)).cast("long").alias("n")).alias("line")
    clear = _feed(clear, keys, event_word(DEPTH_CLEAR_EVENT, F.col("is_bid")), px, F.lit(0.0), zero, first)
    return initial, depth.unionByName(again).unionByName(clear)


def kind_rank(ev: Column | str = "ev") -> Column:
    """Trades, depth, clears, snapshots: the order of rows at one exchange time."""
    k = event_kind(ev)
    return F.when(k == TRADE_EVENT, 0).when(k == DEPTH_EVENT, 1).when(k == DEPTH_CLEAR_EVENT, 2).otherwise(3)


def ordered_feed(*parts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The feed, globally sorted by key, exchange time, kind, local time and line."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(*keys, "exch_ts", kind_rank(), "local_ts", "line")


def conservation_gap(counters: DataFrame) -> DataFrame:
    """counters with gap: unexplained snapshots, trades, deltas, levels. 0 means nothing was lost."""
    terms = [
        "n_snapshots_in - n_initial - n_skipped - n_resync", "n_trades_in - n_trade_rows - n_zero_trades", "n_deltas_in - n_delta_batches - n_empty_deltas - n_off_chain",
        "n_delta_levels - n_depth_rows", "n_initial_levels - n_initial_rows", "n_resync_levels - n_snapshot_rows",
    ]
    return counters.withColumn("gap", F.expr(" + ".join(f"abs({t})" for t in terms)))


def feed_counters(snapshots: DataFrame, deltas: DataFrame, trades: DataFrame, selected: DataFrame, kept: DataFrame, moves: DataFrame, initial: DataFrame, feed: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row per key of what went in, what came out and what was left out."""
    kinds = event_kind("ev")
    first = selected.groupBy(*keys).agg(
        F.count_if(F.col("is_snapshot") & (F.col("fate") == "periodic")).alias("n_skipped"), F.count_if(F.col("fate") == "off_chain").alias("n_off_chain"),
        F.count_if(F.col("is_snapshot") & (F.col("fate") == "kept")).alias("__kept"))
    parts = [
        snapshots.groupBy(*keys).agg(F.count("*").alias("n_snapshots_in")), deltas.groupBy(*keys).agg(F.count("*").alias("n_deltas_in")),
        trades.groupBy(*keys).agg(F.count("*").alias("n_trades_in"), F.count_if(F.col("qty") <= 0).alias("n_zero_trades")), first,
        moves.groupBy(*keys).agg(
            F.count_if(~F.col("is_snapshot")).alias("n_delta_levels"), F.count_if(F.col("is_snapshot") & (F.col("group") == 1) & (F.col("qty") > 0)).alias("n_initial_levels"),
            F.count_if(F.col("is_snapshot") & (F.col("group") > 1) & (F.col("qty") > 0)).alias("n_resync_levels"), F.count_distinct(F.when(~F.col("is_snapshot"), F.col("seq"))).alias("n_delta_batches")),
        kept.groupBy(*keys).agg(F.count_if(~F.col("is_snapshot")).alias("__deltas")), initial.groupBy(*keys).agg(F.count("*").alias("n_initial_rows")),
        feed.groupBy(*keys).agg(*(F.count_if(kinds == k).alias(n) for n, k in (("n_trade_rows", TRADE_EVENT), ("n_depth_rows", DEPTH_EVENT), ("n_clear_rows", DEPTH_CLEAR_EVENT), ("n_snapshot_rows", DEPTH_SNAPSHOT_EVENT)))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, list(keys), "full")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in out.columns if c not in keys})
    out = out.withColumns({"n_initial": F.least(F.lit(1), "__kept").cast("long"), "n_resync": F.greatest(F.lit(0), F.col("__kept") - 1).cast("long"), "n_empty_deltas": F.col("__deltas") - F.col("n_delta_batches")})
    return conservation_gap(out.drop("__kept", "__deltas"))


def maker_quotes(mid: Column | str, ofi: Column | str, best_bid: Column | str, best_ask: Column | str, tick: float, half_spread_ticks: int, threshold: float, skew_ticks: int = 1) -> Column:
    """struct(bid_ticks, ask_ticks) around the mid, both moved by the flow's sign where it exceeds
    the threshold, never through the other side's best; null where bid would meet ask."""
    m, e, b, a = (F.col(c) if isinstance(c, str) else c for c in (mid, ofi, best_bid, best_ask))
    centre = ticks(m, tick)
    shift = F.when(e > threshold, F.lit(skew_ticks)).when(e < -threshold, F.lit(-skew_ticks)).otherwise(F.lit(0))
    bid = F.least(centre + shift - half_spread_ticks, ticks(a, tick) - 1)
    ask = F.greatest(centre + shift + half_spread_ticks, ticks(b, tick) + 1)
    return F.when(bid < ask, F.struct(bid.alias("bid_ticks"), ask.alias("ask_ticks")))


def crossing_quotes(best_bid: Column | str, best_ask: Column | str, tick: float) -> Column:
    """Quotes that take: buy at the ask, sell at the bid."""
    return F.struct(ticks(best_ask, tick).alias("bid_ticks"), ticks(best_bid, tick).alias("ask_ticks"))


def order_life(targets: DataFrame, fills: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """What the quoting rule does to its orders: keys, seq, side, action (submit, cancel or fill), ticks and
    order_id, the number of the order on its side from 1.

    targets (keys, seq, bid_ticks, ask_ticks): at most one order a side is open. An order at the target
    stays; another one is cancelled, and a new one submitted in its place; a null target cancels. fills
    (keys, seq, side): the side's open order is filled before the target of that seq is seen, so an
    unchanged target is submitted again. Fills without an open order are left out.
    """
    side = lambda name, c: targets.select(*keys, "seq", F.lit(name).alias("side"), F.lit(1).alias("rank"), F.col(c).cast("long").alias("ticks"))
    rows = side("bid", "bid_ticks").unionByName(side("ask", "ask_ticks"))
    rows = rows.unionByName(fills.select(*keys, "seq", "side", F.lit(0).alias("rank"), F.lit(None).cast("long").alias("ticks")).distinct())
    order = Order((*keys, "side"), ("seq", "rank"), floor_div("seq", CHUNK))
    # A fill leaves nothing open, as a null target does, so what is open is what the row before left.
    rows = previous(rows, order, ["ticks"], "before").withColumn("open", F.col("before.ticks"))
    changed = ~F.col("ticks").eqNullSafe(F.col("open"))
    rows = rows.withColumns({"ends": F.col("open").isNotNull() & changed, "starts": F.col("ticks").isNotNull() & changed})
    rows = running_sum(rows, order, n=F.col("starts").cast("long"))
    act = lambda name, ticks, number: F.struct(F.lit(name).alias("action"), F.col(ticks).alias("ticks"), number.alias("order_id"))
    ended = F.when(F.col("rank") == 0, act("fill", "open", F.col("n"))).otherwise(act("cancel", "open", F.col("n") - F.col("starts").cast("long")))
    acts = F.array_compact(F.array(F.when(F.col("ends"), ended), F.when(F.col("starts"), act("submit", "ticks", F.col("n")))))
    return rows.select(*keys, "seq", "side", F.explode(acts).alias("x")).select(*keys, "seq", "side", "x.*")


def order_counts(life: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, n_submitted, n_canceled, n_filled and n_open, the orders that nothing has ended."""
    n = lambda a: F.count_if(F.col("action") == a)
    out = life.groupBy(*keys).agg(n("submit").alias("n_submitted"), n("cancel").alias("n_canceled"), n("fill").alias("n_filled"))
    return out.withColumn("n_open", F.col("n_submitted") - F.col("n_canceled") - F.col("n_filled"))


def checked_orders(orders: DataFrame) -> DataFrame:
    """Orders with `valid`: positive quantity, and a price where the type is limit."""
    return orders.withColumn("valid", F.coalesce((F.col("qty") > 0) & ((F.col("type") != "limit") | F.col("price").isNotNull()), F.lit(False)))


def harvest(fills: DataFrame) -> DataFrame:
    """One row per filled order, its first fill."""
    return fills.groupBy("order_id").agg(F.min_by(F.struct(*fills.columns), F.struct("ts", "fill_id")).alias("f")).select("f.*")


def positions(fills: DataFrame, keys: tuple[str, ...], chunks: int | None = None) -> DataFrame:
    """keys, qty, avg_px, realized: the position after all fills (ts, fill_id, sign, qty, price,
    fee) in order. Adding averages the price; reducing realises profit; turning round opens the
    rest at the fill's price; fees are taken off what is realised.

    Fills are cut by range of (keys, ts, fill_id) into `chunks` (shuffle partitions unless given), so
    one hot key is many tasks. Sums of the chunks before give the quantity that a chunk starts with.
    What it starts with of price and profit is open, but both stay linear in that price, so a chunk
    ends as four coefficients; a key's chunks are then composed in order. Quantities that doubles
    don't hold exactly may differ in their last bits from one long sum.
    """
    slim = fills.select(*keys, "ts", "fill_id", (F.col("sign") * F.col("qty")).cast("double").alias("q"), F.col("price").cast("double").alias("p"), F.coalesce(F.col("fee").cast("double"), F.lit(0.0)).alias("fee"))
    from ..sources.tape import written

    n = chunks or int(fills.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = written(slim.repartitionByRange(n, *keys, "ts", "fill_id").withColumn("__chunk", F.spark_partition_id()), "position-fills")
    ids = [*keys, "__chunk"]
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = slim.groupBy(*ids).agg(F.sum("q").alias("__q")).select(*ids, F.coalesce(F.sum("__q").over(before), F.lit(0.0)).alias("held"))
    order = [*ids, "ts", "fill_id"]
    same = [F.col(c).eqNullSafe(F.col(f"__s.{c}")) for c in ids]
    rows = slim.join(starts.select(F.struct(*ids).alias("__s"), "held"), reduce(Column.__and__, same))
    placed = rows.repartition(*ids).sortWithinPartitions(*order).select(*ids, "held", "q", "p", "fee")
    kinds = {f.name: f for f in placed.schema.fields}
    schema = T.StructType([*(kinds[k] for k in ids), *(T.StructField(c, T.DoubleType()) for c in ("qty", *LINEAR))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([] if at is None else [dict(zip(schema.names, (*at, *state), strict=True))], schema=arrow)

        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(len(ids) + 4)]
            for key, held, q, price, fee in zip(zip(*cols[: len(ids)], strict=True), *cols[len(ids) :], strict=True):
                if key != at:
                    yield closed()
                    at, state = key, (held, 1.0, 0.0, 0.0, 0.0)
                state = filled(state, q, price, fee)
        yield closed()

    ends = placed.mapInArrow(run, schema)
    # At most `chunks` rows a key.
    parts = ends.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__chunk", "qty", *LINEAR))).alias("parts"))
    step = lambda s, x: F.struct(
        x["qty"].alias("qty"), (x["avg_a"] * s["avg_px"] + x["avg_b"]).alias("avg_px"), (s["realized"] + x["gain_a"] * s["avg_px"] + x["gain_b"]).alias("realized"))
    start = F.struct(*(F.lit(0.0).alias(c) for c in ("qty", "avg_px", "realized")))
    return parts.select(*keys, F.aggregate("parts", start, step).alias("x")).select(*keys, "x.*")


#: After some fills the average price is avg_a * start + avg_b, and the profit since gain_a * start +
#: gain_b, where start is the average price before them.
LINEAR = ("avg_a", "avg_b", "gain_a", "gain_b")


def filled(state: tuple[float, ...], q: float, price: float, fee: float) -> tuple[float, ...]:
    """A position (quantity, then LINEAR) after a fill of signed quantity q."""
    qty, a, b, gain_a, gain_b = state
    left = qty + q
    if qty == 0 or (qty > 0) == (q > 0):
        if not left:
            return left, 0.0, 0.0, gain_a, gain_b - fee
        return left, abs(qty) * a / abs(left), (abs(qty) * b + abs(q) * price) / abs(left), gain_a, gain_b - fee
    closed = min(abs(qty), abs(q)) * (1 if qty > 0 else -1)
    gain_a, gain_b = gain_a - closed * a, gain_b + closed * (price - b) - fee
    if not left:
        return left, 0.0, 0.0, gain_a, gain_b
    return (left, a, b, gain_a, gain_b) if (left > 0) == (qty > 0) else (left, 0.0, price, gain_a, gain_b)


def unrealized(mark: Column | str) -> Column:
    return F.col("qty") * ((F.col(mark) if isinstance(mark, str) else mark) - F.col("avg_px"))


def replay_feed(snapshots: DataFrame, deltas: DataFrame, trades: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(initial rows, feed, counters) of a tape."""
    from ..sources.tape import written
    from .chain import kept_of, level_changes, selected

    chosen = selected(snapshots, deltas, keys)
    kept = written(kept_of(chosen, keys), "feed-kept")
    moves = written(level_changes(snapshots, deltas, kept, keys, *OF_HEADER), "feed-moves")
    initial, book_rows = level_rows(moves, keys)
    feed = ordered_feed(trade_rows(trades, keys), book_rows, keys=keys)
    return initial, feed, feed_counters(snapshots, deltas, trades, chosen, kept, moves, initial, feed, keys)
