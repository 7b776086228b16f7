"""The price-level book from absolute level changes, relationally.

Changes are rows of (keys, group, seq, pos, side, price, qty): after `seq` the level at `price`
has `qty`, none if 0. `group` is the ordinal of the snapshot that a change belongs to; the book
starts empty in each group, and groups are independent of each other.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import floor_div


def changes(rows: DataFrame, keys: tuple[str, ...], *more: str) -> DataFrame:
    """Rows with arrays bids and asks of struct(price, qty) -> one row per level change."""
    side = lambda name, levels: F.transform(F.col(levels), lambda x, i: F.struct(F.lit(name).alias("side"), i.alias("pos"), x["price"].alias("price"), x["qty"].alias("qty")))
    both = F.concat(F.coalesce(side("bid", "bids"), F.array()), F.coalesce(side("ask", "asks"), F.array()))
    return rows.select(*keys, *more, F.explode(both).alias("x")).select(*keys, *more, "x.side", "x.pos", "x.price", "x.qty")


def live_levels(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, side, price, qty of the levels after all the given changes: the last one per price."""
    last = rows.groupBy(*keys, "side", "price").agg(F.max_by("qty", F.struct("seq", "pos")).alias("qty"))
    return last.where("qty > 0")


def sorted_side(side: str, n: int | None = None) -> Column:
    """Aggregate over live levels: a side's levels as an array from the best price on."""
    level = F.collect_list(F.when(F.col("side") == side, F.struct("price", "qty")))
    out = F.sort_array(level, asc=side == "ask")
    return out if n is None else F.slice(out, 1, n)


def depth(levels: DataFrame, keys: tuple[str, ...], n: int | None = None) -> DataFrame:
    """keys, bids, asks: the best n levels of both sides. Only n levels of a side are gathered."""
    if n is not None:
        if n < 1:
            raise ValueError("n must be >= 1")
        w = Window.partitionBy(*keys, "side").orderBy(F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price")))
        levels = levels.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")
    return levels.groupBy(*keys).agg(sorted_side("bid").alias("bids"), sorted_side("ask").alias("asks"))


def padded(levels: Column | str, field: str, n: int) -> Column:
    """n prices or quantities of a sorted side, null where there is no level."""
    c = F.col(levels) if isinstance(levels, str) else levels
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(c, i)[field])


def level_at(levels: Column | str, n: int) -> Column:
    """The n-th level from 1, null where there is none."""
    return F.get(F.col(levels) if isinstance(levels, str) else levels, F.lit(n - 1))


#: Sequence numbers of one sweep: a book is walked in pieces of this length, each from its live levels.
CHUNK = 4096


def seeds(rows: DataFrame, marked: DataFrame, keys: tuple[str, ...], chunk: int) -> DataFrame:
    """The levels that are live where each chunk of `marked` (keys, group, __c) begins. Changes are first
    summed up by price and chunk, so what is spread over chunks is levels, not events."""
    ids = [*keys, "group", "side", "price"]
    last = rows.withColumn("__c", floor_div("seq", chunk)).groupBy(*ids, "__c").agg(F.max_by("qty", F.struct("seq", "pos")).alias("qty"))
    ends = marked.groupBy(*keys, "group").agg(F.max("__c").alias("__end"))
    later = F.lead("__c").over(Window.partitionBy(*ids).orderBy("__c"))
    live = last.withColumn("__next", later).where("qty > 0").join(ends, [*keys, "group"])
    upto = F.least(F.coalesce("__next", "__end"), "__end")
    live = live.withColumn("__c", F.explode(F.when(upto > F.col("__c"), F.sequence(F.col("__c") + 1, upto)))).drop("__next", "__end")
    return live.join(marked, [*keys, "group", "__c"], "left_semi")


def swept(rows: DataFrame, at: DataFrame, keys: tuple[str, ...], m: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """keys, group, seq, bids, asks: the best m levels of both sides (all, if None) at every (keys, group,
    seq) of `at`.

    A chunk is one stretch of a task: it starts with the levels that are live there and takes the
    changes in order. Prices of a side are kept sorted, so a state costs what it shows and a change
    what it moves, whatever the depth; no symbol or snapshot group is a task of its own.
    """
    c = floor_div("seq", chunk).alias("__c")
    marks = at.select(*keys, "group", "seq", c)
    marked = marks.drop("seq").distinct()
    moves = rows.select(*keys, "group", "seq", c, "pos", (F.col("side") == "bid").alias("is_bid"), "price", "qty")
    moves = moves.join(marked, [*keys, "group", "__c"], "left_semi")
    start = seeds(rows, marked, keys, chunk).withColumns({"seq": F.lit(-(1 << 62)).cast("long"), "is_bid": F.col("side") == "bid"}).drop("side")
    kind = lambda df, n: df.withColumn("kind", F.lit(n))
    every = kind(moves, 1).unionByName(kind(start, 0), allowMissingColumns=True).unionByName(kind(marks, 2), allowMissingColumns=True)
    ids = [*keys, "group"]
    every = every.repartition(*ids, "__c").sortWithinPartitions(*ids, "__c", "seq", "kind", "pos").select(*ids, "__c", "seq", "kind", "is_bid", "price", "qty")
    kinds = dict(rows.dtypes)
    levels = "array<struct<price: double, qty: double>>"
    return every.mapInArrow(_sweep(len(ids), m), ", ".join(f"{k} {kinds[k]}" for k in ids) + f", seq long, bids {levels}, asks {levels}")


def _sweep(n_ids: int, m: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, prices, qtys = None, ([], []), ({}, {})
        for batch in batches:
            ids = list(zip(*(batch.column(i).to_pylist() for i in range(n_ids + 1)), strict=True))
            kind, seq = batch.column(n_ids + 2).to_pylist(), batch.column(n_ids + 1)
            shown, sizes, flat = [], ([], []), (([], []), ([], []))
            for i, (key, k, is_bid, price, qty) in enumerate(zip(ids, kind, *(batch.column(n_ids + j).to_pylist() for j in (3, 4, 5)), strict=True)):
                if key != now:
                    now, prices, qtys = key, ([], []), ({}, {})
                if k == 2:
                    shown.append(i)
                    best = (prices[0][: None if m is None else -m - 1 : -1], prices[1][:m])
                    for side, levels in enumerate(best):
                        sizes[side].append(len(levels))
                        flat[side][0].extend(levels)
                        flat[side][1].extend(map(qtys[side].__getitem__, levels))
                    continue
                order, known = prices[not is_bid], qtys[not is_bid]
                if qty > 0:
                    if price not in known:
                        insort(order, price)
                    known[price] = qty
                elif price in known:
                    del known[price], order[bisect_left(order, price)]
            if shown:
                at = pa.array(shown)
                sides = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.StructArray.from_arrays([pa.array(p, pa.float64()), pa.array(q, pa.float64())], ["price", "qty"])) for n, (p, q) in zip(sizes, flat, strict=True)]
                names = [*batch.schema.names[:n_ids], "seq", "bids", "asks"]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(n_ids)), seq.take(at), *sides], names)

    return run


def best_at(rows: DataFrame, at: DataFrame, keys: tuple[str, ...], chunk: int = CHUNK) -> DataFrame:
    """keys, group, seq, bid_px, bid_qty, ask_px, ask_qty at every (keys, group, seq) of `at` at which
    the book has a level."""
    touch = swept(rows, at, keys, 1, chunk).where(F.size("bids") + F.size("asks") > 0)
    of = lambda side, field, name: F.get(side, F.lit(0))[field].alias(name)
    return touch.select(*keys, "group", "seq", of("bids", "price", "bid_px"), of("bids", "qty", "bid_qty"), of("asks", "price", "ask_px"), of("asks", "qty", "ask_qty"))


def valid_top() -> Column:
    """Both sides present, with quantity."""
    return F.coalesce((F.col("bid_qty") > 0) & (F.col("ask_qty") > 0) & F.col("bid_px").isNotNull() & F.col("ask_px").isNotNull(), F.lit(False))


def crossed() -> Column:
    return F.coalesce(F.col("bid_px") >= F.col("ask_px"), F.lit(False))
