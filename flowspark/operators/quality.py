"""Integrity, capture statistics, gaps, latency distributions and probe comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import Order, previous
from ..functions.scalars import NS_PER_MS, NS_PER_S, floor_div
from ..sources.tape import written
from .chain import audit

GRID_TOLERANCE = 1e-6
QTY_TOLERANCE = 1e-9
DETAILS = 20
CHUNK_NS = 3_600_000_000_000


def crossed_snapshots() -> Column:
    """Whether a snapshot's highest bid reaches its lowest ask; only prices are read."""
    return F.coalesce(F.array_max(F.transform("bids", lambda x: x["price"])) >= F.array_min(F.transform("asks", lambda x: x["price"])), F.lit(False))


def off_grid(price: Column | str, tick: float) -> Column:
    x = (F.col(price) if isinstance(price, str) else price) / F.lit(float(tick))
    return F.abs(x - F.rint(x)) > GRID_TOLERANCE


def all_prices(snapshots: DataFrame, deltas: DataFrame, trades: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, price of every level and trade."""
    levels = [t.select(*keys, F.explode(F.transform(s, lambda x: x["price"])).alias("price")) for t in (snapshots, deltas) for s in ("bids", "asks")]
    out = trades.select(*keys, "price")
    for x in levels:
        out = out.unionByName(x)
    return out.where("price is not null")


def summary(snapshots: DataFrame, deltas: DataFrame, trades: DataFrame, keys: tuple[str, ...], tick: float | None = None) -> DataFrame:
    """One row per key: counters, issues, warnings and ok."""
    parts = [
        snapshots.groupBy(*keys).agg(F.count("*").alias("n_snapshots"), F.count_if(crossed_snapshots()).alias("n_crossed")),
        deltas.groupBy(*keys).agg(F.count("*").alias("n_deltas")),
        trades.groupBy(*keys).agg(F.count("*").alias("n_trades"), (F.count("*") - F.count_distinct("trade_id")).alias("n_duplicate_ids"), F.count_if(F.col("qty") <= 0).alias("n_zero_qty")),
        audit(deltas, snapshots, keys).withColumnsRenamed({"epochs": "n_epochs", "breaks": "n_breaks"}),
    ]
    if tick is not None:
        parts.append(all_prices(snapshots, deltas, trades, keys).groupBy(*keys).agg(F.count_if(off_grid("price", tick)).alias("n_off_grid")))
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, list(keys), "full")
    counts = [c for c in out.columns if c.startswith("n_")]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in counts})
    if tick is None:
        out = out.withColumn("n_off_grid", F.lit(None).cast("long"))
    said = lambda c, text: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(text)))
    issues = F.array_compact(F.array(said("n_breaks", " chain break(s)"), said("n_crossed", " crossed snapshot(s)"), said("n_duplicate_ids", " duplicate trade id(s)"), said("n_off_grid", " price(s) off the tick grid")))
    warnings = F.array_compact(F.array(said("n_zero_qty", " trade(s) without quantity"), F.when(F.col("n_off_grid").isNull(), F.lit("no instrument: tick grid not checked"))))
    return out.withColumns({"issues": issues, "warnings": warnings}).withColumn("ok", F.size("issues") == 0)


def capture_stats(tables: dict[str, DataFrame], keys: tuple[str, ...]) -> DataFrame:
    """keys, n_<kind> for every table, first and last event, duration_s and rates per second.
    Only keys and times are read."""
    rows = None
    for kind, t in tables.items():
        part = t.select(*keys, "ts_event_ns", F.lit(kind).alias("kind"))
        rows = part if rows is None else rows.unionByName(part)
    out = rows.groupBy(*keys).agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in tables), F.min("ts_event_ns").alias("first_ns"), F.max("ts_event_ns").alias("last_ns"))
    out = out.withColumn("duration_s", (F.col("last_ns") - F.col("first_ns")) / NS_PER_S)
    return out.withColumns({f"{k}_per_s": F.when(F.col("duration_s") > 0, F.col(f"n_{k}") / F.col("duration_s")).otherwise(0.0) for k in tables})


def by_time(keys: tuple[str, ...], ts: str, id_col: str) -> Order:
    return Order.of_time(keys, (ts, id_col), ts, CHUNK_NS)


def gaps(rows: DataFrame, keys: tuple[str, ...], threshold_ns: int, id_col: str) -> DataFrame:
    """keys, clock, start_ns, end_ns, gap_ns of silences over the threshold, on both clocks, both
    in the order of event time."""
    clocks = (("event", "ts_event_ns"), ("recv", "ts_recv_ns"))
    rows = previous(rows.select(*keys, id_col, "ts_event_ns", "ts_recv_ns"), by_time(keys, "ts_event_ns", id_col), ["ts_event_ns", "ts_recv_ns"])
    each = F.array(*(F.struct(F.lit(n).alias("clock"), F.col(f"prev.{c}").alias("start_ns"), F.col(c).alias("end_ns")) for n, c in clocks))
    rows = rows.select(*keys, F.explode(each).alias("g")).select(*keys, "g.*")
    return rows.withColumn("gap_ns", F.col("end_ns") - F.col("start_ns")).where(F.col("gap_ns") > threshold_ns)


def gap_counts(rows: DataFrame, keys: tuple[str, ...], threshold_ns: int, id_col: str) -> DataFrame:
    """keys, n_event_gaps, n_recv_gaps: silences over the threshold on each clock."""
    found = gaps(rows, keys, threshold_ns, id_col).groupBy(*keys).agg(*(F.count_if(F.col("clock") == c).alias(f"n_{c}_gaps") for c in ("event", "recv")))
    every = rows.select(*keys).distinct().join(found, list(keys), "left")
    return every.select(*keys, *(F.coalesce(f"n_{c}_gaps", F.lit(0)).cast("long").alias(f"n_{c}_gaps") for c in ("event", "recv")))


def updates_per_second(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return rows.groupBy(*keys, floor_div("ts_event_ns", NS_PER_S).alias("second")).agg(F.count("*").alias("updates"))


def histogram_summary(hist: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return hist.groupBy(*keys).agg(F.min("updates").alias("least"), F.percentile("updates", F.lit(0.5)).alias("median"), F.max("updates").alias("most"), F.avg("updates").alias("mean"))


def inter_arrival(rows: DataFrame, keys: tuple[str, ...], ts: str, id_col: str) -> DataFrame:
    rows = previous(rows, by_time(keys, ts, id_col), [ts], "__earlier")
    return rows.withColumn("gap_ns", F.col(ts) - F.col(f"__earlier.{ts}")).drop("__earlier").where("gap_ns is not null")


PERCENTS = {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p99_9": 0.999}
#: Ranks of the sketch are off by a part of 1 / SKETCH of all rows at most.
SKETCH = 10_000


def distribution(rows: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """n, least, p50, p90, p99, p99_9, most, mean: exact percentiles with linear interpolation.

    A sketch of bounded size brackets each percentile; only values between the brackets, some
    6 / SKETCH of all, are then counted one by one, and the rows below them in one number. The brackets
    (a row for each key) go to all tasks, so rows are counted where they lie: a key is no task of its own."""
    each = list(PERCENTS.values())
    around = [min(1.0, max(0.0, p + d / SKETCH)) for p in each for d in (-3, 3)]
    rows = rows.select(*keys, F.col(value).alias("__v")).where("__v is not null")
    base = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("__v").alias("least"), F.max("__v").alias("most"), F.avg("__v").alias("mean"), F.percentile_approx("__v", around, SKETCH).alias("__q"))
    base = written(base, "distribution")  # read by every step below
    met = lambda a, b, how="inner": a.join(b, list(keys), how) if keys else a.join(b, F.lit(True), how)  # noqa: E731  one row without keys
    # A key of few rows is counted whole: there, a neighbour in rank is farther than the brackets.
    few = F.col("n") <= SKETCH
    wide = met(rows, F.broadcast(base.select(*keys, few.alias("__few"), F.col("least").alias("__least"), F.col("most").alias("__most"), "__q")))
    at = lambda i: (F.when(F.col("__few"), F.col("__least")).otherwise(F.get("__q", i * 2)), F.when(F.col("__few"), F.col("__most")).otherwise(F.get("__q", i * 2 + 1)))
    below = wide.groupBy(*keys).agg(F.array(*(F.count_if(F.col("__v") < at(F.lit(i))[0]) for i in range(len(each)))).alias("__below"))
    between = F.array(*(F.when((F.col("__v") >= at(F.lit(i))[0]) & (F.col("__v") <= at(F.lit(i))[1]), F.lit(i)) for i in range(len(each))))
    counts = wide.select(*keys, "__v", F.explode(between).alias("__i")).where("__i is not null").groupBy(*keys, "__i", "__v").agg(F.count("*").alias("__c"))
    upto = Window.partitionBy(*keys, "__i").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = met(met(counts, below), base.select(*keys, "n")).withColumn("__rank", F.sum("__c").over(upto) + F.get("__below", F.col("__i")))
    position = (F.col("n") - 1) * F.get(F.array(*map(F.lit, each)), F.col("__i"))
    reached = lambda p: F.min(F.when(F.col("__rank") > p, F.col("__v").cast("double")))
    found = ranked.withColumn("__p", position).groupBy(*keys, "__i", "__p").agg(reached(F.floor("__p")).alias("__a"), reached(F.ceil("__p")).alias("__b"))
    part = F.col("__p") - F.floor("__p")
    exact = found.withColumn("__x", F.col("__a") * (1 - part) + F.col("__b") * part)
    exact = exact.groupBy(*keys).agg(*(F.max(F.when(F.col("__i") == i, F.col("__x"))).alias(name) for i, name in enumerate(PERCENTS)))
    return met(base.drop("__q"), exact, "left").select(*keys, "n", "least", *PERCENTS, "most", "mean")


def bucketed_percentiles(rows: DataFrame, keys: tuple[str, ...], latency_ns: str, percents: dict[str, float], limit_ms: int = 60_000) -> DataFrame:
    """Percentiles from counts per millisecond within +-limit: memory does not grow with rows.
    A percentile is its bucket's middle, held to the exact extremes."""
    ms = F.least(F.lit(limit_ms), F.greatest(F.lit(-limit_ms), floor_div(latency_ns, NS_PER_MS)))
    counts = rows.groupBy(*keys, ms.alias("ms")).agg(F.count("*").alias("n"), F.min(latency_ns).alias("lo"), F.max(latency_ns).alias("hi"), F.sum(latency_ns).alias("sum"))
    w = Window.partitionBy(*keys)
    upto = w.orderBy("ms").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumns({"cum": F.sum("n").over(upto), "total": F.sum("n").over(w)})
    at = {n: F.min(F.when(F.col("cum") > p / 100.0 * (F.col("total") - 1), F.col("ms"))) for n, p in percents.items()}
    out = counts.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("lo").alias("least"), F.max("hi").alias("most"), (F.sum("sum") / F.sum("n")).alias("mean"), *(e.alias(f"__{n}") for n, e in at.items()))
    clamp = lambda n: F.least("most", F.greatest("least", F.col(f"__{n}") * NS_PER_MS + NS_PER_MS // 2))
    return out.select(*keys, "n", "least", "most", "mean", *(clamp(n).alias(n) for n in percents))


def compare_top(local: DataFrame, rest: DataFrame, keys: tuple[str, ...], n: int) -> DataFrame:
    """keys, compared, mismatches, most, details: the reference book's best n levels of each side
    against the local book's best n. A price that the local side lacks counts with its whole
    quantity. Both are (keys, side, price, qty)."""
    w = Window.partitionBy(*keys, "side").orderBy(F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price")))
    top = lambda t: t.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    met = top(rest).join(top(local).select(*keys, "side", "price", F.col("qty").alias("local_qty")), [*keys, "side", "price"], "left")
    met = met.withColumn("diff", F.abs(F.col("qty") - F.coalesce("local_qty", F.lit(0.0))))
    bad = F.col("local_qty").isNull() | (F.col("diff") > QTY_TOLERANCE)
    detail = F.struct((F.col("side") == "ask").alias("is_ask"), "rank", "price", "qty", F.coalesce("local_qty", F.lit(0.0)).alias("local_qty"))
    return met.groupBy(*keys).agg(
        F.count("*").alias("compared"), F.count_if(bad).alias("mismatches"), F.coalesce(F.max(F.when(bad, F.col("diff"))), F.lit(0.0)).alias("most"),
        F.slice(F.sort_array(F.collect_list(F.when(bad, detail))), 1, DETAILS).alias("details"))  # at most 2 n rows a key


def sequence_gaps(frames: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """keys, n_frames, n_gaps: frames, in arrival order (a time in ns), that do not continue the one before."""
    rows = previous(frames, by_time(keys, order, "final_update_id"), ["final_update_id"])
    return rows.groupBy(*keys).agg(F.count("*").alias("n_frames"), F.count_if(F.col("prev_final_update_id") != F.col("prev.final_update_id")).alias("n_gaps"))


def latencies(rows: DataFrame, clock: DataFrame) -> DataFrame:
    """rows with raw_ns and adjusted_ns, the latter by the mean clock offset (one broadcast row)."""
    offset = clock.agg(F.rint(F.avg("offset_ns")).cast("long").alias("__offset"))
    raw = F.col("ts_recv_ns") - F.col("ts_event_ns")
    return rows.crossJoin(F.broadcast(offset)).withColumns({"raw_ns": raw, "adjusted_ns": raw - F.coalesce("__offset", F.lit(0))}).drop("__offset")
