"""What a user calls on the root of a tape: replayed states, flow and volume, statistics, checks.

A root holds one run or a folder for each; exchange and symbol, where given, prune partitions. All
results have the keys exchange and symbol, so one call covers every instrument of a tape.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tape
from . import audit, book, chain, convert, flow, quality, volume

KEYS = ("exchange", "symbol")
GAP_NS = 200_000_000


def _depth(spark: SparkSession, root: str, where: dict) -> tuple[DataFrame, DataFrame]:
    return tape.scan(spark, root, "snapshots", row_id=True, **where), tape.scan(spark, root, "deltas", row_id=True, **where)


def replayed(spark: SparkSession, root: str, **where: str | None) -> tuple[DataFrame, DataFrame]:
    """(kept headers, level changes) of the tape in replay order."""
    return chain.replay(*_depth(spark, root, where), KEYS)


def book_states(spark: SparkSession, root: str, levels: int | None = None, **where: str | None) -> DataFrame:
    """The top of the book, or its best `levels`, after every event of the replay."""
    kept, moves = replayed(spark, root, **where)
    return chain.states(kept, moves, KEYS) if levels is None else chain.level_states(kept, moves, KEYS, levels)


def ofi_events(spark: SparkSession, root: str, **where: str | None) -> DataFrame:
    """Book-event imbalance of the tape: keys, epoch, seq, ts_event_ns, e."""
    return flow.events(book_states(spark, root, **where), KEYS)


def mlofi_events(spark: SparkSession, root: str, levels: int = 5, **where: str | None) -> DataFrame:
    """The same at `levels` levels, e being an array."""
    return flow.events(book_states(spark, root, levels, **where), KEYS, levels)


def cvd(spark: SparkSession, root: str, **where: str | None) -> DataFrame:
    return volume.cvd(tape.scan(spark, root, "trades", **where), KEYS)


def vpin(spark: SparkSession, root: str, size: float, window: int, classification: str = "aggressor", sigma: float | None = None, **where: str | None) -> DataFrame:
    return volume.vpin(tape.scan(spark, root, "trades", **where), KEYS, size, window, classification, sigma)


def book_at_time(spark: SparkSession, root: str, ts: int, **where: str | None) -> tuple[DataFrame, DataFrame]:
    return chain.book_at_time(*_depth(spark, root, where), KEYS, ts)


def book_at_id(spark: SparkSession, root: str, rest_id: int, **where: str | None) -> tuple[DataFrame, DataFrame]:
    return chain.book_at_id(*_depth(spark, root, where), KEYS, rest_id)


def ops(spark: SparkSession, root: str, tick: float, **where: str | None) -> tuple[DataFrame, DataFrame]:
    """(book operations in replay order, trade prints with quantity): a clear and adds for every
    snapshot that the replay applies, updates and deletes for every delta."""
    snapshots, deltas = _depth(spark, root, where)
    kept = tape.written(chain.kept_headers(snapshots, deltas, KEYS), "ops-headers")
    own = kept.select(*KEYS, "row_id", "seq", F.col("ts_event_ns").alias("__event"), F.col("ts_recv_ns").alias("__recv"), "is_snapshot")
    met = lambda rows, is_snapshot: rows.join(own.where(F.col("is_snapshot") == is_snapshot), [*KEYS, "row_id"]).withColumns({"ts_event_ns": F.col("__event"), "ts_recv_ns": F.col("__recv")})
    keys = (*KEYS, "seq")
    rows = convert.snapshot_ops(met(snapshots, True), keys, tick).unionByName(convert.delta_ops(met(deltas, False), keys, tick))
    prints = tape.scan(spark, root, "trades", **where).where("qty > 0").select(*KEYS, "trade_id", "ts_event_ns", "ts_recv_ns", "price", "qty", F.when(F.col("aggressor_sign") > 0, "buy").otherwise("sell").alias("side"))
    return rows, prints


def stats(spark: SparkSession, root: str, threshold_ns: int = GAP_NS, **where: str | None) -> DataFrame:
    """Events, bytes, rates and silences of deltas: one row per instrument."""
    tables = {k: tape.scan(spark, root, k, **where) for k in tape.SCHEMAS}
    out = quality.capture_stats(tables, KEYS)
    for kind in tables:
        out = out.join(tape.stored_bytes(spark, root, kind, **where).withColumnRenamed("bytes", f"bytes_{kind}"), list(KEYS), "left")
    out = out.withColumns({f"bytes_{k}": F.coalesce(f"bytes_{k}", F.lit(0)).cast("long") for k in tables})
    out = out.withColumn("bytes_total", sum((F.col(f"bytes_{k}") for k in tables), F.lit(0).cast("long")))
    found = quality.gap_counts(tables["deltas"], KEYS, threshold_ns, "final_update_id")
    return out.join(found, list(KEYS), "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_event_gaps", "n_recv_gaps")})


def gaps(spark: SparkSession, root: str, threshold_ns: int = GAP_NS, **where: str | None) -> DataFrame:
    return quality.gaps(tape.scan(spark, root, "deltas", **where), KEYS, threshold_ns, "final_update_id")


def updates_per_second(spark: SparkSession, root: str, **where: str | None) -> DataFrame:
    return quality.updates_per_second(tape.scan(spark, root, "deltas", **where), KEYS)


def check(spark: SparkSession, root: str, **where: str | None) -> DataFrame:
    """The integrity summary; the tick comes from the tape's instrument.json, where it has one."""
    known = tape.instrument(spark, root)
    tick = None if known is None else float(known.first()["tick_size"])  # one row
    return quality.summary(*_depth(spark, root, where), tape.scan(spark, root, "trades", **where), KEYS, tick)


def audit_probes(spark: SparkSession, root: str, path: str, exchange: str, levels: int = 20, warn: float = 0.10) -> DataFrame:
    """A probe sidecar (a JSON line for each reference book) against the tape."""
    at = tape.probes(spark, path)
    rows = at.select(F.lit(exchange).alias("exchange"), "symbol", F.xxhash64("ts_local_ns", "last_update_id").alias("probe"), F.col("last_update_id").alias("rest_id"), "bids", "asks")
    return audit.audit_probes(*_depth(spark, root, {"exchange": exchange}), rows, KEYS, levels, warn)


def exit_code(verdicts: DataFrame) -> int:
    """1 if a probe is over its limit, else 0; stale probes are no breach."""
    return int(bool(verdicts.where("verdict = 'breach'").take(1)))


def _touch(levels: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    top = book.depth(levels, keys, 1)
    return top.select(*keys, *(book.padded(s, f, 1)[0].alias(n) for s, f, n in (("bids", "price", "bid_px"), ("bids", "qty", "bid_qty"), ("asks", "price", "ask_px"), ("asks", "qty", "ask_qty"))))


def same_touch(a: DataFrame, b: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, ok, crossed: whether two books (keys, side, price, qty) have equal best levels, and the
    first one is not crossed."""
    names = ["bid_px", "bid_qty", "ask_px", "ask_qty"]
    other = _touch(b, keys).select(*keys, *(F.col(n).alias(f"__{n}") for n in names))
    rows = _touch(a, keys).join(other, list(keys), "full")
    equal = F.lit(True)
    for n in names:
        equal = equal & F.col(n).eqNullSafe(F.col(f"__{n}"))
    return rows.select(*keys, (equal & ~book.crossed()).alias("ok"), book.crossed().alias("crossed"))


def mid_snapshot_check(spark: SparkSession, root: str, exchange: str, symbol: str) -> DataFrame:
    """The tape's book at the time of its middle snapshot against that snapshot: keys, ok, crossed,
    ts_event_ns; no row where there is no snapshot."""
    snapshots, deltas = _depth(spark, root, {"exchange": exchange, "symbol": symbol})
    n = snapshots.count()
    if not n:
        return spark.createDataFrame([], "exchange string, symbol string, ok boolean, crossed boolean, ts_event_ns long")
    ts = snapshots.select("ts_event_ns", "last_update_id").orderBy("ts_event_ns", "last_update_id").offset(n // 2).limit(1).first()["ts_event_ns"]
    nearest = snapshots.where(F.col("ts_event_ns") <= ts).orderBy(F.desc("ts_event_ns"), F.desc("last_update_id")).limit(1)
    rebuilt, _ = chain.book_at_time(snapshots, deltas, KEYS, ts)
    return same_touch(rebuilt, book.changes(nearest, KEYS).where("qty > 0"), KEYS).withColumn("ts_event_ns", F.lit(ts))


def end_check(spark: SparkSession, root: str, live: DataFrame, ts: int, **where: str | None) -> DataFrame:
    """The tape's book at ts against a live book (keys, side, price, qty): keys, ok, compared,
    mismatches of the five best levels of each side."""
    rebuilt, _ = book_at_time(spark, root, ts, **where)
    touch = same_touch(rebuilt, live, KEYS)
    met = quality.compare_top(rebuilt, live, KEYS, 5).select(*KEYS, "compared", "mismatches")
    return touch.join(met, list(KEYS), "left").withColumn("ok", F.col("ok") & (F.coalesce("mismatches", F.lit(1)) == 0))
