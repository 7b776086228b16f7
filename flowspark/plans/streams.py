"""Queries over frames that arrive through logs: the merged source, and books kept on its stream.

The derived deltas and snapshots are written as wire frames into one log a socket, and every query
runs over several micro-batches of the merged stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit
from ..sources import frame_log, tape, wire
from ..streaming import books, processors
from . import views as V
from .queries import E_SQL, query
from .replays import PROBES_SQL, REPLAY_SQL
from .views import DELTAS_SQL

BATCHES = 5
#: Text of a batch, if the tables are large: a batch has costs of its own, a symbol's rows of it are in one task's memory.
BATCH_BYTES = 256 << 20
SYMBOLS = ("B0", "B1", "B2", "B3")
TICK_MS = 60_000
#: Event times of frames are this much later than the tables', as a watermark takes rows at the epoch for late.
LATER = TICK_MS * 1_000_000


def _pairs(levels: str) -> Column:
    return F.transform(levels, lambda x: F.array(x["price"].cast("string"), x["qty"].cast("string")))


def _delta_frames(deltas: DataFrame, *more: Column) -> DataFrame:
    body = F.struct(
        F.lit("depthUpdate").alias("e"), F.expr(f"(ts_event_ns + {LATER}) div 1000000").alias("E"), F.lower("symbol").alias("s"), F.col("first_update_id").alias("U"),
        F.col("final_update_id").alias("u"), F.col("prev_final_update_id").alias("pu"), _pairs("bids").alias("b"), _pairs("asks").alias("a"))
    return deltas.select("ts_recv_ns", F.lit(None).cast("string").alias("symbol"), F.to_json(body).alias("raw"), *more)


def _snapshot_frames(snapshots: DataFrame) -> DataFrame:
    body = F.struct(F.expr(f"(ts_event_ns + {LATER}) div 1000000").alias("E"), F.col("last_update_id").alias("lastUpdateId"), _pairs("bids").alias("bids"), _pairs("asks").alias("asks"))
    return snapshots.select("ts_recv_ns", "symbol", F.to_json(body).alias("raw"))


def _segment_rows(n: int) -> int:
    """Rows of a segment of a log of n frames: small logs have several segments, large ones not so many
    that listing them for every batch counts."""
    return min(16_384, max(2_000, n // 256))


def _merged(spark: SparkSession, logs: dict[str, DataFrame], checkpoint: str) -> DataFrame:
    """Frames of each socket as a log of several segments, and their merged stream. A log is sorted by
    range, which reads its frames twice, so frames that are costly to derive are written before."""
    root, n = tape.work_path(spark, "logs"), 0
    for socket, frames in logs.items():
        rows = frames.count()
        frame_log.land(frames, root, socket, _segment_rows(rows))
        n += rows
    return frame_log.stream(spark, root, checkpoint, max_rows=n // BATCHES + 1, max_bytes=BATCH_BYTES)


def _depth_sockets(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Frames of the deltas on two sockets, derived once and written."""
    deltas = V.deltas(spark, d)
    frames = tape.written(_delta_frames(deltas, F.when(F.col("symbol") == "B3", "depth-2").otherwise("depth-1").alias("socket")), "frames")
    return {s: frames.where(F.col("socket") == s).drop("socket") for s in ("depth-1", "depth-2")}


def _book_logs(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Two depth sockets, the second with one symbol of four, and one of snapshots."""
    return _depth_sockets(spark, d) | {"rest": _snapshot_frames(V.snapshots(spark, d))}


def _drained(spark: SparkSession, rows: DataFrame, checkpoint: str) -> DataFrame:
    return processors.drained(rows, tape.work_path(spark, "stream"), checkpoint, at_once=False, keys=SYMBOLS)


@query(f"""WITH {DELTAS_SQL}, x AS (SELECT CASE WHEN symbol = 'B3' THEN 'depth-2' ELSE 'depth-1' END AS socket, ts_recv_ns FROM d)
    SELECT row_number() OVER (ORDER BY ts_recv_ns, socket) - 1 AS arrival, socket, row_number() OVER (PARTITION BY socket ORDER BY ts_recv_ns) - 1 AS place, ts_recv_ns, true AS in_limit FROM x""")
def stream_frame_log(spark: SparkSession, d: str) -> DataFrame:
    """Two sockets, one three times as fast as the other, as one stream by time of receipt, in batches
    under the limit: a batch's frames waited together, so they have one backlog."""
    checkpoint = tape.work_path(spark, "stream-state")
    rows = _drained(spark, _merged(spark, _depth_sockets(spark, d), checkpoint), checkpoint)
    sizes = rows.groupBy("backlog").agg(F.count("*").alias("n"))
    most = rows.count() // BATCHES + 1
    return rows.join(sizes, "backlog").select("arrival", "socket", "place", "ts_recv_ns", (F.col("n") <= most).alias("in_limit"))


@query(f"""WITH {REPLAY_SQL}, p AS (SELECT *, lag(epoch) OVER w AS pe, lag(bid_px) OVER w AS pb, lag(bid_qty) OVER w AS pbq, lag(ask_px) OVER w AS pa, lag(ask_qty) OVER w AS paq FROM st WINDOW w AS (PARTITION BY symbol ORDER BY seq))
    SELECT p.symbol, k * 10 + 9 AS final_update_id, {E_SQL} AS e FROM p JOIN kp ON kp.symbol = p.symbol AND kp.seq = p.seq WHERE pe = epoch""")
def stream_frames_to_ofi(spark: SparkSession, d: str) -> DataFrame:
    """Frames to imbalance in one streaming query: a synchronised book feeds the imbalance."""
    checkpoint = tape.work_path(spark, "stream-state")
    events = wire.book_events(_merged(spark, _book_logs(spark, d), checkpoint), "arrival")
    rows = processors.stateful(processors.stateful(events, books.BookStates()), processors.Ofi())
    return _drained(spark, rows, checkpoint).select("symbol", F.expr("seq div 2").alias("final_update_id"), "e")


@query(f"""WITH {REPLAY_SQL}, b AS (SELECT symbol, k, seq, fate, max(t0) OVER (PARTITION BY symbol ORDER BY seq) AS t0 FROM rp WHERE fate <> 'periodic'),
    e AS (SELECT symbol, min(t0) FILTER (fate = 'kept') AS first_ns, max(t0) AS last_ns FROM b GROUP BY 1), w AS (SELECT max(last_ns) // 1000000 - 1000 AS mark FROM e),
    tk AS (SELECT symbol, unnest(range((first_ns + {TICK_MS * 1_000_000 - 1}) // {TICK_MS * 1_000_000}, greatest(mark // {TICK_MS}, (last_ns - 1) // {TICK_MS * 1_000_000}) + 1)) * {TICK_MS} AS tick_ms FROM e, w),
    pt AS (SELECT tk.symbol, tick_ms, arg_max(b.seq, b.seq) AS seq, arg_max(fate, b.seq) AS fate, arg_max(k, b.seq) AS k FROM tk JOIN b ON b.symbol = tk.symbol AND b.t0 <= tick_ms * 1000000 GROUP BY 1, 2)
    SELECT pt.symbol, tick_ms, pt.k * 10 + 9 AS last_update_id, side, price, qty FROM pt JOIN lv ON lv.symbol = pt.symbol AND lv.seq = pt.seq WHERE fate = 'kept'""")
def stream_book_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """The whole book of each symbol once a minute of event time, by timers, in blocks of 16 levels."""
    checkpoint = tape.work_path(spark, "stream-state")
    events = wire.book_events(_merged(spark, _book_logs(spark, d), checkpoint), "arrival")
    rows = _drained(spark, books.timed(events, books.BookSnapshots(TICK_MS, block=16), "1 second"), checkpoint)
    return rows.select("symbol", "tick_ms", "last_update_id", "side", F.explode("levels").alias("x")).select("symbol", (F.col("tick_ms") - TICK_MS).alias("tick_ms"), "last_update_id", "side", "x.price", "x.qty")


@query(f"""WITH {PROBES_SQL}, v AS (SELECT pn.*, pc.compared, pc.mismatches, pc.most, sk IS NULL OR broken AS stale FROM pn JOIN pc ON pc.k = pn.k)
    SELECT symbol, k AS probe, k * 10 + 6 AS rest_id, stale, CASE WHEN NOT stale THEN k * 10 + 9 END AS aligned_u, CASE WHEN NOT stale THEN compared END AS compared, CASE WHEN NOT stale THEN mismatches END AS mismatches,
      CASE WHEN NOT stale THEN mismatches / compared END AS mismatch_rate, CASE WHEN stale THEN 'stale' WHEN mismatches / compared > 0.1 THEN 'breach' ELSE 'ok' END AS verdict FROM v""")
def stream_probe_align(spark: SparkSession, d: str) -> DataFrame:
    """Probes frozen and aligned on the stream: the verdicts of `probe_audit`. Sockets are read in the
    order of ids here, as times of receipt stand for them."""
    s, checkpoint = V.snapshots(spark, d), tape.work_path(spark, "stream-state")
    probes = s.withColumns({"last_update_id": F.col("last_update_id") - 3, "ts_recv_ns": F.col("last_update_id") * 10 - 29})
    logs = {
        "depth": tape.written(_delta_frames(V.deltas(spark, d).withColumn("ts_recv_ns", F.col("final_update_id") * 10 + 2)), "frames"), "probes": _snapshot_frames(probes),
        "rest": _snapshot_frames(s.withColumn("ts_recv_ns", F.col("last_update_id") * 10)),
    }
    events = wire.book_events(_merged(spark, logs, checkpoint), "arrival", "socket")
    events = events.withColumn("probe", F.when(F.col("socket") == "probes", F.expr("(final_update_id + 3) div 10"))).drop("socket")
    rows = _drained(spark, books.timed(events, books.ProbeAlign(20, 60_000), "60 seconds"), checkpoint)
    return audit.audit_aligned(rows, V.KEYS, 20).select("symbol", "probe", "rest_id", "stale", "aligned_u", "compared", "mismatches", "mismatch_rate", "verdict")
