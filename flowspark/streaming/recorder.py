"""Recording wire frames as a tape, and what watches over a running stream."""

from __future__ import annotations

import logging
import signal
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from ..sources import tape, wire

LOG = logging.getLogger("flowspark.streaming")


def run_folder(root: str, batch: int) -> str:
    return f"{root}/batch-{batch:012d}"


def write_batch(frames: DataFrame, root: str, exchange: str, batch: int, least_free: int = 0) -> None:
    """One micro-batch of frames (raw, ts_recv_ns and, for snapshot bodies, symbol) as a run of the
    tape: depth updates, prints and snapshots. The run is replaced if it is there, so a batch that
    is played again after a failure is stored once. Frames of no known kind are left out."""
    spark = frames.sparkSession
    at = run_folder(root, batch)
    tape.remove(spark, at)
    frames = tape.written(frames, "record-frames")
    parts = {
        "deltas": wire.depth_updates(frames, exchange), "trades": wire.prints(frames, exchange),
        "snapshots": wire.rest_snapshots(frames.where("symbol is not null"), exchange),
    }
    for kind, rows in parts.items():
        tape.write(rows, at, kind, exchange=exchange, least_free=least_free)


def record(frames: DataFrame, root: str, exchange: str, checkpoint: str, every: str | None = None, least_free: int = 0) -> StreamingQuery:
    """Frames as a stream -> a tape with one run for each micro-batch, flushed `every` interval, or
    all that is there now. Backpressure is the source's maxFilesPerTrigger or maxOffsetsPerTrigger."""
    writer = frames.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, n: write_batch(rows, root, exchange, n, least_free))
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


class Watchdog(StatefulProcessor):
    """A row for each time that a symbol's depth has been silent for `limit_ms` of processing time.
    Trades do not count as life."""

    SCHEMA = "symbol string, last_arrival_ms long, noticed_ms long"

    def __init__(self, limit_ms: int = 30_000):
        self.limit = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        depth = sum(int((df["kind"] == "depth").sum()) for df in rows)
        if depth:
            now = timerValues.getCurrentProcessingTimeInMs()
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(now + self.limit)
            self.seen.update((now,))
        yield pd.DataFrame({"symbol": pd.Series([], dtype="object"), "last_arrival_ms": pd.Series([], dtype="int64"), "noticed_ms": pd.Series([], dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        yield pd.DataFrame({"symbol": [key[0]], "last_arrival_ms": [int(self.seen.get()[0])], "noticed_ms": [int(now)]})

    def close(self) -> None:
        pass


def watched(stream: DataFrame, limit_ms: int = 30_000, key: str = "symbol") -> DataFrame:
    """Silences of a stream of (symbol, kind)."""
    dog = Watchdog(limit_ms)
    return stream.groupBy(key).transformWithStateInPandas(statefulProcessor=dog, outputStructType=dog.SCHEMA, outputMode="Append", timeMode="ProcessingTime")


LATENCY = "feed_latency"


def with_latency(stream: DataFrame) -> DataFrame:
    """The stream with its latency observed in every micro-batch, for LatencyLog."""
    late = F.col("ts_recv_ns") - F.col("ts_event_ns")
    return stream.observe(LATENCY, F.count(F.lit(1)).alias("n"), F.avg(late).alias("mean_ns"), F.percentile_approx(late, 0.99).alias("p99_ns"), F.max(late).alias("most_ns"))


class LatencyLog(StreamingQueryListener):
    """Logs the observed latency of each micro-batch that has rows; `last` keeps the latest."""

    last: dict | None = None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(LATENCY)
        if row is not None and row["n"]:
            self.last = row.asDict()
            LOG.info("latency of %s events: mean %.0f ns, p99 %s ns, most %s ns", row["n"], row["mean_ns"], row["p99_ns"], row["most_ns"])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def stop_on_signal(query: StreamingQuery, signals: tuple[int, ...] = (signal.SIGINT, signal.SIGTERM)) -> None:
    """The first signal lets the micro-batch at work end and stops the query; the next one does
    what it did before."""
    before = {s: signal.getsignal(s) for s in signals}

    def handler(number: int, frame) -> None:
        for s, old in before.items():
            signal.signal(s, old)
        LOG.warning("signal %d: stopping", number)
        query.stop()

    for s in signals:
        signal.signal(s, handler)


def frames_of(spark: SparkSession, path: str, files: int = 16) -> DataFrame:
    """Landed frames (JSON lines of raw, ts_recv_ns, symbol) as a bounded stream."""
    return spark.readStream.schema("raw string, ts_recv_ns long, symbol string").option("maxFilesPerTrigger", files).json(path)


BACKLOG = "frame_backlog"


def with_backlog(stream: DataFrame) -> DataFrame:
    """A stream of frame logs with its backlog observed in every micro-batch, for BacklogLog."""
    return stream.observe(BACKLOG, F.count(F.lit(1)).alias("n"), F.max("backlog").alias("backlog"), F.sum(F.octet_length("raw")).alias("bytes"))


class BacklogLog(StreamingQueryListener):
    """Follows how much waited in the logs: `high_water`, the most frames that were waiting when a
    batch was planned; `most`, the largest batch; `behind`, what the latest one left waiting."""

    high_water = most = behind = batches = 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(BACKLOG)
        if row is not None and row["n"]:
            self.batches += 1
            self.high_water, self.most, self.behind = max(self.high_water, row["backlog"]), max(self.most, row["n"]), row["backlog"] - row["n"]
            LOG.info("%d frames (%d bytes) taken, %d left waiting, high-water mark %d", row["n"], row["bytes"] or 0, self.behind, self.high_water)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
