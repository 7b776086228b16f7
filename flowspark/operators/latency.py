"""Latency reports: clock offsets, the audit of a probe run, feed counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tape import written
from . import quality

GAP_NS = 200_000_000
STATS = ("n", "least", "p50", "p90", "p99", "p99_9", "most", "mean")


def offset_summary(samples: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The distribution of local minus server time over clock samples (local_before_ns,
    server_time_ns, local_after_ns), with round trips and the offset at their midpoints. One row
    for each key; null where there are no samples."""
    rows = samples.withColumns({
        "__offset": F.col("local_after_ns") - F.col("server_time_ns"), "__rtt": F.col("local_after_ns") - F.col("local_before_ns"),
        "__mid": (F.col("local_before_ns") + F.col("local_after_ns")) / 2 - F.col("server_time_ns")})
    out = quality.distribution(rows, keys, "__offset").select(*keys, "n", *(F.col(c).alias(f"{c}_ns") for c in STATS[1:]))
    more = rows.groupBy(*keys).agg(F.avg("__rtt").alias("mean_rtt_ns"), F.max("__rtt").alias("max_rtt_ns"), F.avg("__mid").alias("mean_midpoint_offset_ns"))
    return out.join(more, list(keys)) if keys else out.crossJoin(more)  # one row each


def probe_audit(depth: DataFrame, trades: DataFrame, samples: DataFrame, keys: tuple[str, ...], order: str, gap_ns: int = GAP_NS) -> DataFrame:
    """keys, measure and its distribution: raw and adjusted latencies of depth and trades
    (ts_event_ns, ts_recv_ns), and inter-arrival times of depth on both clocks (ts_event_ns, and
    ts_mono_ns, a monotonic clock), in arrival `order`; n_over counts times over gap_ns. Latencies are
    adjusted by the mean offset of the clock samples (before, server, after)."""
    clock = samples.select((F.col("local_after_ns") - F.col("server_time_ns")).alias("offset_ns"))
    parts = []
    for kind, rows in (("depth", depth), ("trade", trades)):
        late = quality.latencies(rows, clock)
        parts += [late.select(*keys, F.lit(f"{kind}_{how}").alias("measure"), F.col(f"{how}_ns").alias("v")) for how in ("raw", "adjusted")]
    between = quality.previous(depth, quality.by_time(keys, order, order), ["ts_event_ns", "ts_mono_ns"]).where("prev is not null")
    parts += [between.select(*keys, F.lit(f"depth_interarrival_{n}").alias("measure"), (F.col(c) - F.col(f"prev.{c}")).alias("v")) for n, c in (("exchange", "ts_event_ns"), ("local", "ts_mono_ns"))]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = written(rows, "latency-rows")  # read by every step of the distribution
    wide = (*keys, "measure")
    over = rows.where(F.col("measure").startswith("depth_interarrival")).groupBy(*wide).agg(F.count_if(F.col("v") > gap_ns).alias("n_over"))
    return quality.distribution(rows, wide, "v").join(over, list(wide), "left")


def n_gaps_over(gap: Column | str, threshold: int) -> Column:
    """Aggregate: gaps over the threshold."""
    return F.count_if((F.col(gap) if isinstance(gap, str) else gap) > threshold)


def feed_stats(decisions: DataFrame, trades: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Counters of a synchronised feed (`decision` of every depth row) and the latency summary of
    its trades from counts per millisecond: one row for each key."""
    of = lambda d: F.count_if(F.col("decision") == d)
    counts = decisions.groupBy(*keys).agg(
        of("RESYNC").alias("gaps"), of("SNAPSHOT").alias("snapshots_applied"), of("APPLY").alias("deltas_applied"), of("DROP_STALE").alias("stale"), of("BUFFER").alias("held"), F.max("n_dropped").alias("dropped"))
    counts = counts.withColumn("resyncs", F.greatest(F.lit(0).cast("long"), F.col("snapshots_applied") - 1))
    late = trades.withColumn("__late", F.col("ts_recv_ns") - F.col("ts_event_ns"))
    summary = quality.bucketed_percentiles(late, keys, "__late", {"p50": 50.0, "p99": 99.0}).withColumnRenamed("n", "trades")
    return counts.join(summary, list(keys), "full").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("gaps", "resyncs", "snapshots_applied", "deltas_applied", "stale", "held", "dropped", "trades")})


def in_flight(queued: Column | str, applied: Column | str) -> Column:
    """Events applied in a window but not yet taken from the queue at its end."""
    q, a = (F.col(c) if isinstance(c, str) else c for c in (queued, applied))
    return F.greatest(F.lit(0).cast("long"), a - q)
