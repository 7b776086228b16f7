"""Probe alignment of a whole tape, and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import following_min, running_max
from ..sources.tape import written
from .book import changes, live_levels
from .chain import by_id
from .quality import compare_top


def aligned(snapshots: DataFrame, deltas: DataFrame, probes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """probes (keys, probe, rest_id) with snap_id, the last stored snapshot id not above rest_id,
    and stop_id, the first stored final id not below it. Two ordered passes over ids only."""
    ids = [F.lit(None).cast("long").alias(c) for c in ("probe", "s", "d")]
    rank = lambda n: F.lit(n).alias("rank")  # noqa: E731  at one id: snapshots, probes, deltas
    rows = (
        snapshots.select(*keys, F.col("last_update_id").alias("id"), ids[0], F.col("last_update_id").alias("s"), ids[2], rank(0))
        .unionByName(deltas.select(*keys, F.col("final_update_id").alias("id"), ids[0], ids[1], F.col("final_update_id").alias("d"), rank(2)))
        .unionByName(probes.select(*keys, F.col("rest_id").alias("id"), F.col("probe").cast("long"), ids[1], ids[2], rank(1)))
    )
    order = by_id(keys, "id", "rank")
    rows = following_min(running_max(rows, order, snap_id=F.col("s")), order, stop_id=F.col("d"))
    return rows.where("probe is not null").select(*keys, "probe", F.col("id").alias("rest_id"), "snap_id", "stop_id")


def probe_books(snapshots: DataFrame, deltas: DataFrame, probes: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(levels, status) of the tape's book for every probe. A delta belongs to the last snapshot
    below its id, so probes meet deltas on that snapshot, not by a range; only the delta at which
    a probe stops may belong to a later one."""
    # Each of these is read by several steps, which would work it out anew.
    deltas = written(deltas.select(*keys, "first_update_id", "final_update_id", "prev_final_update_id", "bids", "asks"), "probe-deltas")
    at = written(aligned(snapshots, deltas, probes, keys), "probe-ids")
    marks = snapshots.select(*keys, F.col("last_update_id").alias("id"), F.lit(1).alias("late"), F.col("last_update_id").alias("s"))
    rows = marks.unionByName(deltas.withColumns({"id": F.col("final_update_id"), "late": F.lit(0), "s": F.lit(None).cast("long")}), allowMissingColumns=True)
    owned = written(running_max(rows, by_id(keys, "id", "late"), segment=F.col("s")).where("late = 0").drop("id", "late", "s"), "probe-owned")
    wanted = at.where("snap_id is not null and stop_id is not null and snap_id <> rest_id")
    own = owned.join(wanted.withColumnRenamed("snap_id", "segment"), [*keys, "segment"]).where("final_update_id <= stop_id").withColumn("snap_id", F.col("segment"))
    last = owned.join(wanted.withColumnRenamed("stop_id", "final_update_id"), [*keys, "final_update_id"]).where("segment <> snap_id").withColumn("stop_id", F.col("final_update_id"))
    used = own.unionByName(last.select(*own.columns))
    w = Window.partitionBy(*keys, "probe").orderBy("final_update_id")
    used = used.withColumns({"seq": F.row_number().over(w).cast("long"), "before": F.coalesce(F.lag("final_update_id").over(w), F.col("snap_id"))})
    gap = (F.col("prev_final_update_id") != F.col("before")) & ~((F.col("seq") == 1) & (F.col("first_update_id") <= F.col("snap_id")) & (F.col("snap_id") <= F.col("final_update_id")))
    counted = used.groupBy(*keys, "probe").agg(F.count("*").alias("batches"), F.count_if(gap).alias("gaps"))
    newest = snapshots.groupBy(*keys, F.col("last_update_id").alias("snap_id")).agg(F.max_by(F.struct("bids", "asks"), "ts_event_ns").alias("b"))
    start = at.join(newest, [*keys, "snap_id"]).select(*keys, "probe", F.lit(0).cast("long").alias("seq"), "b.bids", "b.asks")
    moves = changes(start.unionByName(used.select(*keys, "probe", "seq", "bids", "asks")), (*keys, "probe"), "seq")
    status = at.join(counted, [*keys, "probe"], "left").withColumns({
        "aligned_u": F.when(F.col("snap_id") == F.col("rest_id"), F.col("rest_id")).otherwise(F.col("stop_id")), "batches": F.coalesce("batches", F.lit(0)).cast("long"),
        "stale": F.col("snap_id").isNull() | (F.col("stop_id").isNull() & (F.col("snap_id") != F.col("rest_id"))) | (F.coalesce("gaps", F.lit(0)) > 0)})
    return live_levels(moves, (*keys, "probe")), status


def audit_probes(snapshots: DataFrame, deltas: DataFrame, probes: DataFrame, keys: tuple[str, ...], levels: int, warn: float = 0.10) -> DataFrame:
    """One row per probe (keys, probe, rest_id, bids, asks): where it aligned, how its best levels
    compare with the tape's, and a verdict: stale, breach or ok."""
    local, status = probe_books(snapshots, deltas, probes, keys)
    ids = (*keys, "probe")
    rest = changes(probes, ids).drop("pos")
    met = compare_top(local, rest, ids, levels)
    return _verdicts(status.select(*ids, "rest_id", "stale", "aligned_u", "batches").join(met, list(ids), "left"), warn)


def _verdicts(out: DataFrame, warn: float) -> DataFrame:
    rate = F.when(F.col("compared") > 0, F.col("mismatches") / F.col("compared")).otherwise(1.0)
    out = out.withColumns({"delta_ids": F.col("aligned_u") - F.col("rest_id"), "mismatch_rate": F.when(~F.col("stale"), rate)})
    return out.withColumn("verdict", F.when(F.col("stale"), "stale").when(F.col("mismatch_rate") > warn, "breach").otherwise("ok"))


def audit_aligned(rows: DataFrame, keys: tuple[str, ...], levels: int, warn: float = 0.10) -> DataFrame:
    """The same verdicts for probes that a stream has aligned: rows (keys, probe, rest_id, aligned_u,
    stale, batches, bids, asks, rest_bids, rest_asks). A stale probe has no book to compare."""
    ids = (*keys, "probe")
    rest = rows.where("not stale").select(*ids, F.col("rest_bids").alias("bids"), F.col("rest_asks").alias("asks"))
    met = compare_top(changes(rows, ids).drop("pos"), changes(rest, ids).drop("pos"), ids, levels)
    return _verdicts(rows.select(*ids, "rest_id", "stale", "aligned_u", "batches").join(met, list(ids), "left"), warn)


#: Fixed limits of the live check.
WARN_RATE, MOST_QTY, MOST_NOTIONAL, MOST_SLACK = 0.10, 0.5, 40_000.0, 1


def live_verdict() -> Column:
    """ERROR, INCONCLUSIVE, FAIL or PASS, in this order of tests, of a row with error, n_deltas,
    stale, crossed, compared, mismatches, worst (the largest difference, in quantity for a symbol
    checked by quantity, else in notional), by_qty, delta_ids, batches, gaps and resyncs."""
    rate = F.when(F.col("compared") > 0, F.col("mismatches") / F.col("compared")).otherwise(1.0)
    over = F.col("worst") > F.when(F.col("by_qty"), F.lit(MOST_QTY)).otherwise(F.lit(MOST_NOTIONAL))
    slack = F.col("delta_ids").isNull() | (F.col("delta_ids") < 0) | (F.col("batches") > MOST_SLACK)
    return (
        F.when(F.col("error").isNotNull(), "ERROR").when(F.col("n_deltas") < 1, "INCONCLUSIVE").when(F.col("stale"), "INCONCLUSIVE").when(F.col("crossed"), "FAIL")
        .when(rate >= WARN_RATE, "FAIL").when(F.coalesce(over, F.lit(False)), "FAIL").when(slack, "FAIL").when(F.col("gaps") != F.col("resyncs"), "FAIL").otherwise("PASS")
    )


def report(rows: DataFrame, title: str) -> str:
    """A small summary frame as a Markdown table; nulls and NaN as dashes."""
    import math

    said = lambda v: "-" if v is None or (isinstance(v, float) and math.isnan(v)) else str(v)
    head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns)
    return "\n".join([f"# {title}", "", head, *("| " + " | ".join(map(said, r)) + " |" for r in rows.collect())]) + "\n"
