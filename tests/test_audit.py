"""Probe audit and verdict goldens."""

from __future__ import annotations

from flowspark.operators import audit

from .conftest import rows
from .test_tape import K, LV, delta, frames, snap


def test_probe_audit(spark):
    s, d = frames(spark, [snap(100)], [delta(98, 105, 97, bids=[(100, 5)]), delta(106, 110, 105, bids=[(100, 7)], ts=2)])
    asks = [(101.0, 8.0), (102.0, 3.0)]
    book = lambda q: ([(100.0, q), (99.0, 5.0)], asks)
    probes = [("a", 0, 100, *book(10.0)), ("a", 1, 110, *book(7.0)), ("a", 2, 110, *book(999.0)), ("a", 3, 9999, *book(7.0)), ("a", 4, 50, *book(7.0)), ("a", 5, 108, *book(7.0))]
    p = spark.createDataFrame(probes, f"symbol string, probe long, rest_id long, bids {LV}, asks {LV}")
    got = rows(audit.audit_probes(s, d, p, K, 2).select("probe", "stale", "aligned_u", "batches", "mismatch_rate", "most", "verdict"))
    assert got[0] == (0, False, 100, 0, 0.0, 0.0, "ok") and got[1] == (1, False, 110, 2, 0.0, 0.0, "ok")
    assert got[2] == (2, False, 110, 2, 0.25, 992.0, "breach") and got[5] == (5, False, 110, 2, 0.0, 0.0, "ok")
    assert [r[-1] for r in got[3:5]] == ["stale", "stale"]
    assert audit.report(audit.audit_probes(s, d, p, K, 2).select("probe", "mismatch_rate").limit(1), "Probes").startswith("# Probes")


def test_verdicts(spark):
    base = {"error": None, "n_deltas": 5, "stale": False, "crossed": False, "compared": 40, "mismatches": 0, "worst": 0.0, "by_qty": True, "delta_ids": 0, "batches": 1, "gaps": 0, "resyncs": 0}
    cases = [({}, "PASS"), ({"error": "x"}, "ERROR"), ({"n_deltas": 0}, "INCONCLUSIVE"), ({"stale": True, "crossed": True}, "INCONCLUSIVE"), ({"crossed": True}, "FAIL"), ({"mismatches": 4}, "FAIL"), ({"worst": 0.6}, "FAIL"),
             ({"worst": 0.6, "by_qty": False}, "PASS"), ({"worst": 40_001.0, "by_qty": False}, "FAIL"), ({"delta_ids": -1}, "FAIL"), ({"batches": 2}, "FAIL"), ({"gaps": 1}, "FAIL"), ({"gaps": 1, "resyncs": 1}, "PASS")]
    schema = "error string, n_deltas int, stale boolean, crossed boolean, compared int, mismatches int, worst double, by_qty boolean, delta_ids long, batches int, gaps int, resyncs int"
    df = spark.createDataFrame([tuple((base | c).values()) for c, _ in cases], schema)
    assert [r[0] for r in df.select(audit.live_verdict()).collect()] == [w for _, w in cases]
