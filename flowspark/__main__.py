"""Reports on a tape: python -m flowspark REPORT ROOT [options]."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from .operators import audit, capture, validate
from .settings import Settings, configure_logging

REPORTS = ("stats", "gaps", "check", "ofi-validation", "mlofi-validation", "audit-probes")


def build(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    where = {"exchange": a.exchange, "symbol": a.symbol}
    if a.report == "stats":
        return capture.stats(spark, a.root, **where)
    if a.report == "gaps":
        return capture.gaps(spark, a.root, a.threshold_ns, **where)
    if a.report == "check":
        return capture.check(spark, a.root, **where)
    if a.report == "ofi-validation":
        return validate.ofi_validation(capture.book_states(spark, a.root, **where), capture.KEYS)
    if a.report == "mlofi-validation":
        return validate.mlofi_validation(capture.book_states(spark, a.root, a.levels, **where), capture.KEYS, levels=a.levels)
    return capture.audit_probes(spark, a.root, a.probes, a.exchange).drop("details")


def failed(report: str, rows: DataFrame) -> bool:
    """Whether a report says that the tape is not whole."""
    if report == "check":
        return bool(rows.where("not ok").take(1))
    return report == "audit-probes" and bool(capture.exit_code(rows))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="flowspark", description=__doc__)
    p.add_argument("report", choices=REPORTS)
    p.add_argument("root", nargs="?", default=Settings.of().data_dir)
    p.add_argument("--exchange")
    p.add_argument("--symbol")
    p.add_argument("--probes", help="sidecar of reference books, for audit-probes (with --exchange)")
    p.add_argument("--levels", type=int, default=10)
    p.add_argument("--threshold-ns", type=int, default=capture.GAP_NS)
    a = p.parse_args(argv)
    if a.report == "audit-probes" and not (a.probes and a.exchange):
        p.error("audit-probes needs --probes and --exchange")
    configure_logging(Settings.of())
    spark = spark or SparkSession.builder.appName("flowspark").getOrCreate()
    rows = build(spark, a)
    print(audit.report(rows, f"{a.report}: {a.root}"))
    return int(failed(a.report, rows))


if __name__ == "__main__":
    sys.exit(main())
