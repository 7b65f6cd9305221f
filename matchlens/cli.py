"""Command line: ``python -m matchlens report PATHS...`` and ``python -m matchlens ledger DIR --label L``."""

from __future__ import annotations

import argparse
import sys

from matchlens import schema as S
from matchlens.plans.ledger import append_checkpoint
from matchlens.plans.report import DEFAULT_OUT, console_summary, write_report


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="matchlens", description="Descriptive aggregation of matched-control evidence.")
    kinds = top.add_subparsers(dest="command", required=True)
    report = kinds.add_parser("report", help="read records and write a report")
    report.add_argument("paths", nargs="+", help="files, directories of .txt/.log/.csv files, or - for standard input")
    report.add_argument("--out", default=DEFAULT_OUT)
    report.add_argument("--arithmetic-tolerance", type=float, default=S.ARITHMETIC_TOLERANCE)
    report.add_argument("--sign-epsilon", type=float, default=S.SIGN_EPSILON)
    report.add_argument("--quiet", action="store_true")
    ledger = kinds.add_parser("ledger", help="append a completed report to a ledger")
    ledger.add_argument("report_dir")
    ledger.add_argument("--label", required=True)
    ledger.add_argument("--store", default="matchlens_ledger")
    return top


def run(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    if args.command == "ledger":
        done = append_checkpoint(args.report_dir, args.store, args.label)
        print(f"{done['status']}: {done['checkpoint']} ({done['count']} checkpoint(s) in history)")
        return 0
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("matchlens").getOrCreate()
    stdin = sys.stdin.buffer.read() if "-" in args.paths else b""
    results = write_report(spark, args.paths, args.out, args.arithmetic_tolerance, args.sign_epsilon, stdin)
    if not args.quiet:
        print(f"\n{console_summary(results, args.out)}")
    return 0
