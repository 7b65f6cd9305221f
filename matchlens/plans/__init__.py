"""Whole runs: text to report, report to ledger, and driver tables as record inputs."""

from matchlens.plans.ledger import append_checkpoint
from matchlens.plans.report import process, write_report

__all__ = ["append_checkpoint", "process", "write_report"]
