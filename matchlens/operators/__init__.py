"""DataFrame to DataFrame operators: parse, dedupe, validate, derive, summarize, pivot, audit."""

from matchlens.operators.audit import audit, eligible, integrity
from matchlens.operators.dedupe import dedupe_snapshots
from matchlens.operators.matrix import market_cell_matrices
from matchlens.operators.parse import parse_records
from matchlens.operators.summarize import class_direction, market_facts, summarize, summarize_all, summarize_union, weighted_means
from matchlens.operators.validate import derive, validate

__all__ = [
    "audit", "class_direction", "dedupe_snapshots", "derive", "eligible", "integrity", "market_cell_matrices", "market_facts",
    "parse_records", "summarize", "summarize_all", "summarize_union", "validate", "weighted_means",
]
