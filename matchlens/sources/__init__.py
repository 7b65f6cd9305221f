"""Inputs: log text as record blocks, completed reports, ledgers."""

from matchlens.sources.ingest import blocks_from_text, file_hashes, list_inputs, read_blocks

__all__ = ["blocks_from_text", "file_hashes", "list_inputs", "read_blocks"]
