"""Comparison of two DataFrames."""

from strata.diff.compare import compare_dataframes
from strata.diff.model import DiffFormatOptions, DiffResultSummary, DiffStats, SchemaDiffResult
from strata.diff.result import DiffResult

__all__ = ["DiffFormatOptions", "DiffResult", "DiffResultSummary", "DiffStats", "SchemaDiffResult", "compare_dataframes"]
