"""Exceptions of the library."""

from strata.errors import AnalysisException, CombinatorialExplosionError, DataframeComparisonException, FileAlreadyExistsError, IllegalArgumentException, SparkSessionNotStarted

__all__ = ["AnalysisException", "CombinatorialExplosionError", "DataframeComparisonException", "FileAlreadyExistsError", "IllegalArgumentException", "SparkSessionNotStarted"]
