"""Exceptions of the library."""

from __future__ import annotations


class IllegalArgumentException(ValueError):
    """An argument has a value that the function cannot take."""


class AnalysisException(Exception):
    """A query cannot be resolved against the schema of its input."""


class SparkSessionNotStarted(Exception):
    """A SparkSession is needed and none is active."""

    def __init__(self) -> None:
        super().__init__("SparkSession must be started first")


class FileAlreadyExistsError(FileExistsError):
    """A file exists that must not be overwritten."""


class DataframeComparisonException(Exception):
    """Two DataFrames cannot be compared."""


class CombinatorialExplosionError(DataframeComparisonException):
    """The columns of a join identify rows so badly that the join would explode."""
