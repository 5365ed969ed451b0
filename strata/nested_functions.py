"""Folds over repeated fields."""

from strata.functions.folds import aggregate, average, sum

__all__ = ["aggregate", "average", "sum"]
