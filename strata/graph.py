"""Graph algorithms."""

from strata.operators.hierarchy import ascending_forest_traversal

__all__ = ["ascending_forest_traversal"]
