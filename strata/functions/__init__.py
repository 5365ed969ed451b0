"""Column functions."""

from strata.functions.columns import array_union, empty_array, generic_struct, nullable

__all__ = ["array_union", "empty_array", "generic_struct", "nullable"]
