"""Statistics for `transformations.analyze`: functions of (column, its field, its number)."""

from strata.operators.profile import column_name, column_number, column_type, count, count_distinct, count_null, max, min

__all__ = ["column_name", "column_number", "column_type", "count", "count_distinct", "count_null", "max", "min"]
