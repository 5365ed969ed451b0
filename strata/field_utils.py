"""Tests on written field paths."""

from strata.plans.paths import (
    get_granularity,
    has_same_granularity,
    has_same_granularity_as_any,
    has_same_or_higher_granularity,
    is_parent_field,
    is_parent_field_of_any,
    is_sub_field,
    is_sub_field_of_any,
    is_sub_field_or_equal,
    is_sub_field_or_equal_to_any,
    substring_before_last_occurrence,
)

__all__ = ["get_granularity", "has_same_granularity", "has_same_granularity_as_any", "has_same_or_higher_granularity", "is_parent_field", "is_parent_field_of_any", "is_sub_field", "is_sub_field_of_any", "is_sub_field_or_equal", "is_sub_field_or_equal_to_any", "substring_before_last_occurrence"]
