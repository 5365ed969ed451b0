"""Transformations of whole DataFrames."""

from strata.operators.generic import with_generic_typed_struct
from strata.operators.harmonize import harmonize_dataframes
from strata.operators.json_columns import parse_json_columns
from strata.operators.profile import analyze
from strata.operators.reshape import convert_all_maps_to_arrays, flatten, flatten_all_arrays, sort_all_arrays, transform_all_field_names, transform_all_fields, unflatten, union_dataframes, unpivot

__all__ = ["analyze", "convert_all_maps_to_arrays", "flatten", "flatten_all_arrays", "harmonize_dataframes", "parse_json_columns", "sort_all_arrays", "transform_all_field_names", "transform_all_fields", "unflatten", "union_dataframes", "unpivot", "with_generic_typed_struct"]
