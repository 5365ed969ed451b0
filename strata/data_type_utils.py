"""Questions about schemas and types."""

from __future__ import annotations

from pyspark.sql import types as T

from strata.plans.schema import common_fields, common_type, flatten_schema


def is_repeated(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.ArrayType)


def is_struct(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.StructType)


def is_nullable(field: T.StructField) -> bool:
    return field.nullable


def find_wider_type_for_two(t1: T.DataType, t2: T.DataType) -> str | None:
    """Simple name of the narrowest type that both widen to, None if there is none."""
    t = common_type(t1, t2)
    return t.simpleString() if t is not None else None


def find_common_type_for_fields(left_field: T.StructField, right_field: T.StructField) -> str | None:
    """Simple name of the type both fields widen to; None if they agree already, or if only one of them repeats."""
    if left_field.dataType == right_field.dataType or is_repeated(left_field) != is_repeated(right_field):
        return None
    return find_wider_type_for_two(left_field.dataType, right_field.dataType)


def get_common_columns(left_schema: T.StructType, right_schema: T.StructType) -> dict[str, str | None]:
    """Common fields in left order, each with its widened type, or None where nothing has to change."""
    return common_fields(left_schema, right_schema)


__all__ = ["find_common_type_for_fields", "find_wider_type_for_two", "flatten_schema", "get_common_columns", "is_nullable", "is_repeated", "is_struct"]
