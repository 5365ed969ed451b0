"""Transformations of whole DataFrames that follow the schema: rows stay where they are, nothing is shuffled."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.plans.compiler import rewrite_all
from strata.plans.paths import quote


def convert_all_maps_to_arrays(df: DataFrame) -> DataFrame:
    """Every map, at any depth, as an array of (key, value) structs."""
    return rewrite_all(df, lambda c, t: F.map_entries(c) if isinstance(t, T.MapType) else None)


def flatten_all_arrays(df: DataFrame) -> DataFrame:
    """Arrays of arrays as arrays, at any depth."""
    return rewrite_all(df, lambda c, t: F.flatten(c) if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.ArrayType) else None)


def sort_all_arrays(df: DataFrame) -> DataFrame:
    """Every array sorted, innermost first, NULL first. Elements that hold maps cannot be sorted."""
    return rewrite_all(df, lambda c, t: F.sort_array(c) if isinstance(t, T.ArrayType) else None)


def transform_all_fields(df: DataFrame, transformation: Callable[[Column, T.DataType], Column | None]) -> DataFrame:
    """Apply a function of (column, its type) to every field, inner ones first; None leaves a field as it is."""
    return rewrite_all(df, transformation)


def transform_all_field_names(df: DataFrame, transformation: Callable[[str], str]) -> DataFrame:
    """Rename all fields at any depth. A cast between structs goes by position, so one cast for each column does it."""

    def renamed(t: T.DataType) -> T.DataType:
        if isinstance(t, T.StructType):
            return T.StructType([T.StructField(transformation(f.name), renamed(f.dataType), f.nullable, f.metadata) for f in t.fields])
        if isinstance(t, T.ArrayType):
            return T.ArrayType(renamed(t.elementType), t.containsNull)
        if isinstance(t, T.MapType):
            return T.MapType(renamed(t.keyType), renamed(t.valueType), t.valueContainsNull)
        return t

    out = []
    for f in df.schema.fields:
        t = renamed(f.dataType)
        column = F.col(quote(f.name))
        out.append((column if t == f.dataType else column.cast(t)).alias(transformation(f.name)))
    return df.select(*out)


def flatten(df: DataFrame, struct_separator: str = ".") -> DataFrame:
    """Struct members as root columns, named by their path; arrays and maps stay whole."""

    def leaves(column: Column, t: T.DataType, name: str) -> list[Column]:
        if not isinstance(t, T.StructType):
            return [column.alias(name)]
        return [x for f in t.fields for x in leaves(column.getField(f.name), f.dataType, f"{name}{struct_separator}{f.name}")]

    return df.select(*(x for f in df.schema.fields for x in leaves(F.col(quote(f.name)), f.dataType, f.name)))


def unflatten(df: DataFrame, separator: str = ".") -> DataFrame:
    """Columns whose names share a beginning before the separator become structs; one whose members are all NULL is NULL.

    Structs that df already has are flattened first, so that they merge with such columns.
    """
    if any(isinstance(f.dataType, T.StructType) for f in df.schema.fields):
        df = flatten(df, separator)
    root: dict = {}
    for name in df.columns:
        at, parts = root, name.split(separator)
        for p in parts[:-1]:
            at = at.setdefault(p, {})
            if not isinstance(at, dict):
                raise ValueError(f"Column '{name}' goes inside a column that is no struct")
        at[parts[-1]] = F.col(quote(name))

    def built(node: dict | Column) -> tuple[Column, Column]:
        """The column, and whether it is NULL throughout."""
        if not isinstance(node, dict):
            return node, node.isNull()
        members = {k: built(v) for k, v in node.items()}
        empty = reduce(lambda a, b: a & b, (e for _, e in members.values()))
        return F.when(empty, F.lit(None)).otherwise(F.struct(*(c.alias(k) for k, (c, _) in members.items()))), empty

    return df.select(*(built(v)[0].alias(k) for k, v in root.items()))


def union_dataframes(*dfs: DataFrame) -> DataFrame:
    """UNION ALL by position of one or more DataFrames."""
    if not dfs:
        raise ValueError("input dfs cannot be empty")
    return reduce(DataFrame.union, dfs)


def unpivot(df: DataFrame, pivot_columns: list[str], key_alias: str = "key", value_alias: str = "value") -> DataFrame:
    """All other columns, which must have one type, as rows of (key, value); NULL values are kept."""
    melted = [f for f in df.schema.fields if f.name not in pivot_columns]
    assert len({f.dataType.simpleString() for f in melted}) <= 1, "All unpivoted columns must have the same type"
    if not melted:
        raise ValueError("There is no column to unpivot")
    return df.unpivot([F.col(quote(c)) for c in pivot_columns], [F.col(quote(f.name)) for f in melted], key_alias, value_alias)
