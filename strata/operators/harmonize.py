"""Two DataFrames brought to one schema."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from strata.operators.projection import select
from strata.operators.reshape import convert_all_maps_to_arrays
from strata.plans.paths import EACH, granularity_of, parse
from strata.plans.schema import common_fields, walk


def harmonize_dataframes(left_df: DataFrame, right_df: DataFrame, common_columns: Mapping[str, str | None] | None = None, keep_missing_columns: bool = False) -> tuple[DataFrame, DataFrame]:
    """Both DataFrames with their common fields in left order, each cast to its common type; maps become arrays of entries.

    common_columns: fields and types in place of those found (None: as is). keep_missing_columns: each side's own fields follow.
    """
    left_df, right_df = convert_all_maps_to_arrays(left_df), convert_all_maps_to_arrays(right_df)
    common = dict(common_columns) if common_columns is not None else common_fields(left_df.schema, right_df.schema)

    def shaped(df: DataFrame, other: DataFrame) -> DataFrame:
        wanted: dict = {name: None if t is None else _cast(name, t) for name, t in common.items()}
        if keep_missing_columns:
            theirs = {leaf.name for leaf in walk(other.schema)}
            wanted |= {leaf.name: None for leaf in walk(df.schema) if leaf.name not in theirs and leaf.name not in wanted}
        return select(df, wanted)

    return shaped(left_df, right_df), shaped(right_df, left_df)


def _cast(name: str, t: str):
    path = parse(name)
    rest = path[len(granularity_of(path)) :]
    target = T.DataType.fromDDL(t)

    def cast(level: DataFrame | Column) -> Column:
        column: Column | DataFrame = level
        for member in rest:
            column = column[member] if isinstance(column, DataFrame) else column.getField(member)
        return column.cast(target)

    assert EACH not in rest
    return cast
