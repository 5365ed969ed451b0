"""Comparison of schemas at the granularities of the join columns."""

from __future__ import annotations

import difflib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strata.diff.model import SchemaDiffResult
from strata.plans.paths import get_granularity, is_parent_field_of_any
from strata.plans.schema import Leaf, walk


def compared_fields(schema: T.StructType, join_cols: Sequence[str]) -> list[Leaf]:
    """Fields that are compared as values: those at a join column's granularity that no join column goes into."""
    levels = {get_granularity(c) for c in join_cols} or {""}
    return [
        leaf
        for leaf in walk(schema, inner=True)
        if get_granularity(leaf.name) in levels and not is_parent_field_of_any(leaf.name, join_cols) and not isinstance(leaf.type, T.StructType) and (not leaf.name.endswith("!") or leaf.name in join_cols)
    ]


def diff_column_names(left: Sequence[str], right: Sequence[str]) -> dict[str, str]:
    """All names, in the order in which a reader of both lists meets them."""
    out: dict[str, str] = {}
    theirs = set(right)
    waiting = [n for n in right if n not in set(left)]
    places = {n: k for k, n in enumerate(right)}
    for n in left:
        if n in theirs:
            while waiting and places[waiting[0]] < places[n]:
                out[waiting.pop(0)] = "+"
        out[n] = " " if n in theirs else "-"
    for n in waiting:
        out[n] = "+"
    return out


def diff_dataframe_schemas(left_df: DataFrame, right_df: DataFrame, join_cols: Sequence[str]) -> SchemaDiffResult:
    """Names and types, without nullability."""
    sides = [compared_fields(df.schema, join_cols) for df in (left_df, right_df)]
    lines = [[f"{leaf.name} {_type_text(leaf.type)}" for leaf in side] for side in sides]
    diff = list(difflib.unified_diff(*lines, n=10000))[2:]
    names = diff_column_names(*([leaf.name for leaf in side] for side in sides))
    return SchemaDiffResult(not diff, "\n".join(diff or lines[0]), len(left_df.columns), names)


def _type_text(t: T.DataType) -> str:
    """simpleString with type words in upper case and member names as they are."""
    if isinstance(t, T.StructType):
        return "STRUCT<" + ",".join(f"{f.name}:{_type_text(f.dataType)}" for f in t.fields) + ">"
    if isinstance(t, T.ArrayType):
        return f"ARRAY<{_type_text(t.elementType)}>"
    if isinstance(t, T.MapType):
        return f"MAP<{_type_text(t.keyType)},{_type_text(t.valueType)}>"
    return t.simpleString().upper()
