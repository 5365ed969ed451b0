"""Structs of any shape in one generic, typed shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.errors import AnalysisException
from strata.plans.paths import quote, split_col_name

#: Members of the generic value and their types, by name.
VALUE_TYPES = {"boolean": "boolean", "bytes": "binary", "date": "date", "float": "double", "int": "bigint", "string": "string", "timestamp": "timestamp"}


def _member_of(t: T.DataType) -> str | None:
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, T.BinaryType):
        return "bytes"
    if isinstance(t, T.DateType):
        return "date"
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(t, T.IntegralType):
        return "int"
    if isinstance(t, T.StringType):
        return "string"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    return None


def with_generic_typed_struct(df: DataFrame, col_names: list[str]) -> DataFrame:
    """Struct columns as ARRAY<STRUCT<key, type, value>>, where value has a member for each kind of type.

    Members of unsupported types are left out, with a warning on the console. A struct inside a struct becomes a root column
    named by its path.
    """
    out = df
    for written in col_names:
        parts = [written] if written in df.columns else split_col_name(written)
        t: T.DataType = df.schema
        for p in parts:
            if not isinstance(t, T.StructType) or p not in t.names:
                raise AnalysisException(f"Column '{written}' does not exist")
            t = t[p].dataType
        if not isinstance(t, T.StructType):
            raise AnalysisException(f"Column '{written}' is no struct")
        column = F.col(".".join(map(quote, parts)))
        items: list[Column] = []
        for f in t.fields:
            member = _member_of(f.dataType)
            if member is None:
                print(f"WARNING: The field {f.name} of {written} has the unsupported type {f.dataType.simpleString()} and is left out.")
                continue
            value = F.struct(*((column.getField(f.name) if k == member else F.lit(None)).cast(v).alias(k) for k, v in VALUE_TYPES.items()))
            items.append(F.struct(F.lit(f.name).alias("key"), F.lit(f.dataType.simpleString()).alias("type"), value.alias("value")))
        out = out.withColumn(".".join(parts), F.array(*items))
    return out
