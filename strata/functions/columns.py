"""Functions that build columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.errors import IllegalArgumentException
from strata.plans.compiler import as_column
from strata.plans.paths import quote_idempotent


def array_union(*cols: str | Column) -> Column:
    """Distinct elements of all arrays. With one array, that array as it is."""
    if not cols:
        raise IllegalArgumentException("At least one array is needed")
    columns = [as_column(c) for c in cols]
    return columns[0] if len(columns) == 1 else F.array_distinct(F.concat(*columns))


def empty_array(element_type: T.DataType | str) -> Column:
    """An empty array of the given element type."""
    t = T.DataType.fromDDL(element_type) if isinstance(element_type, str) else element_type
    return F.array().cast(T.ArrayType(t))


def generic_struct(*columns: str, col_name_alias: str = "name", col_value_alias: str = "value") -> Column:
    """Named columns as ARRAY<STRUCT<name, value>> of strings."""
    return F.array(*(F.struct(F.lit(c).alias(col_name_alias), F.col(quote_idempotent(c)).cast("string").alias(col_value_alias)) for c in columns))


def nullable(col: Column) -> Column:
    """The same column, nullable."""
    return F.when(col.isNotNull(), col)
