"""Folds over all elements of a repeated field, inside the row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.errors import AnalysisException
from strata.plans.compiler import as_column
from strata.plans.paths import EACH, Mark, Path, parse, quote
from strata.plans.schema import type_at


def _member(value: Column | DataFrame | None, names: Path) -> Column:
    column = F.col(quote(names[0])) if value is None or isinstance(value, DataFrame) else value.getField(names[0])
    for n in names[1:]:
        column = column.getField(n)
    return column


def aggregate(field_name: str, initial_value: str | Column, merge: Callable[[Column, Column], Column], start: Callable[[Column], Column] | None = None, finish: Callable[[Column], Column] | None = None, starting_level: Column | DataFrame | None = None) -> Column:
    """Fold all elements under a path, whatever its repetition levels.

    initial_value must be neutral for merge: it begins the fold of every inner array. start prepares each element, finish the
    result. starting_level is the enclosing element when the fold is used inside a nested projection. A NULL array or element
    makes the result NULL if merge does.
    """
    path = parse(field_name)
    if any(isinstance(s, Mark) and s is not EACH for s in path):
        raise AnalysisException(f"Field '{field_name}': maps cannot be folded")
    zero = as_column(initial_value)

    def fold(value: Column | DataFrame | None, rest: Path) -> Column:
        if EACH not in rest:
            leaf = _member(value, rest) if rest else value
            return start(leaf) if start else leaf
        k = rest.index(EACH)
        array = _member(value, rest[:k]) if k else value
        inner = rest[k + 1 :]
        elements = array if not inner and start is None else F.transform(array, lambda x: fold(x, inner))
        return F.aggregate(elements, zero, lambda acc, x: merge(acc, x))

    out = fold(starting_level, path)
    return F.aggregate(F.array(out), zero, lambda acc, x: merge(acc, x), finish) if finish else out


def _accumulator(field_name: str, level: Column | DataFrame | None) -> str:
    """bigint, unless the schema is at hand and says that elements are fractions."""
    t = type_at(level.schema, parse(field_name)) if isinstance(level, DataFrame) else None
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return "double"
    if isinstance(t, T.DecimalType):
        return T.DecimalType(min(38, t.precision + 10), t.scale).simpleString()
    return "bigint"


def sum(field_name: str, starting_level: Column | DataFrame | None = None) -> Column:
    """Sum of all elements under a path. Pass the DataFrame as starting_level to sum fractions."""
    t = _accumulator(field_name, starting_level)
    return aggregate(field_name, F.lit(0).cast(t), lambda acc, x: (acc + x).cast(t), starting_level=starting_level)


def average(field_name: str, starting_level: Column | DataFrame | None = None) -> Column:
    """Mean of all elements under a path, NULL without any."""
    t = _accumulator(field_name, starting_level)
    pair = lambda s, n: F.struct(s.cast(t).alias("sum"), n.cast("bigint").alias("count"))
    return aggregate(
        field_name,
        pair(F.lit(0), F.lit(0)),
        lambda acc, x: pair(acc["sum"] + x["sum"], acc["count"] + x["count"]),
        lambda x: pair(x, F.lit(1)),
        lambda acc: F.when(acc["count"] > 0, acc["sum"] / acc["count"]),
        starting_level,
    )
