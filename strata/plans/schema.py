"""Walks over schemas, common types, and schema text."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import types as T

from strata.plans.paths import EACH, KEY, VALUE, Path, text


@dataclass(frozen=True)
class Leaf:
    path: Path
    type: T.DataType
    nullable: bool

    @property
    def name(self) -> str:
        return text(self.path)

    @property
    def field(self) -> T.StructField:
        return T.StructField(self.name, self.type, self.nullable)


def walk(schema: T.StructType, explode: bool = True, inner: bool = False) -> Iterator[Leaf]:
    """Leaves in order. explode: go into arrays and maps; inner: give each prefix of a leaf (once) in place of nothing."""

    def go(path: Path, t: T.DataType, nullable: bool) -> Iterator[Leaf]:
        if isinstance(t, T.StructType):
            if inner and path:
                yield Leaf(path, t, nullable)
            for f in t.fields:
                yield from go((*path, f.name), f.dataType, nullable or f.nullable)
        elif explode and isinstance(t, T.ArrayType):
            if inner:
                yield Leaf(path, t, nullable)
            yield from go((*path, EACH), t.elementType, nullable or t.containsNull)
        elif explode and isinstance(t, T.MapType):
            if inner:
                yield Leaf(path, t, nullable)
            yield from go((*path, KEY), t.keyType, nullable)
            yield from go((*path, VALUE), t.valueType, nullable or t.valueContainsNull)
        else:
            yield Leaf(path, t, nullable)

    return go((), schema, False)


def flatten_schema(schema: T.StructType, explode: bool = True, keep_non_leaf_fields: bool = False) -> T.StructType:
    """A flat schema whose names are field paths; nullability comes down from parents."""
    return T.StructType([leaf.field for leaf in walk(schema, explode, keep_non_leaf_fields)])


def flat_schema_string(schema: T.StructType) -> str:
    lines = [f" |-- {leaf.name}: {leaf.type.typeName()} (nullable = {str(leaf.nullable).lower()})" for leaf in walk(schema)]
    return "\n".join(["root", *lines]) + "\n"


def type_at(schema: T.DataType, path: Path) -> T.DataType | None:
    """Type of a field, None if there is no such field."""
    t: T.DataType = schema
    for s in path:
        if s is EACH and isinstance(t, T.ArrayType):
            t = t.elementType
        elif s is KEY and isinstance(t, T.MapType):
            t = t.keyType
        elif s is VALUE and isinstance(t, T.MapType):
            t = t.valueType
        elif isinstance(s, str) and isinstance(t, T.StructType) and s in t.names:
            t = t[s].dataType
        else:
            return None
    return t


# --- common types ----------------------------------------------------------

_RANK = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]
_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 20}


def common_type(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The narrowest type that both widen to; a number and a string meet in string, as before ANSI rules."""
    if a == b:
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(b, T.NullType):
        return a
    for x, y in ((a, b), (b, a)):
        if type(x) in _RANK:
            if type(y) in _RANK:
                return max(x, y, key=lambda t: _RANK.index(type(t)))
            if isinstance(y, (T.FloatType, T.DoubleType)):
                return y
            if isinstance(y, T.DecimalType):
                return _decimals(T.DecimalType(_DIGITS[type(x)], 0), y)
        if isinstance(x, T.FloatType) and isinstance(y, T.DoubleType):
            return y
        if isinstance(x, T.DecimalType) and isinstance(y, (T.FloatType, T.DoubleType)):
            return T.DoubleType()
        if isinstance(x, T.DateType) and isinstance(y, (T.TimestampType, T.TimestampNTZType)):
            return y
        if isinstance(x, T.TimestampNTZType) and isinstance(y, T.TimestampType):
            return y
        if isinstance(x, T.StringType) and isinstance(y, T.AtomicType) and not isinstance(y, (T.BooleanType, T.BinaryType)):
            return T.StringType()
    if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
        return _decimals(a, b)
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        t = common_type(a.elementType, b.elementType)
        return t and T.ArrayType(t, a.containsNull or b.containsNull)
    return None


def _decimals(a: T.DecimalType, b: T.DecimalType) -> T.DecimalType:
    scale = max(a.scale, b.scale)
    digits = max(a.precision - a.scale, b.precision - b.scale) + scale
    return T.DecimalType(min(38, digits), min(38, scale))


def common_fields(left: T.StructType, right: T.StructType) -> dict[str, str | None]:
    """Common leaf fields in left order, each with its widened type, or None where nothing has to change (or nothing can)."""
    theirs = {leaf.name: leaf for leaf in walk(right)}
    out: dict[str, str | None] = {}
    for leaf in walk(left):
        other = theirs.get(leaf.name)
        if other is not None:
            t = None if leaf.type == other.type else common_type(leaf.type, other.type)
            out[leaf.name] = t.simpleString() if t is not None else None
    return out


# --- schemas as text -------------------------------------------------------


def schema_from_json(value: str) -> T.StructType:
    return T.StructType.fromJson(json.loads(value))


def schema_from_simple_string(value: str) -> T.DataType:
    return T.DataType.fromDDL(value)


def schema_to_json(schema: T.StructType) -> str:
    return schema.json()


def schema_to_pretty_json(schema: T.StructType) -> str:
    return json.dumps(schema.jsonValue(), indent=2, sort_keys=True)


def schema_to_simple_string(schema: T.StructType) -> str:
    return schema.simpleString()
