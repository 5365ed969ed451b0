"""Compiles a mapping of field paths to transformations into columns, directed by the schema.

Each level of the result is rebuilt by its data type: structs with `struct`, arrays with `transform`, maps with `transform_keys` and
`transform_values`. Parts that no transformation touches pass as they are. A struct that is NULL stays NULL.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.errors import AnalysisException
from strata.plans.paths import EACH, KEY, VALUE, Mark, Path, closest, parse, quote, text
from strata.plans.schema import type_at, walk

Transformation = str | Column | Callable[..., Any] | None
_MISSING = object()


class Node:
    def __init__(self) -> None:
        self.children: dict[Any, Node] = {}
        self.leaf: Any = _MISSING

    def put(self, path: Path, leaf: Transformation) -> None:
        node = self
        for k, s in enumerate(path):
            if node.leaf is not _MISSING:
                raise AnalysisException(f"Field '{text(path[:k])}' is given with '{text(path)}', which is inside it")
            node = node.children.setdefault(s, Node())
        if node.children or node.leaf is not _MISSING:
            raise AnalysisException(f"Field '{text(path)}' is given more than once, or with fields inside it")
        node.leaf = leaf

    def is_identity(self) -> bool:
        return self.leaf is None or self.leaf is _MISSING and all(c.is_identity() for c in self.children.values())

    def covers(self, t: T.DataType | None) -> bool:
        """Whether these are all fields of the type, in order, unchanged."""
        if self.leaf is None:
            return True
        if self.leaf is not _MISSING or t is None:
            return False
        if isinstance(t, T.StructType):
            return list(self.children) == t.names and all(c.covers(t[n].dataType) for n, c in self.children.items())
        if isinstance(t, T.ArrayType):
            return list(self.children) == [EACH] and self.children[EACH].covers(t.elementType)
        if isinstance(t, T.MapType):
            return all(c.covers(t.keyType if s is KEY else t.valueType) for s, c in self.children.items())
        return False


def arity(f: Callable[..., Any]) -> int:
    return len([p for p in inspect.signature(f).parameters.values() if p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD) and p.default is p.empty])


def as_column(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _apply(leaf: Transformation, source: Column | None, scope: tuple[Any, ...], path: Path) -> Column:
    if leaf is None:
        if source is None:
            raise AnalysisException(f"Field '{text(path)}' does not exist")
        return source
    if isinstance(leaf, (str, Column)):
        return as_column(leaf)
    n = arity(leaf)
    if n > len(scope):
        raise AnalysisException(f"The transformation of field '{text(path)}' takes {n} arguments, but only {len(scope)} levels enclose it")
    return as_column(leaf(*scope[len(scope) - n :]))


def build(node: Node, t: T.DataType | None, nullable: bool, source: Column | None, scope: tuple[Any, ...], path: Path) -> Column:
    if node.leaf is not _MISSING:
        return _apply(node.leaf, source, scope, path)
    if source is not None and node.covers(t):
        return source
    marks = [s for s in node.children if isinstance(s, Mark)]
    if marks and len(marks) < len(node.children):
        raise AnalysisException(f"Field '{text(path)}' is used both as a struct and as a repeated field")
    if EACH in node.children:
        if not isinstance(t, T.ArrayType):
            raise AnalysisException(f"Field '{text(path)}' is no array")
        child, inner = node.children[EACH], (*path, EACH)
        return F.transform(source, lambda x: build(child, t.elementType, t.containsNull, x, (*scope, x), inner))
    if marks:
        if not isinstance(t, T.MapType):
            raise AnalysisException(f"Field '{text(path)}' is no map")
        out = source
        key, value = node.children.get(KEY), node.children.get(VALUE)
        if value is not None and not value.covers(t.valueType):
            out = F.transform_values(out, lambda _, v: build(value, t.valueType, t.valueContainsNull, v, (*scope, v), (*path, VALUE)))
        if key is not None and not key.covers(t.keyType):
            out = F.transform_keys(out, lambda k, _: build(key, t.keyType, False, k, (*scope, k), (*path, KEY)))
        return out
    if source is not None and not isinstance(t, T.StructType):
        raise AnalysisException(f"Field '{text(path)}' is no struct, so it cannot hold '{text((*path, next(iter(node.children))))}'")
    parts = []
    for name, child in node.children.items():
        known = isinstance(t, T.StructType) and name in t.names
        parts.append(build(child, t[name].dataType if known else None, known and t[name].nullable, source.getField(name) if known else None, scope, (*path, name)).alias(name))
    out = F.struct(*parts)
    return F.when(source.isNotNull(), out) if source is not None and nullable else out


def _suggest(path: Path, schema: T.StructType) -> str:
    known = [leaf.name for leaf in walk(schema, inner=True)]
    return f"Did you mean one of the following? {closest(text(path), known)}"


def check(paths: list[Path], schema: T.StructType) -> None:
    """Arrays and maps that paths go into must exist."""
    for path in paths:
        for k, s in enumerate(path):
            if isinstance(s, Mark) and type_at(schema, path[: k + 1]) is None:
                what = "Repeated field" if s is EACH else "Map field"
                raise AnalysisException(f"{what} '{text(path[: k + 1])}' does not exist. {_suggest(path[: k + 1], schema)}")


def resolve(fields: Mapping[str, Transformation], df: DataFrame) -> list[Column]:
    """Root columns for a mapping of paths to transformations over a DataFrame."""
    parsed = [(parse(k), v) for k, v in fields.items()]
    check([p for p, _ in parsed], df.schema)
    root = Node()
    for path, leaf in parsed:
        root.put(path, leaf)
    out = []
    for name, node in root.children.items():
        known = name in df.columns
        f = df.schema[name] if known else None
        out.append(build(node, f.dataType if known else None, known and f.nullable, F.col(quote(name)) if known else None, (df,), (name,)).alias(name))
    return out


# --- whole-schema rewrites -------------------------------------------------


def rewrite(column: Column, t: T.DataType, nullable: bool, f: Callable[[Column, T.DataType], Column | None]) -> tuple[Column, bool]:
    """Apply f to a column and everything inside it, innermost first, with the original types; None keeps. Says whether anything changed."""
    changed = False
    if isinstance(t, T.StructType):
        parts = [(x.name, *rewrite(column.getField(x.name), x.dataType, x.nullable, f)) for x in t.fields]
        if any(c for _, _, c in parts):
            made = F.struct(*(p.alias(n) for n, p, _ in parts))
            column, changed = (F.when(column.isNotNull(), made) if nullable else made), True
    elif isinstance(t, T.ArrayType):
        if _touches(t.elementType, f):
            column, changed = F.transform(column, lambda x: rewrite(x, t.elementType, t.containsNull, f)[0]), True
    elif isinstance(t, T.MapType):
        if _touches(t.valueType, f):
            column, changed = F.transform_values(column, lambda _, v: rewrite(v, t.valueType, t.valueContainsNull, f)[0]), True
        if _touches(t.keyType, f):
            column, changed = F.transform_keys(column, lambda k, _: rewrite(k, t.keyType, False, f)[0]), True
    got = f(column, t)
    return (column, changed) if got is None else (got, True)


def _touches(t: T.DataType, f: Callable[[Column, T.DataType], Column | None]) -> bool:
    """Whether f changes this type or one inside it."""
    probe = F.lit(None)
    if f(probe, t) is not None:
        return True
    if isinstance(t, T.StructType):
        return any(_touches(x.dataType, f) for x in t.fields)
    if isinstance(t, T.ArrayType):
        return _touches(t.elementType, f)
    return isinstance(t, T.MapType) and (_touches(t.keyType, f) or _touches(t.valueType, f))


def rewrite_all(df: DataFrame, f: Callable[[Column, T.DataType], Column | None]) -> DataFrame:
    return df.select(*(rewrite(F.col(quote(x.name)), x.dataType, x.nullable, f)[0].alias(x.name) for x in df.schema.fields))
