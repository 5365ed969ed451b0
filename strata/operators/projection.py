"""Projections over nested fields, and explosions by granularity."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.plans import compiler
from strata.plans.compiler import Transformation
from strata.plans.paths import EACH, Path, get_granularity, granularity_of, is_sub_field_or_equal, is_sub_field_or_equal_to_any, parse, quote, require_known, text
from strata.plans.schema import flat_schema_string, walk


def fields(df: DataFrame, keep_non_leaf_fields: bool = False) -> list[str]:
    """Flat names of all fields of df."""
    return [leaf.name for leaf in walk(df.schema, inner=keep_non_leaf_fields)]


def schema_string(df: DataFrame) -> str:
    """The schema with one line for each flat field."""
    return flat_schema_string(df.schema)


def print_schema(df: DataFrame) -> None:
    print(schema_string(df))


def select(df: DataFrame, fields: Mapping[str, Transformation]) -> DataFrame:
    """Project field paths, each with a transformation, in the given order.

    A transformation is None (the field itself), a column name, a Column, or a function of the innermost enclosing elements (the
    last one is the deepest; the outermost level is df). Fields that are not named are dropped.
    """
    return df.select(*compiler.resolve(fields, df))


def with_fields(df: DataFrame, fields: Mapping[str, Transformation]) -> DataFrame:
    """All fields of df, with the given ones added or replaced. A given field replaces everything inside it."""
    given = {text(parse(k)): v for k, v in fields.items()}
    whole: dict[str, Transformation] = {}
    for leaf in walk(df.schema):
        over = [k for k in given if _is_inside(leaf.path, parse(k))]
        name = over[0] if over else leaf.name
        whole[name] = given.get(name)
    return select(df, whole | given)


def _is_inside(path: Path, outer: Path) -> bool:
    return path[: len(outer)] == outer


def _exploded(df: DataFrame, target: Path, keep: list[str]) -> tuple[DataFrame, Path]:
    """df exploded along all arrays of a granularity: one column named by the path, and the kept ones from levels above."""
    at: Path = ()
    there: list[str] = []
    for k, s in enumerate(target):
        if s is not EACH:
            continue
        path = target[: k + 1]
        new = [n for n in keep if n not in there and granularity_of(parse(n)) == at]
        carried = [*(F.col(quote(n)) for n in there), *(_from(at, parse(n)).alias(n) for n in new)]
        df = df.select(*carried, F.explode(_from(at, target[:k])).alias(text(path)))
        there += new
        at = path
    return df, at


def _from(base: Path, path: Path) -> Column:
    """Column of a path, given that the path `base` is a column named by its text."""
    rest = path[len(base) :]
    column = F.col(quote(text(base))) if base else F.col(quote(rest[0]))
    for name in rest if base else rest[1:]:
        column = column.getField(name)
    return column


def unnest_fields(df: DataFrame, fields: str | Iterable[str], keep_fields: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """One DataFrame for each granularity among the fields, its columns named by paths.

    Arrays on the way are exploded (rows with empty or NULL arrays go); keep_fields are carried along. Only columns that are needed
    go through each explosion.
    """
    names = [fields] if isinstance(fields, str) else list(fields)
    keep_names = list(keep_fields or [])
    require_known([*names, *keep_names], {leaf.name for leaf in walk(df.schema, inner=True)} | {n for n in _with_elements(df)})
    groups: dict[Path, list[str]] = {}
    for n in names:
        groups.setdefault(granularity_of(parse(n)), []).append(n)
    out = {}
    for target, own in groups.items():
        keep = [n for n in keep_names if not any(is_sub_field_or_equal(f, n) for f in own) and _is_inside(target, granularity_of(parse(n)))]
        exploded, at = _exploded(df, target, keep)
        here = [n for n in keep if granularity_of(parse(n)) == target]
        out[text(target)] = exploded.select(*(_from(at, parse(n)).alias(n) if n in here else F.col(quote(n)) for n in keep), *(_from(at, parse(n)).alias(n) for n in own))
    return out


def _with_elements(df: DataFrame) -> Iterable[str]:
    """Paths that end at array elements."""
    for leaf in walk(df.schema, inner=True):
        for k, s in enumerate(leaf.path):
            if s is EACH:
                yield text(leaf.path[: k + 1])


def unnest_field(df: DataFrame, field_name: str, keep_columns: list[str] | None = None) -> DataFrame:
    """df exploded along one path; the result's column has the path as its name."""
    return next(iter(unnest_fields(df, field_name, keep_columns).values()))


def unnest_all_fields(df: DataFrame, keep_columns: list[str] | None = None) -> dict[str, DataFrame]:
    """All fields of df, by granularity ("" for the root)."""
    keep = keep_columns or []
    return unnest_fields(df, [f for f in fields(df) if not is_sub_field_or_equal_to_any(f, keep)], keep)


__all__ = ["fields", "get_granularity", "print_schema", "schema_string", "select", "unnest_all_fields", "unnest_field", "unnest_fields", "with_fields"]
