"""Small helpers."""

from __future__ import annotations

import importlib
import re
from collections.abc import Hashable, Iterable
from types import ModuleType
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession

from strata.plans.compiler import as_column
from strata.plans.paths import quote, quote_columns, quote_idempotent, split_col_name, unquote
from strata.sources.filesystem import active_session

K = TypeVar("K", bound=Hashable)
V = TypeVar("V")


def group_by_key(items: Iterable[tuple[K, V]]) -> dict[K, list[V]]:
    out: dict[K, list[V]] = {}
    for k, v in items:
        out.setdefault(k, []).append(v)
    return out


def str_to_col(col: str | Column) -> Column:
    return as_column(col)


def strip_margin(text: str) -> str:
    """Each line without what stands before its first |; blank lines around the text go too."""
    lines = text.split("\n")
    if not lines[0].strip():
        del lines[0]
    if lines and not lines[-1].strip():
        del lines[-1]
    return "\n".join(re.sub(r"^\s*\|", "", x) for x in lines)


def get_instantiated_spark_session() -> SparkSession:
    return active_session()


def show_string(df: DataFrame, n: int = 20, truncate: bool | int = True, vertical: bool = False) -> str:
    """What DataFrame.show prints."""
    width = 20 if truncate is True else int(truncate)
    return df._jdf.showString(n, width, vertical)


def schema_string(df: DataFrame) -> str:
    """What DataFrame.printSchema prints."""
    return df._jdf.schema().treeString()


def assert_true(assertion: bool, error: str | BaseException | None = None) -> None:
    if not assertion:
        raise error if isinstance(error, BaseException) else AssertionError(*([error] if error else []))


def load_external_module(module_name: str, version_constraint: str | None = None) -> ModuleType:
    """Import an optional module, of a version like "1.2.*" if asked."""
    try:
        module = importlib.import_module(module_name)
    except ImportError as e:
        raise ImportError(f"Module {module_name} is not installed.") from e
    if version_constraint is not None:
        found = getattr(module, "__version__", "")
        if not re.fullmatch(re.escape(version_constraint).replace(r"\*", ".*"), found):
            raise ImportError(f"Module {module_name} has version {found}, but {version_constraint} is needed.")
    return module


__all__ = ["assert_true", "get_instantiated_spark_session", "group_by_key", "load_external_module", "quote", "quote_columns", "quote_idempotent", "schema_string", "show_string", "split_col_name", "str_to_col", "strip_margin", "unquote"]
