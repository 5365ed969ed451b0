"""Building a comparison: keys, schemas, and one joined DataFrame for each granularity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.diff.keys import guard, infer_join_column
from strata.diff.result import EXISTS, IS_EQUAL, SAMPLE_ID, DiffResult, as_text
from strata.diff.schemas import compared_fields, diff_dataframe_schemas
from strata.operators.harmonize import harmonize_dataframes
from strata.operators.projection import unnest_fields
from strata.operators.reshape import convert_all_maps_to_arrays, sort_all_arrays
from strata.plans.paths import get_granularity, quote, require_known
from strata.plans.schema import walk


def _named(columns: Sequence[str]) -> str:
    return f"column: {columns[0]}" if len(columns) == 1 else f"columns: {list(columns)}"


def join_sides(left_df: DataFrame, right_df: DataFrame, join_cols: Sequence[str]) -> DataFrame:
    """Null-safe full join: for each column a struct of both values, their equality and on which sides the column exists.

    Values are compared as they are typed, NULL with NULL equal, so what a text form hides is seen.
    """
    left_types = {f.name: f.dataType for f in left_df.schema.fields}
    right_types = {f.name: f.dataType for f in right_df.schema.fields}
    names = [*left_types, *(n for n in right_types if n not in left_types)]
    number = {n: k for k, n in enumerate(names)}
    left = left_df.select(*(F.col(quote(n)).alias(f"l{number[n]}") for n in left_types), F.lit(True).alias("l"))
    right = right_df.select(*(F.col(quote(n)).alias(f"r{number[n]}") for n in right_types), F.lit(True).alias("r"))
    clause: Column | None = None
    for c in join_cols:
        same = F.col(f"l{number[c]}").eqNullSafe(F.col(f"r{number[c]}"))
        clause = same if clause is None else clause & same
    joined = left.join(right, clause, "full")
    in_left, in_right = F.coalesce("l", F.lit(False)), F.coalesce("r", F.lit(False))
    columns, equal = [], in_left & in_right
    for n in names:
        here, there = n in left_types, n in right_types
        lv = F.col(f"l{number[n]}") if here else F.lit(None).cast(right_types[n])
        rv = F.col(f"r{number[n]}") if there else F.lit(None).cast(left_types[n])
        el, er = in_left & F.lit(here), in_right & F.lit(there)
        same = F.lit(False)
        if here and there:
            lt, rt = left_types[n], right_types[n]
            # elements may keep members of one side only; then their text forms decide
            same = el & er & (lv.eqNullSafe(rv) if lt.simpleString() == rt.simpleString() else as_text(lv, lt).eqNullSafe(as_text(rv, rt)))
        if here and there:
            equal = equal & same
        columns.append(F.struct(lv.alias("left_value"), rv.alias("right_value"), same.alias("is_equal"), el.alias("exists_left"), er.alias("exists_right")).alias(n))
    key = F.to_json(F.struct(*(F.coalesce(F.col(f"l{number[c]}"), F.col(f"r{number[c]}")).alias(c) for c in join_cols)))
    return joined.select(*columns, F.struct(in_left.alias("left_value"), in_right.alias("right_value")).alias(EXISTS), equal.alias(IS_EQUAL), F.array(key).alias(SAMPLE_ID))


def compare_dataframes(left_df: DataFrame, right_df: DataFrame, join_cols: list[str] | None = None) -> DiffResult:
    """Compare two DataFrames row by row and column by column.

    Without join_cols, one column that identifies rows is looked for. Columns that changed type are compared in their common type;
    arrays are compared whatever their order; maps as arrays of entries. A join column inside an array (`a!.id`) makes the array's
    elements rows of a comparison of their own.
    """
    print("\nAnalyzing differences...")
    left_df, right_df = convert_all_maps_to_arrays(left_df), convert_all_maps_to_arrays(right_df)
    inferred = not join_cols
    if join_cols:
        for df in (left_df, right_df):
            require_known(join_cols, [leaf.name for leaf in walk(df.schema, inner=True)])
    else:
        print("No join_cols provided: trying to automatically infer a column that can be used for joining the two DataFrames")
        join_cols = [infer_join_column(left_df, right_df)]
        print(f"Found the following {_named(join_cols)}")
    schema_diff = diff_dataframe_schemas(left_df, right_df, join_cols)
    if not schema_diff.same_schema:
        left_df, right_df = harmonize_dataframes(left_df, right_df, keep_missing_columns=True)
    left_df, right_df = sort_all_arrays(left_df), sort_all_arrays(right_df)
    levels: list[str] = []
    for c in join_cols:
        if get_granularity(c) not in levels:
            levels.append(get_granularity(c))
    kept: list[DataFrame] = []
    if len(levels) > 1:
        # every level reads both inputs, for its guard and for its results
        left_df, right_df = left_df.persist(), right_df.persist()
        kept = [left_df, right_df]
    shards: dict[str, DataFrame] = {}
    own_columns: dict[str, list[str]] = {}
    for level in levels:
        keys = [c for c in join_cols if level.startswith(get_granularity(c))]
        keep = [c for c in keys if get_granularity(c) != level]
        sides = []
        for df in (left_df, right_df):
            own = [leaf.name for leaf in compared_fields(df.schema, join_cols) if get_granularity(leaf.name) == level]
            sides.append(unnest_fields(df, own, keep)[level])
        guard(*sides, keys)
        print(f"Generating the diff by joining the DataFrames together using the {'inferred' if inferred else 'provided'} {_named(keys)}")
        ordered = [n for n in schema_diff.column_names if get_granularity(n) == level]
        sides = [s.select(*(F.col(quote(n)) for n in [*keep, *(n for n in ordered if n in s.columns)])) for s in sides]
        shards[level] = join_sides(*sides, keys)
        own_columns[level] = ordered
    return DiffResult(schema_diff, shards, join_cols, own_columns, kept=kept)
