"""Join columns: inference, and protection from joins that explode."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.errors import CombinatorialExplosionError, DataframeComparisonException
from strata.plans.paths import EACH, quote
from strata.plans.schema import walk

#: A join column's distinct values must exceed this percentage of the rows.
LEAST_DISTINCT_PERCENT = 90
MOST_GROWTH = 2.0


def self_join_growth(df: DataFrame, columns: Sequence[str]) -> float:
    """Rows of a self-join on the columns for each row, rounded; 1.0 for an empty table."""
    counts = df.groupBy(*(F.col(quote(c)) for c in columns)).agg(F.count(F.lit(1)).alias("n"))
    row = counts.agg(F.sum(F.col("n") * F.col("n")).alias("pairs"), F.sum("n").alias("rows")).first()
    return round(row["pairs"] / row["rows"], 2) if row["rows"] else 1.0


def growth_by_column(df: DataFrame, columns: Sequence[Column]) -> list[float]:
    """self_join_growth of each of several columns, in one job."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), c.cast("string").alias("v")) for k, c in enumerate(columns)))).alias("p")
    counts = df.select(pairs).groupBy("p").agg(F.count(F.lit(1)).alias("n")).groupBy("p.k").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("g"))
    found = {r["k"]: r["g"] for r in counts.collect()}
    return [round(found.get(k, 1.0), 2) for k in range(len(columns))]


def _candidates(df: DataFrame) -> dict[str, Column]:
    out = {}
    for leaf in walk(df.schema, explode=False):
        if isinstance(leaf.type, (T.StringType, T.IntegerType, T.LongType)) and EACH not in leaf.path:
            column = F.col(quote(leaf.path[0]))
            for name in leaf.path[1:]:
                column = column.getField(name)
            out[leaf.name] = column
    return out


def _eligible(df: DataFrame, columns: dict[str, Column]) -> set[str] | None:
    """Names of columns with nearly as many distinct values as rows; None for an empty table."""
    names = list(columns)
    row = df.agg(F.count(F.lit(1)), *(F.approx_count_distinct(columns[n]) for n in names)).first()
    if not row[0]:
        return None
    return {n for k, n in enumerate(names, 1) if row[k] * 100 / row[0] > LEAST_DISTINCT_PERCENT}


def infer_join_column(left_df: DataFrame, right_df: DataFrame) -> str:
    """The column, unique enough on both sides, whose self-join grows least."""
    left, right = _candidates(left_df), _candidates(right_df)
    both = [n for n in left if n in right]
    sides = [s for s in ((_eligible(left_df, {n: left[n] for n in both})), (_eligible(right_df, {n: right[n] for n in both}))) if s is not None]
    names = [n for n in both if all(n in s for s in sides)]
    if not names or not sides:
        raise DataframeComparisonException("Could not automatically infer a column sufficiently unique to join the two DataFrames and perform a comparison. Please specify manually the columns to use with the join_cols parameter")
    if len(names) == 1:
        return names[0]
    growth = [growth_by_column(df, [columns[n] for n in names]) for df, columns in ((left_df, left), (right_df, right))]
    return names[min(range(len(names)), key=lambda k: (growth[0][k] + growth[1][k], k))]


def guard(left_df: DataFrame, right_df: DataFrame, join_cols: Sequence[str]) -> None:
    """Refuse a join that would at least double the rows, and warn of one that grows. Both sides are counted in one job."""
    keys = [F.col(quote(c)) for c in join_cols]
    sides = [df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("side"), "n") for k, df in enumerate((left_df, right_df))]
    found = {r["side"]: r for r in sides[0].unionAll(sides[1]).groupBy("side").agg(F.sum(F.col("n") * F.col("n")).alias("pairs"), F.sum("n").alias("rows")).collect()}
    growth = sum(round(found[k]["pairs"] / found[k]["rows"], 2) if k in found else 1.0 for k in (0, 1)) / 2
    if growth >= MOST_GROWTH:
        raise CombinatorialExplosionError(
            f"Performing a join with the columns {list(join_cols)} would increase the size of the table by a factor of {growth:.2f} and fail to identify rows. Please provide join_cols that are truly unique for both DataFrames."
        )
    if growth > 1.0:
        print(f"WARNING: duplicates have been detected in the joining key, the resulting DataFrame will be {growth:.2f} bigger which might affect the diff results. Please consider providing join_cols that are truly unique for both DataFrames.")
