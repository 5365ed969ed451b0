"""The comparison as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.diff.model import DiffFormatOptions, DiffStats
from strata.diff.result import IS_EQUAL, DiffResult
from strata.plans.paths import get_granularity, quote


def print_stats(s: DiffStats, left: str, right: str) -> None:
    more = s.in_right - s.in_left
    if more:
        print("\nRow count changed: ")
        print(f"{left}: {s.in_left} rows")
        print(f"{right}: {s.in_right} rows ({abs(more)} {'more' if more > 0 else 'less'})")
    else:
        print(f"Row count ok: {s.in_right} rows")
    print("")
    print(f"{s.no_change} ({s.percent_no_change}%) rows are identical")
    print(f"{s.changed} ({s.percent_changed}%) rows have changed")
    print(f"{s.only_in_left} ({s.percent_only_in_left}%) rows are only in '{left}'")
    print(f"{s.only_in_right} ({s.percent_only_in_right}%) rows are only in '{right}'\n")


def changes(per_column: DataFrame) -> DataFrame:
    """column_name, total_nb_diff, left_value, right_value, nb_differences of the most frequent changes."""
    rows = per_column.select("column_number", "column_name", F.col("counts.changed").alias("total_nb_diff"), F.inline("diff.changed"))
    return rows.orderBy("column_number", F.desc("nb"), "left_value", "right_value").select("column_name", "total_nb_diff", "left_value", "right_value", F.col("nb").alias("nb_differences"))


def lonely(per_column: DataFrame, state: str) -> DataFrame:
    """column_name, value, nb of the most frequent values of rows on one side only."""
    rows = per_column.select("column_number", "column_name", F.inline(F.col("diff")[state]))
    return rows.orderBy("column_number", F.desc("nb"), "value").select("column_name", "value", "nb")


def _examples(result: DiffResult, level: str, n: int = 10) -> None:
    df = result.diff_df_shards[level].where(f"NOT {IS_EQUAL} AND `__EXISTS__`.left_value AND `__EXISTS__`.right_value")
    keys = [c for c in result.join_cols if c in df.columns]
    names = [c for c in df.columns if not c.startswith("__") and c not in keys]
    for c in names:
        v = F.col(quote(c))
        some = df.where(v["exists_left"] & v["exists_right"] & ~v["is_equal"])
        found = some.select(*(F.coalesce(F.col(quote(k))["left_value"], F.col(quote(k))["right_value"]).alias(k) for k in keys), v["left_value"].alias("left_value"), v["right_value"].alias("right_value")).limit(n)
        if found.limit(1).count():
            print(f"Examples of changes in {c}:")
            found.show(n, False)


def print_report(result: DiffResult, show_examples: bool, options: DiffFormatOptions) -> None:
    left, right = options.left_df_alias, options.right_df_alias
    result.schema_diff_result.display()
    if result.is_ok:
        print("\ndiff ok!\n")
    else:
        print("\ndiff NOT ok\n")
    stats = result.diff_stats_shards
    several = len(stats) > 1
    if several:
        print("WARNING: This diff has multiple granularity levels, we will print the results for each granularity level,")
        print("         but we recommend to export the results to html for a much more digest result.\n")
    per_column = result.get_diff_per_col_df(options.nb_top_values_kept_per_column)
    level_of = {n: get_granularity(n) for n in result.schema_diff_result.column_names}
    for level, s in stats.items():
        own = per_column.where(F.col("column_name").isin([n for n, g in level_of.items() if g == level])) if several else per_column
        if several:
            print("##############################################################")
            print(f"Granularity : {level or 'root'} ({s.total} rows)\n")
        print_stats(s, left, right)
        if s.changed:
            print("Found the following changes:")
            changes(own).show(1000, False)
            if show_examples:
                _examples(result, level)
        for n, name, state in ((s.only_in_left, left, "only_in_left"), (s.only_in_right, right, "only_in_right")):
            if n:
                print(f"{n} rows were only found in '{name}' :")
                print(f"Most frequent values in '{name}' for each column :")
                lonely(own, state).show(1000, False)
