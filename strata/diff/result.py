"""The result of a comparison: statistics, frequent values and changes, samples, reports."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.diff.model import DiffFormatOptions, DiffResultSummary, DiffStats, SchemaDiffResult
from strata.plans.paths import get_granularity, quote

EXISTS = "__EXISTS__"
IS_EQUAL = "__IS_EQUAL__"
SAMPLE_ID = "__SAMPLE_ID__"
STATES = ("changed", "no_change", "only_in_left", "only_in_right")


def as_text(column: Column, t: T.DataType) -> Column:
    """A value as it is shown: arrays and structs as JSON, anything else cast to a string."""
    return F.to_json(column) if isinstance(t, (T.ArrayType, T.StructType)) else column.cast("string")


class DiffResult:
    """diff_df_shards: by granularity, the joined rows. Nothing runs before a result is asked for; each is computed once."""

    def __init__(self, schema_diff_result: SchemaDiffResult, diff_df_shards: dict[str, DataFrame], join_cols: list[str], own_columns: dict[str, list[str]] | None = None, diff_format_options: DiffFormatOptions | None = None, kept: list[DataFrame] | None = None) -> None:
        self.schema_diff_result = schema_diff_result
        self.diff_df_shards = diff_df_shards
        self.join_cols = list(join_cols)
        self.diff_format_options = diff_format_options or DiffFormatOptions()
        self._own = own_columns or {k: [c for c in df.columns if c not in (EXISTS, IS_EQUAL, SAMPLE_ID)] for k, df in diff_df_shards.items()}
        self._kept: list[DataFrame] = list(kept or [])
        self._per_column: dict[int, DataFrame] = {}

    def _keep(self, df: DataFrame) -> DataFrame:
        df = df.persist()
        self._kept.append(df)
        return df

    def unpersist(self) -> None:
        """Give back what results were kept."""
        for df in self._kept:
            df.unpersist()
        self._kept.clear()

    # --- statistics ---

    @cached_property
    def diff_stats_shards(self) -> dict[str, DiffStats]:
        """By level; one job for all of them."""
        left, right, equal = F.col(f"{EXISTS}.left_value"), F.col(f"{EXISTS}.right_value"), F.col(IS_EQUAL)
        counts = (F.count(F.lit(1)), F.count_if(left & right & equal), F.count_if(left & right & ~equal), F.count_if(left), F.count_if(right), F.count_if(left & ~right), F.count_if(~left & right))
        parts = [df.agg(F.lit(level).alias("level"), *counts) for level, df in self.diff_df_shards.items()]
        found = {row[0]: DiffStats(*row[1:]) for row in reduce(DataFrame.unionAll, parts).collect()}
        return {level: found[level] for level in self.diff_df_shards}

    @property
    def same_schema(self) -> bool:
        return self.schema_diff_result.same_schema

    @property
    def same_data(self) -> bool:
        """No row differs, and no column with rows is on one side only."""
        lonely = any(v != " " for v in self.schema_diff_result.column_names_diff.values())
        return all(s.same_data and not (lonely and s.total) for s in self.diff_stats_shards.values())

    @property
    def is_ok(self) -> bool:
        return self.same_schema and self.same_data

    @property
    def total_nb_rows(self) -> int:
        """Rows of the coarsest comparison."""
        return next(iter(self.diff_stats_shards.values())).total

    # --- values ---

    def _melted(self, level: str) -> DataFrame:
        """A row for each row and column: name, state, both values as text, sample id."""
        df = self.diff_df_shards[level]
        items = []
        for n in self._own[level]:
            c = F.col(quote(n))
            t = df.schema[n].dataType["left_value"].dataType
            left, right = c["exists_left"], c["exists_right"]
            state = F.when(left & right & c["is_equal"], "no_change").when(left & right, "changed").when(left, "only_in_left").when(right, "only_in_right")
            items.append(F.struct(F.lit(n).alias("column_name"), state.alias("state"), as_text(c["left_value"], t).alias("left_value"), as_text(c["right_value"], t).alias("right_value")))
        return df.select(F.explode(F.array(*items)).alias("x"), SAMPLE_ID).select("x.*", SAMPLE_ID).where("state IS NOT NULL")

    @cached_property
    def _value_counts(self) -> DataFrame:
        melted = reduce(DataFrame.unionAll, [self._melted(level) for level in self.diff_df_shards if self._own[level]])
        counts = melted.groupBy("column_name", "state", "left_value", "right_value").agg(F.count(F.lit(1)).alias("nb"), F.min(SAMPLE_ID).alias("sample_ids"))
        return self._keep(counts)

    @cached_property
    def top_per_col_state_df(self) -> DataFrame:
        """column_name, state, left_value, right_value, nb, sample_ids, row_num (by nb, most frequent first)."""
        order = Window.partitionBy("column_name", "state").orderBy(F.desc("nb"), "left_value", "right_value")
        return self._value_counts.withColumn("row_num", F.row_number().over(order))

    def get_diff_per_col_df(self, max_nb_rows_per_col_state: int) -> DataFrame:
        """A row for each column: counts by state, and the most frequent values or changes of each state, most frequent first."""
        n = max_nb_rows_per_col_state
        if n not in self._per_column:
            self._per_column[n] = self._keep(self._diff_per_col(n))
        return self._per_column[n]

    def _diff_per_col(self, n: int) -> DataFrame:
        spark = self._value_counts.sparkSession
        names = spark.createDataFrame(list(enumerate(self.schema_diff_result.column_names)), "column_number int, column_name string")
        counts = self._value_counts.groupBy("column_name").agg(F.sum("nb").alias("total"), *(F.coalesce(F.sum(F.when(F.col("state") == s, F.col("nb"))), F.lit(0)).alias(s) for s in STATES))
        item = F.struct("row_num", "left_value", "right_value", "nb", "sample_ids")
        top = self.top_per_col_state_df.where(F.col("row_num") <= n).groupBy("column_name").agg(*(F.array_sort(F.array_agg(F.when(F.col("state") == s, item))).alias(s + "_top") for s in STATES))

        def shown(s: str) -> Column:
            value = lambda x: [x["left_value"], x["right_value"]] if s == "changed" else [(x["right_value"] if s == "only_in_right" else x["left_value"]).alias("value")]
            made = F.transform(F.col(s + "_top"), lambda x: F.struct(*value(x), x["nb"].alias("nb"), x["sample_ids"].alias("sample_ids")))
            empty = F.array().cast(top.select(made.alias("x")).schema["x"].dataType)
            return F.coalesce(made, empty).alias(s)

        joined = names.join(F.broadcast(counts), "column_name", "left").join(F.broadcast(top), "column_name", "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
        return joined.select("column_number", "column_name", F.struct(zero("total"), *(zero(s) for s in STATES)).alias("counts"), F.struct(*(shown(s) for s in STATES)).alias("diff")).orderBy("column_number")

    def get_sample_df_shards(self, max_nb_rows_per_col_state: int) -> list[DataFrame]:
        """For each granularity, the whole rows that the kept values are samples of; their number is bounded by columns, states and n."""
        ids = self.top_per_col_state_df.where(F.col("row_num") <= max_nb_rows_per_col_state).select(F.explode("sample_ids").alias("_id")).distinct()
        return [df.join(F.broadcast(ids), F.col(SAMPLE_ID)[0] == F.col("_id"), "left_semi") for df in self.diff_df_shards.values()]

    def level_of(self, column: str) -> str:
        return get_granularity(column)

    # --- reports ---

    def summary(self, options: DiffFormatOptions | None = None) -> DiffResultSummary:
        o = options or self.diff_format_options
        n = o.nb_top_values_kept_per_column
        return DiffResultSummary(o.left_df_alias, o.right_df_alias, self.get_diff_per_col_df(n), self.get_sample_df_shards(n), self.schema_diff_result, self.join_cols, self.same_schema, self.same_data, self.total_nb_rows)

    def display(self, show_examples: bool = False, diff_format_options: DiffFormatOptions | None = None) -> None:
        """Print the comparison."""
        from strata.diff.text import print_report

        print_report(self, show_examples, diff_format_options or self.diff_format_options)

    def export_to_html(self, title: str | None = None, output_file_path: str = "diff_report.html", encoding: str = "utf-8", diff_format_options: DiffFormatOptions | None = None) -> None:
        """Write the comparison as one HTML file that needs nothing else."""
        from strata.diff.html import html_report
        from strata.sources.filesystem import write_file

        write_file(html_report(self, title, diff_format_options or self.diff_format_options), output_file_path, "overwrite", encoding)
        print(f"Report exported as {output_file_path}")
