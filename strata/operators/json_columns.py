"""JSON text columns as structs, with schemas inferred from the data."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.plans.paths import quote, split_col_name


def infer_json_schema(df: DataFrame, column: str) -> T.DataType:
    """Schema of all JSON values of a column (named as in SQL), found by Spark's JSON reader without leaving the JVM."""
    spark = df.sparkSession
    wrapped = df.where(F.col(column).isNotNull()).select(F.concat(F.lit('{"v": '), F.col(column), F.lit("}")).alias("value"))
    encoder = spark._jvm.org.apache.spark.sql.Encoders.STRING()
    found = T.StructType.fromJson(json.loads(spark._jsparkSession.read().json(wrapped._jdf.__getattr__("as")(encoder)).schema().json()))
    return found["v"].dataType if "v" in found.names else T.StringType()


def parse_json_columns(df: DataFrame, columns: str | list[str] | dict[str, str]) -> DataFrame:
    """Parse JSON columns; a first pass over the data finds each schema.

    A dict gives names for the parsed columns; otherwise they replace the text. A column inside a struct (a.b) is parsed into a
    root column named a.b. NULL stays NULL; a column without any value stays a string.
    """
    if isinstance(columns, str):
        columns = [columns]
    if isinstance(columns, list):
        columns = {c: c for c in columns}
    out = df
    for source, target in columns.items():
        parts = split_col_name(source)
        written = quote(source) if source in df.columns else ".".join(map(quote, parts))
        schema = infer_json_schema(df, written)
        name = target if target in df.columns else ".".join(split_col_name(target))
        wrapper = T.StructType([T.StructField("v", schema)])
        text = F.concat(F.lit('{"v": '), F.col(written), F.lit("}"))
        parsed = F.from_json(text, wrapper).getField("v")
        out = out.withColumn(name, parsed)
    return out
