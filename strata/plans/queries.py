"""Registered queries: each applies one operator to the benchmark tables; SQL says what must come out.

A query takes (spark, sf_dir). Nested inputs are derived: the lines of each order as a sorted array of structs.
"""

from __future__ import annotations

import contextlib
import functools
import io
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata import functions as SF
from strata import data_type_utils, filesystem, graph, nested, schema_utils, utils
from strata import nested_functions as nf
from strata import transformations as tr
from strata.data_diff import DiffFormatOptions, DiffResult, compare_dataframes
from strata.diff.keys import growth_by_column, self_join_growth
from strata.streaming.stateless import run_available, transform_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def order_lines(spark: SparkSession, d: str) -> DataFrame:
    """id, lines: ARRAY<STRUCT<n, part, supp, qty, flag>>."""
    line = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").alias("qty"), F.col("l_returnflag").alias("flag"))
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(line)).alias("lines"))


# --- profiles --------------------------------------------------------------


def _profile_sql(source: str, columns: list[tuple[int, str, str, str]], group: str = "", name: str = "") -> str:
    lead = f"{group} AS {name}, " if group else ""
    tail = f" GROUP BY {group}" if group else ""
    return " UNION ALL ".join(
        f"SELECT {lead}{k} AS column_number, '{label}' AS column_name, '{kind}' AS column_type, count(*) AS count, count(DISTINCT {c}) AS count_distinct, count(*) - count({c}) AS count_null, CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max FROM {source}{tail}"
        for k, label, kind, c in columns
    )


@query(_profile_sql("nation", [(0, "n_nationkey", "INTEGER", "n_nationkey"), (1, "n_name", "STRING", "n_name"), (2, "n_regionkey", "INTEGER", "n_regionkey")]))
def analyze(spark, d):
    return tr.analyze(table(spark, d, "nation"))


@query(_profile_sql("customer", [(0, "c_custkey", "LONG", "c_custkey"), (1, "c_name", "STRING", "c_name"), (2, "c_nationkey", "INTEGER", "c_nationkey")], "c_mktsegment", "segment"))
def analyze_grouped(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    out = tr.analyze(df, group_by="c_mktsegment")
    return out.select(F.col("group.c_mktsegment").alias("segment"), *out.columns[1:])


@query(
    _profile_sql("(SELECT DISTINCT l_orderkey AS id FROM lineitem)", [(0, "id", "LONG", "id")])
    + " UNION ALL "
    + _profile_sql("lineitem", [(1, "lines!.n", "INTEGER", "l_linenumber"), (2, "lines!.part", "LONG", "l_partkey"), (3, "lines!.flag", "STRING", "l_returnflag")])
)
def analyze_nested(spark, d):
    lines = nested.select(order_lines(spark, d), {"id": None, "lines!.n": None, "lines!.part": None, "lines!.flag": None})
    return tr.analyze(lines)


# --- nested projection and folds ------------------------------------------


@query("SELECT * FROM (VALUES (0, 'id'), (1, 'lines!.n'), (2, 'lines!.part'), (3, 'lines!.supp'), (4, 'lines!.qty'), (5, 'lines!.flag')) t(pos, field)")
def nested_fields(spark, d):
    return spark.createDataFrame(list(enumerate(nested.fields(order_lines(spark, d)))), "pos int, field string")


@query("SELECT * FROM (VALUES (0, 'root'), (1, ' |-- r_regionkey: integer (nullable = true)'), (2, ' |-- r_name: string (nullable = true)')) t(pos, line)")
def nested_schema_string(spark, d):
    return spark.createDataFrame(list(enumerate(nested.schema_string(table(spark, d, "region")).splitlines())), "pos int, line string")


@query("SELECT l_orderkey AS id, l_linenumber * 10 AS n10, upper(l_returnflag) || '-' || CAST(l_orderkey AS VARCHAR) AS tag FROM lineitem")
def nested_select(spark, d):
    out = nested.select(order_lines(spark, d), {"id": None, "lines!.n10": lambda x: x["n"] * 10, "lines!.tag": lambda df, x: F.concat(F.upper(x["flag"]), F.lit("-"), df["id"].cast("string"))})
    return out.select("id", F.inline("lines"))


@query("SELECT l_orderkey AS id, l_linenumber AS n, l_partkey + l_suppkey AS part, l_suppkey AS supp, l_quantity AS qty, l_returnflag AS flag, l_orderkey % 7 AS bucket FROM lineitem")
def nested_with_fields(spark, d):
    out = nested.with_fields(order_lines(spark, d), {"lines!.part": lambda x: x["part"] + x["supp"], "lines!.bucket": lambda df, x: df["id"] % 7})
    return out.select("id", F.inline("lines"))


@query("SELECT l_orderkey AS id, l_linenumber AS n, l_partkey AS part, l_suppkey AS supp, l_quantity AS qty, l_returnflag AS flag FROM lineitem")
def unnest_field(spark, d):
    return nested.unnest_field(order_lines(spark, d), "lines!", keep_columns=["id"]).select("id", "`lines!`.*")


@query("SELECT 'id' AS level, count(DISTINCT l_orderkey) AS n, CAST(sum(DISTINCT l_orderkey) AS BIGINT) AS s FROM lineitem UNION ALL SELECT 'lines!', count(*), CAST(sum(l_linenumber) AS BIGINT) FROM lineitem")
def unnest_all_fields(spark, d):
    frames = nested.unnest_all_fields(order_lines(spark, d))
    root, lines = frames[""], frames["lines!"]
    part = lambda df, level, c: df.agg(F.lit(level).alias("level"), F.count(F.lit(1)).alias("n"), F.sum(c).cast("bigint").alias("s"))
    return part(root, "id", "id").unionAll(part(lines, "lines!", "`lines!.n`"))


@query("SELECT l_orderkey AS id, CAST(sum(l_linenumber) AS BIGINT) AS total, sum(l_quantity) AS qty FROM lineitem GROUP BY l_orderkey")
def nested_sum(spark, d):
    df = order_lines(spark, d)
    return df.select("id", nf.sum("lines!.n").alias("total"), nf.sum("lines!.qty", df).alias("qty"))


@query("SELECT l_orderkey AS id, avg(l_linenumber) AS mean FROM lineitem GROUP BY l_orderkey")
def nested_average(spark, d):
    return order_lines(spark, d).select("id", nf.average("lines!.n").alias("mean"))


@query("SELECT l_orderkey AS id, max(l_partkey) AS top FROM lineitem GROUP BY l_orderkey")
def nested_aggregate(spark, d):
    return order_lines(spark, d).select("id", nf.aggregate("lines!.part", F.lit(0).cast("bigint"), F.greatest).alias("top"))


# --- transformations -------------------------------------------------------


@query("SELECT n_regionkey AS id, n_nationkey AS key, n_name AS value FROM nation")
def convert_all_maps_to_arrays(spark, d):
    maps = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("m"))
    return tr.convert_all_maps_to_arrays(maps).select("id", F.inline("m"))


def _order_struct(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.struct(F.col("o_orderstatus").alias("a"), F.struct(F.col("o_custkey").alias("c"), F.col("o_orderpriority").alias("d")).alias("b")).alias("s"))


@query('SELECT o_orderkey AS id, o_orderstatus AS "s.a", o_custkey AS "s.b.c", o_orderpriority AS "s.b.d" FROM orders')
def flatten(spark, d):
    return tr.flatten(_order_struct(spark, d))


@query("SELECT o_orderkey AS id, o_orderstatus AS a, o_custkey AS c, o_orderpriority AS d FROM orders")
def unflatten(spark, d):
    return tr.unflatten(tr.flatten(_order_struct(spark, d))).select("id", "s.a", "s.b.c", "s.b.d")


def _order_numbers(spark, d):
    numbers = F.array(F.array(F.col("o_custkey"), F.col("o_orderkey")), F.array(F.col("o_orderkey") % 10, F.col("o_custkey") % 10))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), numbers.alias("a"))


@query("SELECT o_orderkey AS id, unnest([0, 1, 2, 3]) AS pos, unnest([o_custkey, o_orderkey, o_orderkey % 10, o_custkey % 10]) AS v FROM orders")
def flatten_all_arrays(spark, d):
    return tr.flatten_all_arrays(_order_numbers(spark, d)).select("id", F.posexplode("a").alias("pos", "v"))


@query("SELECT o_orderkey AS id, unnest([0, 1, 2, 3]) AS pos, unnest(list_sort([o_custkey, o_orderkey, o_orderkey % 10, o_custkey % 10])) AS v FROM orders")
def sort_all_arrays(spark, d):
    return tr.sort_all_arrays(tr.flatten_all_arrays(_order_numbers(spark, d))).select("id", F.posexplode("a").alias("pos", "v"))


@query("SELECT l_orderkey AS id, CAST(l_linenumber AS DOUBLE) AS n, l_partkey AS part, l_suppkey AS supp, l_quantity AS qty, lower(l_returnflag) AS flag FROM lineitem")
def transform_all_fields(spark, d):
    def change(c, t):
        return c.cast("double") if isinstance(t, T.IntegerType) else F.lower(c) if isinstance(t, T.StringType) else None

    return tr.transform_all_fields(order_lines(spark, d), change).select("id", F.inline("lines"))


@query('SELECT l_orderkey AS "ID", l_linenumber AS "N", l_partkey AS "PART", l_suppkey AS "SUPP", l_quantity AS "QTY", l_returnflag AS "FLAG" FROM lineitem')
def transform_all_field_names(spark, d):
    return tr.transform_all_field_names(order_lines(spark, d), str.upper).select("ID", F.inline("LINES"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation UNION ALL SELECT c_custkey, c_name FROM customer")
def harmonize_dataframes(spark, d):
    left = table(spark, d, "nation").select(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).alias("s"))
    right = table(spark, d, "customer").select(F.struct(F.col("c_name").alias("name"), F.col("c_custkey").alias("id")).alias("s"))
    a, b = tr.harmonize_dataframes(left, right)
    return a.unionAll(b).select("s.id", "s.name")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def parse_json_columns(spark, d):
    return tr.parse_json_columns(table(spark, d, "events").select("event_id", "props"), "props").select("event_id", "props.k")


@query("SELECT n_nationkey AS k, n_name AS v FROM nation UNION ALL SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey, n_name FROM nation")
def union_dataframes(spark, d):
    n, r = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v")), table(spark, d, "region")
    return tr.union_dataframes(n, r, n)


@query("SELECT o_orderkey, 'o_orderstatus' AS key, o_orderstatus AS value FROM orders UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM orders")
def unpivot(spark, d):
    return tr.unpivot(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), ["o_orderkey"])


@query(
    "SELECT n_nationkey AS id, 'n_name' AS key, 'string' AS type, CAST(NULL AS BIGINT) AS i, n_name AS s, CAST(NULL AS DOUBLE) AS f FROM nation"
    " UNION ALL SELECT n_nationkey, 'n_regionkey', 'int', CAST(n_regionkey AS BIGINT), NULL, NULL FROM nation UNION ALL SELECT n_nationkey, 'half', 'double', NULL, NULL, n_nationkey / 2 FROM nation"
)
def with_generic_typed_struct(spark, d):
    df = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.struct("n_name", "n_regionkey", (F.col("n_nationkey") / 2).alias("half")).alias("s"))
    out = tr.with_generic_typed_struct(df, ["s"]).select("id", F.inline("s"))
    return out.select("id", "key", "type", F.col("value.int").alias("i"), F.col("value.string").alias("s"), F.col("value.float").alias("f"))


# --- column functions ------------------------------------------------------


@query("SELECT o_orderkey AS id, unnest(list_distinct([o_custkey % 5, o_orderkey % 5, o_custkey % 3, o_orderkey % 3])) AS v FROM orders")
def array_union(spark, d):
    a, b = F.array(F.col("o_custkey") % 5, F.col("o_orderkey") % 5), F.array(F.col("o_custkey") % 3, F.col("o_orderkey") % 3)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.explode(SF.array_union(a, b)).alias("v"))


@query("SELECT n_nationkey AS id, 0 AS n FROM nation")
def empty_array(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.size(SF.empty_array("struct<a:int>")).alias("n"))


@query("SELECT n_nationkey AS id, 'n_name' AS name, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 'n_regionkey', CAST(n_regionkey AS VARCHAR) FROM nation")
def generic_struct(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.inline(SF.generic_struct("n_name", "n_regionkey")))


@query("SELECT n_nationkey AS id, 1 AS one FROM nation")
def nullable(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), SF.nullable(F.lit(1)).alias("one"))


# --- forests ---------------------------------------------------------------


def _forest(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), F.when(k % 7 != 0, F.floor(k / 2)).alias("parent"), F.col("c_name").alias("name"))


_FOREST = """
WITH RECURSIVE n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey // 2 END AS parent FROM customer),
up AS (SELECT id, id AS cur FROM n UNION ALL SELECT up.id, n.parent FROM up JOIN n ON n.id = up.cur WHERE n.parent IS NOT NULL AND n.parent <> n.id)
SELECT up.id, cur AS parent FROM up LEFT JOIN n ON n.id = up.cur WHERE n.id IS NULL OR n.parent IS NULL OR n.parent = n.id"""


@query(_FOREST)
def ascending_forest_traversal(spark, d):
    return graph.ascending_forest_traversal(_forest(spark, d), "id", "parent")


@query(f"SELECT f.id, f.parent, a.c_name AS name, b.c_name AS ancestor FROM ({_FOREST}) f JOIN customer a ON a.c_custkey = f.id JOIN customer b ON b.c_custkey = f.parent")
def ascending_forest_traversal_labels(spark, d):
    out = graph.ascending_forest_traversal(_forest(spark, d), "id", "parent", keep_labels=True)
    return out.select("id", "parent", F.col("node.name").alias("name"), F.col("furthest_ancestor.name").alias("ancestor"))


# --- data diff -------------------------------------------------------------


def _diff(spark, d) -> DiffResult:
    """orders against orders with changed status, changed customers, removed rows and added rows."""
    left = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    key = F.col("o_orderkey")
    kept = left.where(key % 11 != 0).select("o_orderkey", F.when(key % 5 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("o_custkey"), F.when(key % 3 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), "o_orderpriority")
    added = left.where(key % 13 == 0).select((-key).alias("o_orderkey"), "o_custkey", "o_orderstatus", "o_orderpriority")
    return compare_dataframes(left, kept.unionAll(added), ["o_orderkey"])


_DIFF = """
WITH l AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, o_orderpriority AS p FROM orders),
r AS (SELECT k, CASE WHEN k % 5 = 0 THEN c + 1 ELSE c END AS c, CASE WHEN k % 3 = 0 THEN 'X' ELSE s END AS s, p FROM l WHERE k % 11 <> 0
      UNION ALL SELECT -k, c, s, p FROM l WHERE k % 13 = 0),
j AS (SELECT l.k AS lk, r.k AS rk, l.c AS lc, r.c AS rc, l.s AS ls, r.s AS rs, l.p AS lp, r.p AS rp FROM l FULL JOIN r ON l.k = r.k),
m AS (SELECT 'o_orderkey' AS column_name, lk IS NOT NULL AS le, rk IS NOT NULL AS re, CAST(lk AS VARCHAR) AS lv, CAST(rk AS VARCHAR) AS rv, coalesce(lk, rk) AS k FROM j
      UNION ALL SELECT 'o_custkey', lk IS NOT NULL, rk IS NOT NULL, CAST(lc AS VARCHAR), CAST(rc AS VARCHAR), coalesce(lk, rk) FROM j
      UNION ALL SELECT 'o_orderstatus', lk IS NOT NULL, rk IS NOT NULL, ls, rs, coalesce(lk, rk) FROM j UNION ALL SELECT 'o_orderpriority', lk IS NOT NULL, rk IS NOT NULL, lp, rp, coalesce(lk, rk) FROM j),
v AS (SELECT column_name, CASE WHEN le AND re AND lv IS NOT DISTINCT FROM rv THEN 'no_change' WHEN le AND re THEN 'changed' WHEN le THEN 'only_in_left' ELSE 'only_in_right' END AS state, lv, rv, k FROM m)
"""


@query(
    _DIFF
    + "SELECT count(*) AS total, count(*) FILTER (lk = rk AND lc = rc AND ls = rs AND lp = rp) AS no_change, count(*) FILTER (lk = rk AND NOT (lc = rc AND ls = rs AND lp = rp)) AS changed, count(lk) AS in_left, count(rk) AS in_right, count(*) FILTER (rk IS NULL) AS only_in_left, count(*) FILTER (lk IS NULL) AS only_in_right FROM j"
)
def diff_stats(spark, d):
    s = _diff(spark, d).diff_stats_shards[""]
    names = ["total", "no_change", "changed", "in_left", "in_right", "only_in_left", "only_in_right"]
    return spark.createDataFrame([tuple(getattr(s, n) for n in names)], ", ".join(f"{n} bigint" for n in names))


@query(_DIFF + "SELECT column_name, count(*) AS total, count(*) FILTER (state = 'changed') AS changed, count(*) FILTER (state = 'no_change') AS no_change, count(*) FILTER (state = 'only_in_left') AS only_in_left, count(*) FILTER (state = 'only_in_right') AS only_in_right FROM v GROUP BY column_name")
def diff_per_column(spark, d):
    return _diff(spark, d).get_diff_per_col_df(3).select("column_name", "counts.*")


@query(
    _DIFF
    + "SELECT column_name, state, lv AS left_value, rv AS right_value, nb, CAST(row_num AS INTEGER) AS row_num FROM (SELECT *, row_number() OVER (PARTITION BY column_name, state ORDER BY nb DESC, lv NULLS FIRST, rv NULLS FIRST) AS row_num FROM (SELECT column_name, state, lv, rv, count(*) AS nb FROM v GROUP BY ALL)) WHERE row_num <= 5"
)
def diff_top_values(spark, d):
    return _diff(spark, d).top_per_col_state_df.where("row_num <= 5").drop("sample_ids")


@query(_DIFF + "SELECT lk AS left_key, rk AS right_key, lk = rk AND lc = rc AND ls = rs AND lp = rp AS is_equal FROM j WHERE lk IS NOT NULL AND rk IS NOT NULL UNION ALL SELECT lk, rk, false FROM j WHERE lk IS NULL OR rk IS NULL")
def diff_rows(spark, d):
    df = _diff(spark, d).diff_df_shards[""]
    return df.select(F.col("o_orderkey.left_value").alias("left_key"), F.col("o_orderkey.right_value").alias("right_key"), F.col("__IS_EQUAL__").alias("is_equal"))


def _nested_diff(spark, d) -> DiffResult:
    """Lines of orders, one for each number, against the same with another flag on every fourth part and without part 7."""
    line = F.struct(F.col("l_linenumber").alias("n"), F.col("part"), F.col("flag"))
    one = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.min("l_returnflag").alias("flag"))
    pack = lambda df: df.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(line).alias("lines"))
    right = one.where(F.col("part") % 7 != 0).withColumn("flag", F.when(F.col("part") % 4 == 0, "Z").otherwise(F.col("flag")))
    return compare_dataframes(pack(one), pack(right), ["id", "lines!.n"])


_NESTED_DIFF = """
WITH l AS (SELECT l_orderkey AS id, l_linenumber AS n, min(l_partkey) AS p, min(l_returnflag) AS f FROM lineitem GROUP BY ALL),
r AS (SELECT id, n, p, CASE WHEN p % 4 = 0 THEN 'Z' ELSE f END AS f FROM l WHERE p % 7 <> 0),
i AS (SELECT a.id AS a, b.id AS b FROM (SELECT DISTINCT id FROM l) a FULL JOIN (SELECT DISTINCT id FROM r) b ON a.id = b.id),
j AS (SELECT l.id AS a, r.id AS b, l.f = r.f AS same FROM l FULL JOIN r ON l.id = r.id AND l.n = r.n)
SELECT 'root' AS level, count(*) AS total, count(*) FILTER (a = b) AS no_change, 0 AS changed, count(*) FILTER (b IS NULL) AS only_in_left FROM i
UNION ALL SELECT 'lines!', count(*), count(*) FILTER (same), count(*) FILTER (NOT same), count(*) FILTER (b IS NULL) FROM j"""


@query(_NESTED_DIFF)
def diff_nested(spark, d):
    result = _nested_diff(spark, d)
    stats = result.diff_stats_shards
    result.unpersist()
    rows = [(k or "root", s.total, s.no_change, s.changed, s.only_in_left) for k, s in stats.items()]
    return spark.createDataFrame(rows, "level string, total bigint, no_change bigint, changed bigint, only_in_left bigint")


@query("SELECT * FROM (VALUES ('o_orderkey', ' '), ('status', '-'), ('o_custkey', ' '), ('extra', '+')) t(column_name, side)")
def diff_schema(spark, d):
    orders = table(spark, d, "orders")
    left = orders.select("o_orderkey", F.col("o_orderstatus").alias("status"), "o_custkey")
    right = orders.select("o_orderkey", F.col("o_custkey").cast("int").alias("o_custkey"), F.lit(1).alias("extra"))
    r = compare_dataframes(left, right, ["o_orderkey"])
    return spark.createDataFrame(list(r.schema_diff_result.column_names_diff.items()), "column_name string, side string")


@query("SELECT 'o_orderkey' AS key")
def diff_key_inference(spark, d):
    orders = table(spark, d, "orders").select("o_orderstatus", "o_orderkey", "o_custkey")
    return spark.createDataFrame([(compare_dataframes(orders, orders).join_cols[0],)], "key string")


# --- schemas as text -------------------------------------------------------


@query("SELECT 'struct<r_regionkey:int,r_name:string>' AS simple, true AS json, true AS pretty")
def schema_text(spark, d):
    schema = table(spark, d, "region").schema
    back = schema_utils.schema_from_json(schema_utils.schema_to_json(schema)) == schema
    pretty = schema_utils.schema_from_json(schema_utils.schema_to_pretty_json(schema)) == schema
    return spark.createDataFrame([(schema_utils.schema_to_simple_string(schema), back, pretty)], "simple string, json boolean, pretty boolean")


# --- what has no columns of its own: reports, guards, files, streams, helpers ---


def _scratch(spark: SparkSession) -> str:
    """A new folder where the session keeps shared intermediate files; a temporary one only in one-process sessions."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='strata-')}"
    return f"{root.rstrip('/')}/query-{uuid.uuid4().hex}"


def _printed(f: Callable[[], object]) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        f()
    return out.getvalue()


def _lines(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(text.splitlines())), "pos int, line string")


def _lines_sql(lines: list[str]) -> str:
    rows = ", ".join(f"({k}, '{x}')" for k, x in enumerate(x.replace("'", "''") for x in lines))
    return f"SELECT * FROM (VALUES {rows}) t(pos, line)"


@query(_lines_sql(["root", " |-- r_regionkey: integer (nullable = true)", " |-- r_name: string (nullable = true)", ""]))
def nested_print_schema(spark, d):
    text = _printed(lambda: nested.print_schema(table(spark, d, "region"))).rstrip("\n")
    return _lines(spark, text + "\n\n")


@query(
    "SELECT 'lines' AS name, round(sum(n * n) / sum(n), 2) AS growth FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)"
    " UNION ALL SELECT 'nations', round(sum(n * n) / sum(n), 2) FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey) UNION ALL SELECT 'keys', 1.0"
)
def diff_growth(spark, d):
    found = [("lines", self_join_growth(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])), *zip(("nations", "keys"), growth_by_column(table(spark, d, "customer"), [F.col("c_nationkey"), F.col("c_custkey")]), strict=True)]
    return spark.createDataFrame(found, "name string, growth double")


@query(
    "SELECT * FROM (VALUES ('growing join', 'CombinatorialExplosionError'), ('no key', 'DataframeComparisonException'), ('unknown key', 'AnalysisException'), ('no file', 'FileNotFoundError'),"
    " ('write mode', 'IllegalArgumentException'), ('file exists', 'FileAlreadyExistsError'), ('assertion', 'AssertionError'), ('module', 'ImportError')) t(step, error)"
)
def refusals(spark, d):
    customer, path = table(spark, d, "customer"), f"{_scratch(spark)}/a.txt"
    filesystem.write_file("x", path)
    steps = {
        "growing join": lambda: compare_dataframes(customer, customer, ["c_nationkey"]),
        "no key": lambda: compare_dataframes(customer.select("c_nationkey"), customer.select("c_nationkey")),
        "unknown key": lambda: compare_dataframes(customer, customer, ["nope"]),
        "no file": lambda: filesystem.read_file(path + ".none"),
        "write mode": lambda: filesystem.write_file("y", path, "other"),
        "file exists": lambda: filesystem.write_file("y", path),
        "assertion": lambda: utils.assert_true(False, "no"),
        "module": lambda: utils.load_external_module("no_such_module"),
    }
    rows = []
    for step, f in steps.items():
        try:
            with contextlib.redirect_stdout(io.StringIO()):
                f()
            rows.append((step, "none"))
        except Exception as e:  # noqa: BLE001  the query reports what is raised
            rows.append((step, type(e).__name__))
    return spark.createDataFrame(rows, "step string, error string")


@query("SELECT count(*) AS total, count(*) FILTER (id % 5 <> 0) AS no_change, count(*) FILTER (id % 5 = 0) AS changed FROM (SELECT DISTINCT l_orderkey AS id FROM lineitem)")
def diff_array_order(spark, d):
    left = order_lines(spark, d)
    turned = F.reverse("lines")
    right = left.select("id", F.when(F.col("id") % 5 == 0, F.concat(turned, F.slice("lines", 1, 1))).otherwise(turned).alias("lines"))
    s = compare_dataframes(left, right, ["id"]).diff_stats_shards[""]
    return spark.createDataFrame([(s.total, s.no_change, s.changed)], "total bigint, no_change bigint, changed bigint")


_NULL_KEYS = "SELECT CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END AS a, CASE WHEN o_orderkey % 3 <> 0 OR o_orderkey % 4 <> 0 THEN o_orderkey ELSE -o_orderkey END AS b, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS s, o_orderkey AS k FROM orders"


@query(
    f"WITH l AS ({_NULL_KEYS}), r AS (SELECT a, b, CASE WHEN k % 7 = 0 THEN 'Z' ELSE s END AS s FROM l WHERE k % 11 <> 0), j AS (SELECT l.b AS lb, r.b AS rb, l.s IS NOT DISTINCT FROM r.s AS same FROM l FULL JOIN r ON l.a IS NOT DISTINCT FROM r.a AND l.b IS NOT DISTINCT FROM r.b)"
    " SELECT count(*) AS total, count(*) FILTER (lb IS NOT NULL AND rb IS NOT NULL AND same) AS no_change, count(*) FILTER (lb IS NOT NULL AND rb IS NOT NULL AND NOT same) AS changed, count(*) FILTER (rb IS NULL) AS only_in_left, count(*) FILTER (lb IS NULL) AS only_in_right FROM j"
)
def diff_null_keys(spark, d):
    k = F.col("o_orderkey")
    whole = table(spark, d, "orders").select(F.when(k % 4 != 0, F.col("o_custkey")).alias("a"), F.when((k % 3 != 0) | (k % 4 != 0), k).otherwise(-k).alias("b"), F.when(k % 5 != 0, F.col("o_orderstatus")).alias("s"), k.alias("k"))
    right = whole.where(k % 11 != 0).select("a", "b", F.when(F.col("k") % 7 == 0, "Z").otherwise(F.col("s")).alias("s"))
    s = compare_dataframes(whole.drop("k"), right, ["a", "b"]).diff_stats_shards[""]
    names = ["total", "no_change", "changed", "only_in_left", "only_in_right"]
    return spark.createDataFrame([tuple(getattr(s, n) for n in names)], ", ".join(f"{n} bigint" for n in names))


_TOP = "SELECT column_name, state, lv, rv, nb, id, row_number() OVER (PARTITION BY column_name, state ORDER BY nb DESC, lv NULLS FIRST, rv NULLS FIRST) AS row_num FROM (SELECT column_name, state, lv, rv, count(*) AS nb, min('{\"o_orderkey\":' || k || '}') AS id FROM v GROUP BY ALL)"


@query(_DIFF + f"SELECT lk AS left_key, rk AS right_key FROM j WHERE '{{\"o_orderkey\":' || coalesce(lk, rk) || '}}' IN (SELECT id FROM ({_TOP}) WHERE row_num <= 2)")
def diff_samples(spark, d):
    (df,) = _diff(spark, d).get_sample_df_shards(2)
    return df.select(F.col("o_orderkey.left_value").alias("left_key"), F.col("o_orderkey.right_value").alias("right_key"))


@query(_DIFF + f"SELECT column_name, state, coalesce(lv, rv) AS value, CASE WHEN state = 'changed' THEN rv END AS other, nb FROM ({_TOP}) WHERE row_num <= 3")
def diff_column_values(spark, d):
    per = _diff(spark, d).get_diff_per_col_df(3)
    parts = [per.select("column_name", F.lit("changed").alias("state"), F.inline("diff.changed")).select("column_name", "state", F.col("left_value").alias("value"), F.col("right_value").alias("other"), "nb")]
    for state in ("no_change", "only_in_left", "only_in_right"):
        parts.append(per.select("column_name", F.lit(state).alias("state"), F.inline(F.col("diff")[state])).select("column_name", "state", "value", F.lit(None).cast("string").alias("other"), "nb"))
    return functools.reduce(DataFrame.unionAll, parts)


@query("WITH n AS (SELECT count(*) AS n FROM nation) SELECT * FROM (SELECT 'same' AS step, true AS same_schema, true AS same_data, true AS is_ok, n AS total FROM n UNION ALL SELECT 'column', false, false, false, n FROM n UNION ALL SELECT 'values', true, false, false, n FROM n UNION ALL SELECT 'type', false, true, false, n FROM n)")
def diff_flags(spark, d):
    n = table(spark, d, "nation")
    others = {"same": n, "column": n.withColumn("more", F.lit(1)), "values": n.withColumn("n_name", F.lower("n_name")), "type": n.withColumn("n_regionkey", F.col("n_regionkey").cast("bigint"))}
    found = [(k, compare_dataframes(n, other, ["n_nationkey"])) for k, other in others.items()]
    return spark.createDataFrame([(k, r.same_schema, r.same_data, r.is_ok, r.total_nb_rows) for k, r in found], "step string, same_schema boolean, same_data boolean, is_ok boolean, total bigint")


@query(_lines_sql(["Schema: ok (2 columns)", "diff NOT ok", "Row count changed: ", "old: 5 rows", "new: 4 rows (1 less)", "3 (60.0%) rows are identical", "1 (20.0%) rows have changed", "1 (20.0%) rows are only in 'old'", "0 (0.0%) rows are only in 'new'"]))
def diff_report(spark, d):
    left = table(spark, d, "region")
    right = left.where("r_regionkey > 0").withColumn("r_name", F.when(F.col("r_regionkey") == 4, "X").otherwise(F.col("r_name")))
    r = compare_dataframes(left, right, ["r_regionkey"])
    said = _printed(lambda: r.display(diff_format_options=DiffFormatOptions(left_df_alias="old", right_df_alias="new")))
    return _lines(spark, "\n".join(x for x in said.splitlines() if x and not x.startswith(("+", "|", "Found", "Most")) and "only found" not in x))


@query("SELECT true AS is_page, true AS has_title, true AS shows_change, true AS escaped")
def diff_html(spark, d):
    left = table(spark, d, "region")
    r = compare_dataframes(left, left.withColumn("r_name", F.when(F.col("r_regionkey") == 4, "<b>X").otherwise(F.col("r_name"))), ["r_regionkey"])
    path = f"{_scratch(spark)}/report.html"
    r.export_to_html("Regions & more", path)
    page = filesystem.read_file(path)
    return spark.createDataFrame([("<html" in page, "Regions &amp; more" in page, "&lt;b&gt;X" in page, "<b>X" not in page)], "is_page boolean, has_title boolean, shows_change boolean, escaped boolean")


@query("SELECT * FROM (VALUES ('written', 'one'), ('appended', 'one two'), ('replaced', 'three é'), ('listed', 'a.txt sub/b.txt'), ('copied file', 'three é'), ('copied folder', 'a.txt=three é sub/b.txt=b')) t(step, text)")
def files(spark, d):
    folder = _scratch(spark)
    path, rows = f"{folder}/a.txt", []
    for step, text, mode in (("written", "one", "error_if_exists"), ("appended", " two", "append"), ("replaced", "three é", "overwrite")):
        filesystem.write_file(text, path, mode)
        rows.append((step, filesystem.read_file(path)))
    filesystem.write_file("b", f"{folder}/sub/b.txt")
    rows.append(("listed", " ".join(sorted(x.split(folder.split("/")[-1] + "/")[1] for x in filesystem.recursively_list_all_files_in_folder(folder)))))
    # copies are local by their nature: what they hold comes back in the result
    with tempfile.TemporaryDirectory() as local:
        filesystem.copy_to_local_file(path, f"{local}/c.txt")
        filesystem.copy_to_local_folder(folder, f"{local}/all")
        rows.append(("copied file", Path(f"{local}/c.txt").read_text(encoding="utf8")))
        rows.append(("copied folder", " ".join(f"{x}={Path(local, 'all', x).read_text(encoding='utf8')}" for x in ("a.txt", "sub/b.txt"))))
    return spark.createDataFrame(rows, "step string, text string")


@query("SELECT c_custkey AS id, 'name' AS key, upper(c_name) AS value FROM customer UNION ALL SELECT c_custkey, 'segment', upper(c_mktsegment) FROM customer")
def stream_row_wise(spark, d):
    """A stream of files through row-wise operators into Parquet files."""
    folder = _scratch(spark)
    table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).alias("s")).repartition(3).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).parquet(f"{folder}/in")
    upper = lambda c, t: F.upper(c) if isinstance(t, T.StringType) else None
    steps = ((nested.select, {"id": None, "name": lambda df: df["s.name"], "segment": lambda df: df["s.segment"]}), (tr.transform_all_fields, upper), (tr.unpivot, ["id"]))
    run_available(transform_stream(stream, *steps), f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out")


@query("SELECT * FROM (VALUES (0, 'a'), (1, 'b!'), (2, 'c!.d'), (3, 'm%key'), (4, 'm%value')) t(pos, field)")
def schema_from_simple_string(spark, d):
    schema = schema_utils.schema_from_simple_string("struct<a:int,b:array<string>,c:array<struct<d:double>>,m:map<string,int>>")
    return spark.createDataFrame(list(enumerate(nested.fields(spark.createDataFrame([], schema)))), "pos int, field string")


@query("SELECT * FROM (VALUES ('show', '+-----------+| 1||r_regionkey|| 0|'), ('schema', ' |-- r_regionkey: integer (nullable = true)'), ('margin', 'a/ b'), ('group', '1:a,c 2:b'), ('module', 'json'), ('session', 'true'), ('type', 'double'), ('no type', 'none')) t(name, value)")
def helpers(spark, d):
    one = table(spark, d, "region").where("r_regionkey = 0").select("r_regionkey")
    field = lambda t: T.StructField("x", t)
    rows = [
        ("show", "+-----------+| 1||r_regionkey|| 0|" if utils.show_string(one).split() == ["+-----------+", "|r_regionkey|", "+-----------+", "|", "0|", "+-----------+"] else utils.show_string(one)),
        ("schema", utils.schema_string(one).splitlines()[1]),
        ("margin", "/".join(utils.strip_margin("\n  |a\n  | b\n").splitlines())),
        ("group", " ".join(f"{k}:{','.join(v)}" for k, v in utils.group_by_key([(1, "a"), (2, "b"), (1, "c")]).items())),
        ("module", utils.load_external_module("json").__name__),
        ("session", str(utils.get_instantiated_spark_session() is not None).lower()),
        ("type", data_type_utils.find_common_type_for_fields(field(T.LongType()), field(T.DoubleType()))),
        ("no type", str(data_type_utils.find_common_type_for_fields(field(T.LongType()), field(T.ArrayType(T.LongType())))).lower()),
    ]
    return spark.createDataFrame(rows, "name string, value string")


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS name FROM nation")
def nullable_nulls(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), SF.nullable(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name"))).alias("name"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id % 3 AS first, CAST(5 AS BIGINT) AS second FROM events")
def parse_json_several(spark, d):
    df = table(spark, d, "events").select("event_id", "props", F.concat(F.lit("["), (F.col("event_id") % 3).cast("string"), F.lit(", 5]")).alias("list"))
    return tr.parse_json_columns(df, {"props": "p", "list": "q"}).select("event_id", "p.k", F.col("q")[0].alias("first"), F.col("q")[1].alias("second"))


_CYCLES = "SELECT c_custkey AS id, CASE WHEN c_custkey <= 3 THEN c_custkey % 3 + 1 WHEN c_custkey = 4 THEN 1 WHEN c_custkey > 5 THEN c_custkey // 2 END AS parent FROM customer"


@query(f"WITH RECURSIVE n AS ({_CYCLES}), up AS (SELECT id, id AS cur, 0 AS k FROM n UNION ALL SELECT up.id, n.parent, k + 1 FROM up JOIN n ON n.id = up.cur WHERE n.parent IS NOT NULL AND k < 40), ends AS (SELECT up.id, cur FROM up JOIN n ON n.id = up.cur WHERE n.parent IS NULL) SELECT n.id, ends.cur AS parent FROM n LEFT JOIN ends ON ends.id = n.id")
def forest_with_cycles(spark, d):
    k = F.col("c_custkey")
    df = table(spark, d, "customer").select(k.alias("id"), F.when(k <= 3, k % 3 + 1).when(k == 4, 1).when(k > 5, F.floor(k / 2)).alias("parent"))
    return graph.ascending_forest_traversal(df, "id", "parent")


def entry(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: a profile, at both granularities, of orders joined with their lines."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderstatus")
    return tr.analyze(orders.join(order_lines(spark, d), "id"))
