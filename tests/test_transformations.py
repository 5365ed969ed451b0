import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata import functions as SF
from strata import graph, transformations as tr
from strata.errors import IllegalArgumentException
from strata.operators import profile


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_analyze(spark, capsys):
    df = spark.sql("SELECT 1 AS id, STRUCT(2 AS b, 3 AS c) AS a, ARRAY(1, 2, 3) AS arr")
    assert [(r.column_number, r.column_name, r.column_type, r["count"], r.count_distinct, r.count_null, r["min"], r["max"]) for r in tr.analyze(df).collect()] == [
        (0, "id", "INTEGER", 1, 1, 0, "1", "1"), (1, "a.b", "INTEGER", 1, 1, 0, "2", "2"), (2, "a.c", "INTEGER", 1, 1, 0, "3", "3"), (3, "arr!", "INTEGER", 3, 3, 0, "1", "3"),
    ]
    assert "Analyzing 4 columns ..." in capsys.readouterr().out
    by = tr.analyze(df, group_by="a.b").collect()
    assert [(r.group.b, r.column_number) for r in by] == [(2, 0), (2, 2), (2, 3)]
    whole = tr.analyze(df, group_by="a").collect()
    assert [(r.group.a.b, r.column_number, r["count"]) for r in whole] == [(2, 0, 1), (2, 3, 3)]
    words = tr.analyze(spark.sql("SELECT 1 AS `FROM`, STRUCT('a' AS `ALL`) AS `UNION`, CAST('/+A=' AS BINARY) AS s")).collect()
    assert [(r.column_name, r.column_type, r["min"]) for r in words] == [("FROM", "INTEGER", "1"), ("UNION.ALL", "STRING", "a"), ("s", "BINARY", "/+A=")]


def test_analyze_custom(spark):
    df = spark.sql("SELECT explode(ARRAY(1, 2, 2)) AS x")
    total = lambda col, field, k: F.sum(col).alias("total")
    assert rows(tr.analyze(df, _aggs=[profile.column_name, total])) == [{"column_name": "x", "total": 5}]


def test_maps_to_arrays(spark):
    df = spark.sql("SELECT ARRAY(MAP(1, STRUCT(MAP(2, 'a') AS m2))) AS m1")
    assert rows(tr.convert_all_maps_to_arrays(df)) == [{"m1": [[{"key": 1, "value": {"m2": [{"key": 2, "value": "a"}]}}]]}]


def test_flatten_unflatten(spark):
    df = spark.createDataFrame([(1, 1, 2, 3), (2, None, None, None), (3, None, None, 5)], "id INT, `s.a` INT, `s.b.c` INT, `s.b.d` INT")
    nested = tr.unflatten(df)
    assert rows(nested) == [{"id": 1, "s": {"a": 1, "b": {"c": 2, "d": 3}}}, {"id": 2, "s": None}, {"id": 3, "s": {"a": None, "b": {"c": None, "d": 5}}}]
    assert rows(tr.flatten(nested)) == rows(df)
    assert tr.flatten(nested, "_").columns == ["id", "s_a", "s_b_c", "s_b_d"]
    other = tr.unflatten(spark.createDataFrame([(1, 2)], "`s.s1?a.a1` INT, `s.s1?b.b1` INT"), "?")
    assert rows(other) == [{"s.s1": {"a.a1": 1, "b.b1": 2}}]
    merged = tr.unflatten(spark.sql("SELECT STRUCT(1 AS s1) AS s, 2 AS `s.s2`"))
    assert rows(merged) == [{"s": {"s1": 1, "s2": 2}}]


def test_arrays(spark):
    df = spark.sql("SELECT ARRAY(ARRAY(ARRAY(3, 1)), ARRAY(ARRAY(2, NULL))) AS a, ARRAY(STRUCT(2 AS x, ARRAY(2, 1) AS y), STRUCT(1 AS x, ARRAY(0) AS y)) AS b")
    assert rows(tr.flatten_all_arrays(df.select("a"))) == [{"a": [3, 1, 2, None]}]
    assert rows(tr.sort_all_arrays(df)) == [{"a": [[[None, 2]], [[1, 3]]], "b": [{"x": 1, "y": [0]}, {"x": 2, "y": [1, 2]}]}]


def test_transform_all(spark):
    df = spark.sql("SELECT 1 AS id, STRUCT(ARRAY(2) AS `b!.%`, MAP('k', 3) AS m) AS s")
    doubled = tr.transform_all_fields(df, lambda c, t: c.cast("double") if isinstance(t, T.IntegerType) else None)
    assert doubled.schema.simpleString() == "struct<id:double,s:struct<b!.%:array<double>,m:map<string,double>>>"
    up = tr.transform_all_field_names(df, lambda n: n.upper())
    assert up.schema.simpleString() == "struct<ID:int,S:struct<B!.%:array<int>,M:map<string,int>>>" and rows(up) == [{"ID": 1, "S": {"B!.%": [2], "M": {"k": 3}}}]


def test_null_struct_survives_rewrite(spark):
    df = spark.createDataFrame([(None,)], "s STRUCT<a: ARRAY<INT>>")
    assert rows(tr.sort_all_arrays(df)) == [{"s": None}] and rows(tr.transform_all_field_names(df, str.upper)) == [{"S": None}]


def test_harmonize(spark):
    a = spark.sql("SELECT 1 AS id, STRUCT(2 AS a, ARRAY(STRUCT(3 AS b, 4 AS c)) AS s2) AS s1")
    b = spark.sql('SELECT 1 AS id, STRUCT(2 AS a, ARRAY(STRUCT(3.0 AS b, "4" AS c, 5 AS d)) AS s2) AS s1')
    x, y = tr.harmonize_dataframes(a, b)
    assert x.schema.simpleString() == y.schema.simpleString() and x.union(y).count() == 2
    x, y = tr.harmonize_dataframes(a, b, common_columns={"id": None, "s1.s2!.b": "int"})
    assert rows(x.union(y)) == [{"id": 1, "s1": {"s2": [{"b": 3}]}}] * 2
    x, y = tr.harmonize_dataframes(spark.sql("SELECT 1 AS a, MAP(1, 2) AS m, 3 AS own"), spark.sql("SELECT 1L AS a, MAP(1, 2L) AS m"), keep_missing_columns=True)
    assert x.columns == ["a", "m", "own"] and y.columns == ["a", "m"] and x.schema["m"].dataType == y.schema["m"].dataType


def test_parse_json(spark):
    df = spark.createDataFrame([(1, '[{"a": 1}, {"a": 2}]', '{"x": "y"}', None), (2, None, "[]" if False else None, None)], "id INT, j1 STRING, j2 STRING, j3 STRING")
    out = tr.parse_json_columns(df, ["j1", "j2"])
    assert rows(out.orderBy("id")) == [{"id": 1, "j1": [{"a": 1}, {"a": 2}], "j2": {"x": "y"}, "j3": None}, {"id": 2, "j1": None, "j2": None, "j3": None}]
    kept = tr.parse_json_columns(df, {"j1": "p"})
    assert kept.columns == ["id", "j1", "j2", "j3", "p"]
    inside = tr.parse_json_columns(df.select("id", F.struct("j1").alias("s")), "s.j1")
    assert inside.columns == ["id", "s", "s.j1"] and inside.where("id = 1").first()["s.j1"][1].a == 2
    assert tr.parse_json_columns(df, "j3").schema["j3"].dataType == T.StringType()


def test_union_and_unpivot(spark):
    a = spark.sql("SELECT 1 AS x, 2 AS y")
    assert tr.union_dataframes(a, a, a).count() == 3
    with pytest.raises(ValueError):
        tr.union_dataframes()
    df = spark.createDataFrame([(2018, "Orange", None, 4000)], "year INT, `product.type` STRING, `c.Canada` INT, China INT")
    out = tr.unpivot(df, ["year", "product.type"], key_alias="country", value_alias="total")
    assert rows(out) == [{"year": 2018, "product.type": "Orange", "country": "c.Canada", "total": None}, {"year": 2018, "product.type": "Orange", "country": "China", "total": 4000}]
    with pytest.raises(AssertionError):
        tr.unpivot(df, ["year"])


def test_generic_typed_struct(spark, capsys):
    df = spark.sql("SELECT 1 AS id, STRUCT('a' AS `first.name`, 2Y AS age, true AS ok, 1.5BD AS dec, ARRAY(1) AS arr, timestamp_ntz'2020-01-01 00:00:00' AS t) AS `p.s`")
    out = tr.with_generic_typed_struct(df, ["`p.s`"])
    got = rows(out)[0]["p.s"]
    assert [(x["key"], x["type"], {k: v for k, v in x["value"].items() if v is not None}) for x in got] == [
        ("first.name", "string", {"string": "a"}), ("age", "tinyint", {"int": 2}), ("ok", "boolean", {"boolean": True}), ("dec", "decimal(2,1)", {"float": 1.5}), ("t", "timestamp_ntz", {"timestamp": datetime.datetime(2020, 1, 1)}),
    ]
    assert "WARNING" in capsys.readouterr().out


def test_column_functions(spark):
    df = spark.sql("SELECT ARRAY(1, 2) AS a, ARRAY(2, 3) AS b, ARRAY(4, 4) AS c, 1 AS `x.y`")
    r = df.select(SF.array_union("a", "b", "c").alias("u"), SF.array_union("c").alias("one"), SF.empty_array("struct<k:int>").alias("e"), SF.generic_struct("x.y").alias("g"), SF.nullable(F.lit(1)).alias("n"))
    assert rows(r) == [{"u": [1, 2, 3, 4], "one": [4, 4], "e": [], "g": [{"name": "x.y", "value": "1"}], "n": 1}]
    assert r.schema["n"].nullable and r.schema["e"].dataType.simpleString() == "array<struct<k:int>>"
    with pytest.raises(IllegalArgumentException):
        SF.array_union()


def test_forest(spark):
    def run(pairs):
        df = spark.createDataFrame(pairs, "id INT, parent INT")
        return {r.id: r.parent for r in graph.ascending_forest_traversal(df, "id", "parent").collect()}

    assert run([(1, 2), (2, 3), (3, 3)]) == {1: 3, 2: 3, 3: 3}
    assert run([(1, 2), (2, 3), (3, 1)]) == {1: None, 2: None, 3: None}
    assert run([(1, 2), (2, 3), (3, 4)]) == {1: 4, 2: 4, 3: 4}
    chain = [(i, i + 1) for i in range(1, 40)] + [(40, None), (100, 101), (101, 102), (102, 101), (200, 200)]
    want = {i: 40 for i in range(1, 41)} | {100: None, 101: None, 102: None, 200: 200}
    assert run(chain) == want
    df = spark.createDataFrame([(4, 5, "a"), (5, 6, "b"), (6, None, "c")], "`x.id` INT, `x.up` INT, `x.name` STRING")
    out = graph.ascending_forest_traversal(df, "x.id", "x.up", keep_labels=True)
    assert {(r["x.id"], r["x.up"], r.node["x.name"], r.furthest_ancestor["x.name"]) for r in out.collect()} == {(4, 6, "a", "c"), (5, 6, "b", "c"), (6, 6, "c", "c")}
    with pytest.raises(AssertionError):
        graph.ascending_forest_traversal(df, "nope", "x.up")
