import pytest
from pyspark.sql import functions as F

from strata import nested, nested_functions as nf
from strata.errors import AnalysisException


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


@pytest.fixture(scope="module")
def df(spark):
    return spark.sql("""SELECT 1 AS id, ARRAY(STRUCT(2 AS a, ARRAY(STRUCT(3 AS c, 4 AS d)) AS b, ARRAY(5, 6) AS e)) AS s1,
        STRUCT(7 AS f) AS s2, ARRAY(ARRAY(1, 2), ARRAY(3, 4)) AS s3, ARRAY(ARRAY(STRUCT(1 AS e, 2 AS f)), ARRAY(STRUCT(3 AS e, 4 AS f))) AS s4""")


def test_fields(df):
    assert nested.fields(df) == ["id", "s1!.a", "s1!.b!.c", "s1!.b!.d", "s1!.e!", "s2.f", "s3!!", "s4!!.e", "s4!!.f"]
    assert nested.fields(df, keep_non_leaf_fields=True)[:4] == ["id", "s1", "s1!", "s1!.a"]
    assert nested.schema_string(df).splitlines()[:2] == ["root", " |-- id: integer (nullable = false)"]


def test_with_fields_keeps_everything(df):
    out = nested.with_fields(df, {"s5.g": F.col("s2.f").cast("DOUBLE")})
    assert out.drop("s5").schema == df.schema
    assert rows(out.drop("s5")) == rows(df) and rows(out)[0]["s5"] == {"g": 7.0}


def test_transformations_by_arity(df):
    out = nested.select(df, {
        "id": None,
        "s1!.a": lambda s: s["a"] + 1,
        "s1!.b!.x": lambda root, s, b: root["id"] + s["a"] + b["c"],
        "s1!.b!.c": lambda b: b["c"].cast("string"),
        "s1!.n": "id",
        "s1!.z": lambda: F.lit("z"),
        "s3!!": lambda x: x * 10,
        "s2.f": lambda d: d["s2"]["f"] + 1,
    })
    assert rows(out) == [{"id": 1, "s1": [{"a": 3, "b": [{"x": 6, "c": "3"}], "n": 1, "z": "z"}], "s3": [[10, 20], [30, 40]], "s2": {"f": 8}}]


def test_replace_whole_field(df):
    out = nested.with_fields(df, {"s1": F.lit(1), "s2": lambda d: F.struct(F.lit(0).alias("y"))})
    assert out.columns == df.columns and rows(out)[0]["s1"] == 1 and rows(out)[0]["s2"] == {"y": 0}


def test_maps(spark):
    df = spark.sql("SELECT MAP('a', STRUCT(1 AS x), 'b', STRUCT(2 AS x)) AS m, ARRAY(STRUCT(5 AS p, MAP(1, 2) AS q)) AS r")
    both = nested.select(df, {"m%value.x": lambda v: v["x"] + 1, "m%key": lambda k: F.upper(k)})
    assert rows(both) == [{"m": {"A": {"x": 2}, "B": {"x": 3}}}]
    assert rows(nested.select(df, {"m%value.x": lambda v: v["x"] * 2})) == [{"m": {"a": {"x": 2}, "b": {"x": 4}}}]
    inner = nested.select(df, {"r!.q%value": lambda s, v: s["p"] + v})
    assert rows(inner) == [{"r": [{"q": {1: 7}}]}]


def test_null_structs_stay(spark):
    df = spark.createDataFrame([(1, None, [None, (3,)])], "id INT, s STRUCT<a: INT>, arr ARRAY<STRUCT<b: INT>>")
    out = nested.with_fields(df, {"s.x": F.lit(1), "arr!.y": lambda e: F.lit(2)})
    assert rows(out) == [{"id": 1, "s": None, "arr": [None, {"b": 3, "y": 2}]}]


def test_errors(df):
    with pytest.raises(AnalysisException, match="does not exist.*s1"):
        nested.select(df, {"s!.a": None})
    with pytest.raises(AnalysisException):
        nested.select(df, {"id.x": F.lit(1)})
    with pytest.raises(AnalysisException):
        nested.with_fields(df, {"new!.x": F.lit(1)})
    with pytest.raises(AnalysisException, match="does not exist"):
        nested.unnest_field(df, "nope!")


def test_unnest(df):
    assert rows(nested.unnest_field(df, "s3!!", keep_columns=["id"])) == [{"id": 1, "s3!!": k} for k in (1, 2, 3, 4)]
    assert rows(nested.unnest_field(df, "s1!.b!")) == [{"s1!.b!": {"c": 3, "d": 4}}]
    every = nested.unnest_all_fields(df, keep_columns=["id"])
    assert list(every) == ["s1!", "s1!.b!", "s1!.e!", "", "s3!!", "s4!!"] or set(every) == {"", "s1!", "s1!.b!", "s1!.e!", "s3!!", "s4!!"}
    assert rows(every["s4!!"]) == [{"id": 1, "s4!!.e": 1, "s4!!.f": 2}, {"id": 1, "s4!!.e": 3, "s4!!.f": 4}]
    assert every["s1!.e!"].columns == ["id", "s1!.e!"]


def test_unnest_drops_empty_arrays(spark):
    df = spark.createDataFrame([(1, []), (2, None), (3, [7])], "id INT, a ARRAY<INT>")
    assert rows(nested.unnest_field(df, "a!", ["id"])) == [{"id": 3, "a!": 7}]


def test_folds(spark):
    df = spark.sql("""SELECT 1 AS id, ARRAY(STRUCT(1 AS a), STRUCT(2 AS a)) AS s1, ARRAY(ARRAY(1, 2), ARRAY(3)) AS s2,
        ARRAY(STRUCT(ARRAY(1, 2) AS a), STRUCT(ARRAY(4) AS a)) AS s4, ARRAY(1.5D, 2D) AS d, ARRAY(1.25, 2.50) AS dec, CAST(ARRAY() AS ARRAY<INT>) AS none""")
    out = df.select(
        nf.sum("id").alias("a"), nf.sum("s1!.a").alias("b"), nf.sum("s2!!").alias("c"), nf.sum("s4!.a!").alias("d"), nf.sum("d!", df).alias("e"), nf.sum("dec!", df).alias("f"),
        nf.average("s2!!").alias("g"), nf.average("none!").alias("h"), nf.average("d!", df).alias("i"),
        nf.aggregate("s4!.a!", F.lit(1).cast("bigint"), lambda acc, x: acc * x, lambda x: x.cast("bigint"), lambda acc: acc + 100).alias("j"),
    )
    r = out.first()
    assert (r.a, r.b, r.c, r.d, r.e, float(r.f), r.g, r.h, r.i, r.j) == (1, 3, 6, 7, 3.5, 3.75, 2.0, None, 1.75, 108)
    inner = nested.select(df, {"s4!.total": lambda s: nf.sum("a!", s)})
    assert rows(inner) == [{"s4": [{"total": 3}, {"total": 4}]}]
    with pytest.raises(AnalysisException):
        nf.sum("m%value")


def test_fold_null(spark):
    df = spark.createDataFrame([([1, None],), (None,)], "a ARRAY<INT>")
    assert [r[0] for r in df.select(nf.sum("a!")).collect()] == [None, None]
