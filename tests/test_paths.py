import pytest
from pyspark.sql import types as T

from strata.errors import AnalysisException
from strata.plans import paths as P
from strata.plans.schema import common_type, flatten_schema, schema_from_json, schema_from_simple_string, schema_to_json, schema_to_pretty_json, schema_to_simple_string


@pytest.mark.parametrize("path", ["a", "s.a", "a!", "a!!", "a!.b", "m%key", "m%value.a", "s1!.b!.c", "a!%value"])
def test_round_trip(path):
    assert P.text(P.parse(path)) == path


@pytest.mark.parametrize("path", ["a!b", "m%", "m%keys", ".a", "a..b", "a.", "!a", "%key", "m%keyx"])
def test_malformed(path):
    with pytest.raises(AnalysisException):
        P.parse(path)


def test_granularity():
    assert P.get_granularity("a!.b!.c") == "a!.b!"
    assert P.get_granularity("a.b") == ""
    assert P.has_same_granularity("a!.b", "a!.c.d")
    assert P.has_same_or_higher_granularity("s!.a", "s!.ss!.b")
    assert not P.has_same_or_higher_granularity("s!.ss!.b", "s!.a")
    assert P.is_sub_field("a.b", "a") and not P.is_sub_field("a.b!", "a") and P.is_sub_field_or_equal("a.b!", "a")
    assert P.is_parent_field("a", "a!.b") and not P.is_parent_field("a", "ab")
    assert P.substring_before_last_occurrence("a.b.c", ".") == "a.b"


def test_names():
    assert P.quote("a`b") == "`a``b`" and P.unquote("`a``b`") == "a`b"
    assert P.quote_idempotent("`a`") == "`a`"
    assert P.split_col_name("a.`b.c`.`d``e`") == ["a", "b.c", "d`e"]


def test_flatten_schema(spark):
    schema = T.DataType.fromDDL("id INT NOT NULL, s STRUCT<a: INT>, m MAP<STRING, STRUCT<b: INT>>, e ARRAY<ARRAY<INT>>")
    assert flatten_schema(schema, explode=True).names == ["id", "s.a", "m%key", "m%value.b", "e!!"]
    assert flatten_schema(schema, explode=False).names == ["id", "s.a", "m", "e"]
    flat = flatten_schema(schema, explode=True, keep_non_leaf_fields=True)
    assert flat.names == ["id", "s", "s.a", "m", "m%key", "m%value", "m%value.b", "e", "e!", "e!!"]


def _t(x):
    return T.DataType.fromDDL(x)


def test_common_type_follows_spark(spark):
    jvm = spark._jvm
    coercion = jvm.org.apache.spark.sql.catalyst.analysis.TypeCoercion
    names = ["tinyint", "smallint", "int", "bigint", "float", "double", "decimal(10,2)", "decimal(15,6)", "string", "boolean", "date", "timestamp", "binary", "array<int>", "array<string>", "void"]
    for a in names:
        for b in names:
            found = coercion.findWiderTypeForTwo(*(jvm.org.apache.spark.sql.types.DataType.fromJson(_t(x).json()) for x in (a, b)))
            want = found.get().simpleString() if found.isDefined() else None
            got = common_type(_t(a), _t(b))
            assert (got and got.simpleString()) == want, (a, b)


def test_schema_text(spark):
    schema = _t("a INT, b ARRAY<STRING>")
    assert schema_from_json(schema_to_json(schema)) == schema
    assert schema_from_simple_string("a: int, b: array<string>") == schema
    assert schema_from_simple_string(schema_to_simple_string(schema)) == schema
    assert schema_to_pretty_json(_t("a INT")).startswith('{\n  "fields": [')


def test_type_questions(spark):
    from strata import data_type_utils as D
    from strata import field_utils

    schema = _t("a INT NOT NULL, b ARRAY<STRUCT<c: INT>>, s STRUCT<x: DATE>")
    a, b, s = schema.fields
    assert D.is_repeated(b) and not D.is_repeated(a) and D.is_struct(s) and not D.is_nullable(a)
    assert D.find_wider_type_for_two(_t("int"), _t("string")) == "string" and D.find_wider_type_for_two(_t("int"), _t("boolean")) is None
    assert D.get_common_columns(schema, _t("s STRUCT<x: TIMESTAMP>, a BIGINT, b ARRAY<STRUCT<c: INT, d: INT>>")) == {"a": "bigint", "b!.c": None, "s.x": "timestamp"}
    assert field_utils.get_granularity("a!.b") == "a!"
