import pytest

from strata.data_diff import DiffFormatOptions, DiffStats, compare_dataframes
from strata.errors import AnalysisException, CombinatorialExplosionError


def stats(result, level=""):
    s = result.diff_stats_shards[level]
    return (s.total, s.no_change, s.changed, s.in_left, s.in_right, s.only_in_left, s.only_in_right)


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


CASES = {
    "same, with NULL": ([(1, "a"), (2, "b"), (3, None)], "id INT, x STRING", [(3, None), (1, "a"), (2, "b")], "id INT, x STRING", (3, 3, 0, 3, 3, 0, 0), True, True),
    "other key": ([(1, "a"), (2, "b"), (3, "c")], "id INT, x STRING", [(1, "a"), (2, "b"), (4, "c")], "id INT, x STRING", (4, 2, 0, 3, 3, 1, 1), True, False),
    "struct member": ([(1, (1, 2)), (2, (1, 2)), (3, (1, 2))], "id INT, a STRUCT<b: INT, c: INT>", [(1, (1, 2)), (2, (1, 3)), (3, (1, 2))], "id INT, a STRUCT<b: INT, c: INT>", (3, 2, 1, 3, 3, 0, 0), True, False),
    "array order": ([(1, [1, 2]), (2, [3])], "id INT, a ARRAY<INT>", [(1, [2, 1]), (2, [3])], "id INT, a ARRAY<INT>", (2, 2, 0, 2, 2, 0, 0), True, True),
    "empty and NULL array": ([(1, [])], "id INT, a ARRAY<INT>", [(1, None)], "id INT, a ARRAY<INT>", (1, 0, 1, 1, 1, 0, 0), True, False),
    "missing rows": ([(1, [1]), (2, []), (3, None)], "id INT, a ARRAY<INT>", [(1, [2])], "id INT, a ARRAY<INT>", (3, 0, 1, 3, 1, 2, 0), True, False),
    "members reordered": ([(1, [(1, "a")])], "id INT, a ARRAY<STRUCT<a: INT, b: STRING>>", [(1, [("a", 1)])], "id INT, a ARRAY<STRUCT<b: STRING, a: INT>>", (1, 1, 0, 1, 1, 0, 0), False, True),
    "key type": ([(1, "a"), (2, "b"), (3, "c")], "id INT, x STRING", [(1.0, "a"), (2.0, "b"), (3.0, "d")], "id DOUBLE, x STRING", (3, 2, 1, 3, 3, 0, 0), False, False),
    "column removed": ([(1, "a", "x"), (2, "b", "y"), (3, "c", "z")], "id INT, c STRING, x STRING", [(1, "a"), (2, "b"), (3, "c")], "id INT, c STRING", (3, 3, 0, 3, 3, 0, 0), False, False),
    "column renamed": ([(1, "a", 1), (2, "b", 2)], "id INT, c STRING, x INT", [(1, "a", 1), (3, "b", 2)], "id INT, c STRING, y INT", (3, 1, 0, 2, 2, 1, 1), False, False),
    "NULL key": ([(None, "a"), (1, "b")], "id INT, x STRING", [(None, "a"), (1, "c")], "id INT, x STRING", (2, 1, 1, 2, 2, 0, 0), True, False),
    "both empty": ([], "id INT, x STRING", [], "id INT, x STRING", (0, 0, 0, 0, 0, 0, 0), True, True),
    "-0.0 and NaN": ([(1, 0.0), (2, float("nan"))], "id INT, x DOUBLE", [(1, -0.0), (2, float("nan"))], "id INT, x DOUBLE", (2, 2, 0, 2, 2, 0, 0), True, True),
    "maps": ([(1, {"a": 1, "b": 2})], "id INT, m MAP<STRING, INT>", [(1, {"b": 2, "a": 1})], "id INT, m MAP<STRING, INT>", (1, 1, 0, 1, 1, 0, 0), True, True),
    "NULL members": ([(1, [None])], "id INT, a ARRAY<STRUCT<a: INT>>", [(1, [(None,)])], "id INT, a ARRAY<STRUCT<a: INT>>", (1, 0, 1, 1, 1, 0, 0), True, False),
}


@pytest.mark.parametrize("case", CASES)
def test_stats(spark, case):
    left, ls, right, rs, want, same_schema, same_data = CASES[case]
    r = compare_dataframes(table(spark, left, ls), table(spark, right, rs), ["id"])
    assert stats(r) == want and r.same_schema is same_schema and r.same_data is same_data and r.is_ok is (same_schema and same_data)


def test_self(spark):
    df = table(spark, [(1, "a"), (2, None)], "id INT, x STRING")
    assert compare_dataframes(df, df, ["id"]).is_ok


def test_composite_and_null_keys(spark):
    left = table(spark, [(1, None, "a"), (1, 1, "b"), (None, 2, "c"), (None, None, "d"), (2, 2, "e")], "k1 INT, k2 INT, x STRING")
    right = table(spark, [(1, None, "a"), (1, 1, "b"), (None, 2, "c"), (None, None, "x"), (2, 2, "e")], "k1 INT, k2 INT, x STRING")
    assert stats(compare_dataframes(left, right, ["k1", "k2"])) == (5, 4, 1, 5, 5, 0, 0)


def test_nested_keys(spark):
    schema = "id INT, s1 ARRAY<STRUCT<id: INT, a: STRING, ss: ARRAY<STRUCT<id: INT, a: STRING>>>>"
    left = table(spark, [(1, [(1, "a", [(1, "a"), (2, "b")]), (2, "a", [(1, "a")])])], schema)
    right = table(spark, [(1, [(1, "a", [(1, "x"), (3, "b")]), (2, "a", [(1, "a")])])], schema)
    r = compare_dataframes(left, right, ["id", "s1!.id", "s1!.ss!.id"])
    assert list(r.diff_stats_shards) == ["", "s1!", "s1!.ss!"]
    assert stats(r) == (1, 1, 0, 1, 1, 0, 0) and stats(r, "s1!") == (2, 2, 0, 2, 2, 0, 0) and stats(r, "s1!.ss!") == (4, 1, 1, 3, 3, 1, 1)
    r.display()


def test_inference_and_order(spark, capsys):
    df = table(spark, [(f"n{i % 3}", i, f"u{i}") for i in range(21)], "x STRING, id INT, s STRING")
    r = compare_dataframes(df, df.where("id < 20"))
    assert r.join_cols == ["id"] and "Found the following column: id" in capsys.readouterr().out
    assert list(r.schema_diff_result.column_names_diff) == ["x", "id", "s"] and r.total_nb_rows == 21
    nested = spark.sql("SELECT STRUCT(id AS id) AS s, 1 AS c FROM range(20)")
    assert compare_dataframes(nested, nested).join_cols == ["s.id"]


def test_errors(spark):
    a, b = table(spark, [(1, "a")], "id INT, x STRING"), table(spark, [(1, "a")], "k INT, x STRING")
    for left, right in ((a, b), (b, a)):
        with pytest.raises(AnalysisException, match="Field 'id' does not exist"):
            compare_dataframes(left, right, ["id"])
    twins = table(spark, [(1, "a"), (1, "b")], "id INT, x STRING")
    with pytest.raises(CombinatorialExplosionError):
        compare_dataframes(twins, twins, ["id"])


def test_duplicates_below_the_limit(spark, capsys):
    df = table(spark, [(1, "a"), (2, "b"), (3, "c"), (3, "c")], "id INT, x STRING")
    compare_dataframes(df, df, ["id"])
    assert "WARNING: duplicates" in capsys.readouterr().out


def test_per_column(spark):
    left = table(spark, [(1, "a", 1), (2, "b", 2), (3, "b", 2), (4, "b", 2), (5, "c", 3)], "id INT, c1 STRING, c2 INT")
    right = table(spark, [(1, "a", 1), (2, "b", 3), (3, "b", 4), (4, "b", 4), (6, "f", 3)], "id INT, c1 STRING, c2 INT")
    r = compare_dataframes(left, right, ["id"])
    rows = {x.column_name: x for x in r.get_diff_per_col_df(1).collect()}
    assert list(rows) == ["id", "c1", "c2"] and tuple(rows["c2"].counts) == (6, 3, 1, 1, 1)
    assert [(x.left_value, x.right_value, x.nb) for x in rows["c2"]["diff"].changed] == [("2", "4", 2)]
    assert [(x.value, x.nb) for x in rows["c1"]["diff"].no_change] == [("b", 3)]
    assert rows["c1"]["diff"].changed == [] and rows["c1"]["diff"].only_in_right[0].value == "f"
    assert rows["id"]["diff"].no_change[0].sample_ids == ['{"id":1}']
    assert r.get_sample_df_shards(10)[0].count() == 6
    assert {x.column_name for x in r.top_per_col_state_df.where("row_num > 1").collect()} == {"id", "c1", "c2"}


def test_display(spark, capsys):
    left = table(spark, [(1, [(1, 2)]), (2, [(1, 2)]), (3, [(1, 2)])], "id INT, arr ARRAY<STRUCT<a: INT, b: INT>>")
    right = table(spark, [(1, [(1, 2, 3)]), (2, [(2, 2, 3)]), (4, [(1, 2, 3)]), (5, None)], "id INT, arr ARRAY<STRUCT<a: INT, b: INT, c: INT>>")
    r = compare_dataframes(left, right, ["id"])
    r.display(show_examples=True, diff_format_options=DiffFormatOptions(left_df_alias="old", right_df_alias="new"))
    out = capsys.readouterr().out
    for line in ("Schema has changed:", "-arr ARRAY<STRUCT<a:INT,b:INT>>", "+arr ARRAY<STRUCT<a:INT,b:INT,c:INT>>", "diff NOT ok", "new: 4 rows (1 more)", "2 (40.0%) rows have changed", "1 rows were only found in 'old' :", "2 rows were only found in 'new' :", "2 (40.0%) rows are only in 'new'"):
        assert line in out, line
    assert DiffStats(0, 0, 0, 0, 0, 0, 0).percent_changed == 0.0


def test_html(spark, tmp_path):
    left, right = table(spark, [(1, "<b>&x</b>")], "id INT, x STRING"), table(spark, [(1, "é\"")], "id INT, x STRING")
    compare_dataframes(left, right, ["id"]).export_to_html("T<1>", str(tmp_path / "r.html"))
    text = (tmp_path / "r.html").read_text("utf-8")
    assert "&lt;b&gt;&amp;x&lt;/b&gt;" in text and "<b>&x" not in text and "T&lt;1&gt;" in text and "é" in text and "<script" not in text
