import pytest
from pyspark.sql import functions as F

from strata import filesystem as fs
from strata import nested, transformations as tr
from strata.errors import FileAlreadyExistsError, IllegalArgumentException
from strata.streaming.stateless import run_available, transform_stream
from strata.utils import assert_true, group_by_key, load_external_module, schema_string, show_string, strip_margin


def test_files(spark, tmp_path):
    path = str(tmp_path / "d" / "a.txt")
    fs.write_file("héllo\n", path)
    with pytest.raises(FileAlreadyExistsError):
        fs.write_file("x", path)
    fs.write_file("more", path, mode="append")
    assert fs.read_file(path) == "héllo\nmore"
    fs.write_file("new", path, mode="overwrite")
    fs.write_file("sub", str(tmp_path / "d" / "e" / "b.txt"))
    assert sorted(p.rsplit("/", 1)[1] for p in fs.recursively_list_all_files_in_folder(str(tmp_path / "d"))) == ["a.txt", "b.txt"]
    fs.copy_to_local_folder(str(tmp_path / "d"), str(tmp_path / "copy"))
    assert (tmp_path / "copy" / "e" / "b.txt").read_text() == "sub" and (tmp_path / "copy" / "a.txt").read_text() == "new"
    fs.copy_to_local_file(path, str(tmp_path / "one.txt"), delete_source=True)
    assert (tmp_path / "one.txt").read_text() == "new"
    with pytest.raises(FileNotFoundError):
        fs.read_file(path)
    with pytest.raises(IllegalArgumentException):
        fs.write_file("x", path, mode="nope")


def test_utils(spark):
    df = spark.sql("SELECT 1 AS id")
    assert show_string(df) == strip_margin(
        """
        |+---+
        || id|
        |+---+
        ||  1|
        |+---+
        |"""
    )
    assert schema_string(df) == "root\n |-- id: integer (nullable = false)\n"
    assert group_by_key([("a", 1), ("b", 2), ("a", 3)]) == {"a": [1, 3], "b": [2]}
    with pytest.raises(AssertionError, match="no"):
        assert_true(False, "no")
    with pytest.raises(ImportError):
        load_external_module("surely_not_here")
    assert load_external_module("json").__name__ == "json"


def test_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.sql("SELECT id, ARRAY(STRUCT(id AS a, 'x' AS b), STRUCT(id + 1 AS a, 'y' AS b)) AS s FROM range(5)").write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    out = transform_stream(stream, (nested.with_fields, {"s!.a": lambda x: x["a"] * 2}), (nested.unnest_field, "s!", ["id"]), lambda d: d.select("id", F.col("`s!`.a").alias("a"), F.col("`s!`.b").alias("b")), (tr.transform_all_field_names, str.upper))
    run_available(out, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(tuple(r) for r in got.collect()) == sorted((k, v, b) for k in range(5) for v, b in ((2 * k, "x"), (2 * k + 2, "y")))
    with pytest.raises(ValueError):
        transform_stream(stream, tr.analyze)
