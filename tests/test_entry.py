import importlib
import os

import pytest

import __spark_entry__ as entry
from strata.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="benchmark tables are not here")


def test_contract():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql()) and set(SQL) == set(QUERIES)
    importlib.reload(entry)


@needs_data
def test_flagship(spark):
    assert entry.entry(spark).count() == 8


@needs_data
@pytest.mark.parametrize("name", ["analyze_nested", "nested_select", "nested_sum", "parse_json_columns", "ascending_forest_traversal", "diff_per_column", "diff_nested"])
def test_queries_equal_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "events", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = con.execute(SQL[name])
    places = [[d[0] for d in want.description].index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in places) for r in want.fetchall()), key=repr)
