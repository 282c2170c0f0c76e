"""Every registered query that SQL can express, against DuckDB over the same tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
ORACLE = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("NULL" if r[i] is None else f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    want = duck.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("allowed", ["false", "true"])
def test_versioned_source_by_either_setting(spark, duck, allowed):
    """Spark's default lets no filters be pushed to Python sources; other tests run with a session that does."""
    key = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, allowed)
    try:
        test_query(spark, duck, "versioned_source")
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("asked, run", [("true", "false"), ("false", "true")])
def test_versioned_source_run_by_another_setting_than_asked(spark, duck, asked, run):
    key = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, asked)
        df = __spark_entry__.queries()["versioned_source"](spark, SF)
        spark.conf.set(key, run)
        want = duck.sql(ORACLE["versioned_source"])
        assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())
    finally:
        spark.conf.set(key, before)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_queries_without_sql_have_rows(spark):
    for name in set(__spark_entry__.queries()) - set(ORACLE):
        if not name.startswith("op") and name != "pipeline":
            assert __spark_entry__.queries()[name](spark, SF).count() > 0
