"""The SQL catalog: snapshots, commits, refs, logs and statistics as views for Spark SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files(entries: DataFrame, commit_id: str, branch: str | None) -> DataFrame:
    """The catalog's table `files`: seven columns of each entry and its commit. branch is the commit's own."""
    return entries.select("path", "hash", "size", "mtime_ns", F.nullif(F.col("footer"), F.lit("")).alias("footer"), F.lit(commit_id).alias("commit_id"), F.lit(branch).cast("string").alias("branch"))


def register(spark: SparkSession, **views: DataFrame) -> None:
    for name, df in views.items():
        df.createOrReplaceTempView(name)


def sql(spark: SparkSession, text: str) -> DataFrame:
    """Any query over the registered views. Filters and columns reach the snapshot's parquet files."""
    return spark.sql(text)


def drop(spark: SparkSession, *names: str) -> None:
    """Unregisters views; those that aren't there are no error."""
    for name in names:
        spark.catalog.dropTempView(name)


def branches(refs: DataFrame, commits: DataFrame) -> DataFrame:
    """branch, commit_id, message of each branch, sorted; null for a branch without commits."""
    heads = commits.select(F.col("id").alias("commit_id"), "message")
    return refs.join(heads, "commit_id", "left").select("branch", "commit_id", "message").orderBy("branch")
