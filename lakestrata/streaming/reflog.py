"""Reflogs as streams: each ref update is a file, so a file source sees every one once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..sources.store import Store


def updates(store: Store, branch: str = "*", files_per_trigger: int = 1000) -> DataFrame:
    """A streaming DataFrame of REFLOG rows with `at`, their time as a timestamp."""
    source = store.spark.readStream.schema(schema.REFLOG).option("maxFilesPerTrigger", files_per_trigger)
    return source.json(store.url("client", "reflog", branch)).withColumn("at", F.col("ts").cast("timestamp"))


def activity(stream: DataFrame, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Updates by branch, operation and window of time; later ones than lateness are dropped, to bound the state."""
    return stream.withWatermark("at", lateness).groupBy(F.window("at", window), "branch", "operation").agg(F.count(F.lit(1)).alias("updates"))
