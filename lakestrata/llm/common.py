"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..shared import materialize, shared_dir

__all__ = ["bounded", "fresh", "mapped", "materialize", "new_path", "null_safe_key", "per_row", "running", "shared_dir", "table"]


#: Bytes of a batch that goes to Python; a longer row goes alone.
BATCH_BYTES = 4 << 20
_MOST_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def null_safe_key(name: str):
    """A non-null join key for a nullable string column; null differs from every string."""
    return F.coalesce(F.concat(F.lit("="), F.col(name)), F.lit("null"))


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """names that none of columns has, in any case: a name that is taken gets underscores."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def running(rows: DataFrame, order: list[Column], values: dict[str, str]) -> DataFrame:
    """rows with running sums: for each item, column name -> expression, the sum over the rows before, in a total order.
    Rows are dealt by range and summed within each; a window over all sees a row for each range only."""
    part, base = fresh(rows.columns, "_range", "_base")
    ranged = rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id())
    ranged = materialize(ranged, "ranged")
    parts = ranged.groupBy(part).agg(*(F.sum(F.expr(e)).alias(n) for n, e in values.items()))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select(part, F.struct(*(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in values)).alias(base))
    inner = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = {n: F.coalesce(F.sum(F.expr(e)).over(inner), F.lit(0)) + F.col(f"{base}.{n}") for n, e in values.items()}
    return ranged.join(F.broadcast(bases), part).withColumns(sums).drop(part, base)


def bounded(spark: SparkSession) -> None:
    """Bounds the batches that go to Python by bytes: 10,000 whole texts at once, the session's default, take tens of MB
    several times over in the JVM and in each Python worker. The session keeps the bound, as plans are made later."""
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_MOST_BYTES)) > BATCH_BYTES:
        spark.conf.set(_MOST_BYTES, str(BATCH_BYTES))


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow in batches that are bounded by bytes."""
    bounded(df.sparkSession)
    return df.mapInArrow(run, schema)


def per_row(schema: pa.Schema, row: Callable[..., tuple | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that calls row(*values) on each row and gathers the tuples it returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row(*values) for values in zip(*(c.to_pylist() for c in batch.columns))]
            if rows:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run
