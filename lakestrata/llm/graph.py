"""Connected components of an edge table by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u > v, distinct. A large star hooks larger neighbours to the smallest one, a small star the others."""
    if large:
        ends = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ends.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        hooked = ends.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        hooked = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
    return hooked.filter("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for each node of edges (columns a, b) that isn't its own component.

    Hubs are pre-aggregated by the minimum and AQE splits the joins that skew. Each round is written to the shared
    folder, so lineage stays short; the number of rounds is logarithmic. Self-loops and nulls are ignored.
    """
    edges = edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state = None
    while True:
        edges = materialize(_star(_star(edges, True), False), "star")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = now
