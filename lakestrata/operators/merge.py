"""Three-way merge of snapshots as two full outer joins on path and one decision.

With same(x, y): both absent, or equal hash and size. An entry that both sides have alike stays. One that a single
side changed, added or removed takes that side. Where both sides changed it differently, or one changed what the other
removed, it is a conflict and the surviving (for two: our) entry stands provisionally.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ENTRY_COLUMNS


def decisions(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """path, take (ours, theirs or null for neither), conflict, and both sides as structs."""
    side = lambda e, name: e.select("path", F.struct(*ENTRY_COLUMNS[1:]).alias(name))
    # Of the base only the identity matters.
    joined = (
        side(ours, "o")
        .join(side(theirs, "t"), "path", "full_outer")
        .join(base.select("path", F.struct("hash", "size").alias("b")), "path", "full_outer")
    )
    has = {x: F.col(x).isNotNull() for x in "bot"}

    def same(x: str, y: str):
        return (~has[x] & ~has[y]) | (has[x] & has[y] & (F.col(f"{x}.hash") == F.col(f"{y}.hash")) & (F.col(f"{x}.size") == F.col(f"{y}.size")))

    alike, our_base, their_base = (F.coalesce(same(*p), F.lit(False)) for p in (("o", "t"), ("b", "o"), ("b", "t")))
    conflict = ~alike & ~our_base & ~their_base
    take = F.when(alike, F.when(has["o"], "ours")).when(our_base, F.when(has["t"], "theirs")).when(their_base, F.when(has["o"], "ours")).when(has["o"], "ours").otherwise("theirs")
    return joined.select("path", take.alias("take"), conflict.alias("conflict"), "o", "t")


def three_way_merge(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """The merged entries, provisional ones of conflicts included, with a column `conflict`."""
    found = decisions(base, ours, theirs).filter(F.col("take").isNotNull())
    chosen = F.when(F.col("take") == "ours", F.col("o")).otherwise(F.col("t"))
    return found.select("path", chosen.alias("e"), "conflict").select("path", "e.*", "conflict")


def conflicts(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """The conflicting paths."""
    return decisions(base, ours, theirs).filter("conflict").select("path")
