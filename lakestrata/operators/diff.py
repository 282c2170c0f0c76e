"""Differences between snapshots, and of a working tree and a stage from a snapshot."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import meta_hash
from ..functions.paths import directory
from ..schema import META
from ..shared import materialize


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """DIFF rows: paths added, removed, or modified (another hash or size). Only three columns of each side are read."""
    a = before.select("path", F.col("hash").alias("before_hash"), F.col("size").alias("before_size"))
    b = after.select("path", F.col("hash").alias("after_hash"), F.col("size").alias("after_size"))
    same = F.col("before_hash").eqNullSafe(F.col("after_hash")) & F.col("before_size").eqNullSafe(F.col("after_size"))
    change = F.when(F.col("before_hash").isNull(), "added").when(F.col("after_hash").isNull(), "removed").when(~same, "modified")
    joined = a.join(b, "path", "full_outer").withColumn("change", change).filter(F.col("change").isNotNull())
    return joined.select("path", "change", "before_hash", "after_hash", "before_size", "after_size")


#: Changed directories that a diff names in its filter, which reaches the snapshots' files; more are joined.
NAMED = 64


def _named(entries: DataFrame, dirs: list[str]) -> DataFrame:
    """The files directly in any of dirs. The prefixes are a condition of their own, as the reader takes that one."""
    if "" not in dirs:
        entries = entries.filter(reduce(or_, (F.col("path").startswith(d + "/") for d in dirs)))
    return entries.filter(directory(F.col("path")).isin(dirs))


def diff_by_directory(before: DataFrame, after: DataFrame, digests: tuple[DataFrame, DataFrame]) -> DataFrame:
    """diff() over those directories alone whose digests (columns dir, digest) differ; for snapshots mostly alike."""
    a, b = (d.select("dir", "digest") for d in digests)
    changed = a.join(b.withColumnRenamed("digest", "other"), "dir", "full_outer").filter(~F.col("digest").eqNullSafe(F.col("other"))).select(F.col("dir").alias("_dir"))
    changed = materialize(changed, "changed")
    few = [r["_dir"] for r in changed.limit(NAMED + 1).collect()]
    if not few:
        return diff(before.limit(0), after.limit(0))
    if len(few) <= NAMED:
        return diff(_named(before, few), _named(after, few))
    only = lambda e: e.withColumn("_dir", directory(F.col("path"))).join(changed, "_dir", "left_semi")
    return diff(only(before), only(after))


def worktree_status(snapshot: DataFrame, worktree: DataFrame) -> DataFrame:
    """path and change (added, removed, modified) of working files against a snapshot. Entries in meta mode are compared
    by the digest of path and size, since no content digest of them is known."""
    seen = worktree.select("path", "hash", "size")
    meta = snapshot.select("path", (F.col("identity_mode") == META).alias("_meta"))
    comparable = seen.join(meta, "path", "left").select("path", F.when(F.col("_meta"), meta_hash(F.col("path"), F.col("size"))).otherwise(F.col("hash")).alias("hash"), "size")
    return diff(snapshot, comparable).select("path", "change")


def stage_status(stage: DataFrame, snapshot: DataFrame) -> DataFrame:
    """path, change of staged rows: removed, added, or modified where an addition replaces an entry."""
    there = snapshot.select("path", F.lit(True).alias("_there"))
    change = F.when(F.col("action") == "remove", "removed").when(F.col("_there").isNotNull(), "modified").otherwise("added")
    return stage.join(there, "path", "left").select("path", change.alias("change"))
