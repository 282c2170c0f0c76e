"""Operators on snapshots: DataFrames of schema ENTRY with a row for each path."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import meta_hash
from ..functions.paths import ancestors, directory, matches_glob, under, under_any
from ..schema import CONTENT, ENTRY_COLUMNS, META


def scan(spark: SparkSession, path: str) -> DataFrame:
    """A stored snapshot. Filters and columns that follow reach the parquet reader."""
    return spark.read.parquet(path)


def with_prefix(entries: DataFrame, prefix: str) -> DataFrame:
    """Entries whose path starts with prefix, as text: `dir_0` also finds `dir_000/x`. Pushed down to parquet."""
    return entries.filter(F.col("path").startswith(prefix)) if prefix else entries


def within(entries: DataFrame, prefix: str) -> DataFrame:
    """Entries at prefix or below it, by whole components."""
    return entries.filter(under(F.col("path"), prefix))


def lookup(entries: DataFrame, path: str) -> DataFrame:
    """The entry of one path, or no row. An equality on the sort column: row groups are skipped by their statistics."""
    return entries.filter(F.col("path") == path)


def children(entries: DataFrame, parent: str) -> DataFrame:
    """Files directly in a directory ('' is the root)."""
    return entries.filter((directory(F.col("path")) == parent) & (F.col("path").startswith(parent + "/") if parent else F.lit(True)))


def filter_globs(entries: DataFrame, patterns: Iterable[str]) -> DataFrame:
    return entries.filter(matches_glob(F.col("path"), patterns))


def _below(entries: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The distinct paths of entries at or below any path of prefixes: a hash join on ancestors, not a theta join."""
    spread = entries.select("path", F.explode(ancestors(F.col("path"))).alias("_ancestor"))
    return spread.join(prefixes.select(F.col("path").alias("_ancestor")).distinct(), "_ancestor", "left_semi").select("path").distinct()


def remove(entries: DataFrame, prefixes: Iterable[str] | DataFrame) -> DataFrame:
    """entries without those at or below any prefix. A list of prefixes becomes a filter, a table a hash join."""
    if isinstance(prefixes, DataFrame):
        return entries.join(_below(entries, prefixes), "path", "left_anti")
    return entries.filter(~under_any(F.col("path"), prefixes))


def select_under(entries: DataFrame, prefixes: Iterable[str] | DataFrame) -> DataFrame:
    """entries at or below any prefix."""
    if isinstance(prefixes, DataFrame):
        return entries.join(_below(entries, prefixes), "path", "left_semi")
    return entries.filter(under_any(F.col("path"), prefixes))


def overlay(parent: DataFrame, additions: DataFrame, removed: Iterable[str] | DataFrame) -> DataFrame:
    """A parent snapshot with staged changes: removed prefixes go, additions replace equal paths and survive removals."""
    kept = remove(parent, removed).join(additions.select("path"), "path", "left_anti")
    return kept.select(ENTRY_COLUMNS).unionByName(additions.select(ENTRY_COLUMNS))


def upsert(stage: DataFrame, changes: DataFrame) -> DataFrame:
    """A stage with changes on top: the last write of a path wins."""
    return stage.join(changes.select("path"), "path", "left_anti").select(changes.columns).unionByName(changes)


def _renamed(path: Column, source: str, target: str) -> Column:
    return F.concat(F.lit(target), F.substring(path, len(source) + 1, 1 << 30))


def move(entries: DataFrame, source: str, target: str) -> DataFrame:
    """entries with source (a path or directory) renamed to target. Entries in meta mode get the hash of the new path."""
    moved = under(F.col("path"), source)
    path = F.when(moved, _renamed(F.col("path"), source, target)).otherwise(F.col("path"))
    new_hash = F.when(moved & (F.col("identity_mode") == META), meta_hash(path, F.col("size"))).otherwise(F.col("hash"))
    return entries.select(path.alias("path"), new_hash.alias("hash"), *ENTRY_COLUMNS[2:])


def move_collisions(entries: DataFrame, source: str, target: str) -> DataFrame:
    """Paths that a move would write twice, or write over an entry that does not itself move."""
    moving = under(F.col("path"), source)
    targets = entries.filter(moving).select(_renamed(F.col("path"), source, target).alias("path"))
    twice = targets.groupBy("path").count().filter("count > 1").select("path")
    taken = targets.join(entries.filter(~moving).select("path"), "path", "left_semi")
    return twice.union(taken).distinct()


def move_staged(entries: DataFrame, source: str, target: str) -> DataFrame:
    """The STAGE rows of a move: for each entry a removal of its path, and an addition of the new one."""
    hit = entries.filter(under(F.col("path"), source))
    nothing = [F.lit(None).cast("string").alias(c) for c in ("identity_mode", "source_uri", "blob_hash")]
    removals = hit.select("path", F.lit("remove").alias("action"), *nothing, F.lit(None).cast("long").alias("size"))
    additions = hit.select(_renamed(F.col("path"), source, target).alias("path"), F.lit("add").alias("action"), "identity_mode", "source_uri", "blob_hash", "size")
    return removals.unionByName(additions)


def verify_candidates(entries: DataFrame, prefixes: Iterable[str] = ()) -> DataFrame:
    """Entries without stored bytes, within prefixes where any are given."""
    found = entries.filter(F.col("blob_hash").isNull())
    prefixes = list(prefixes)
    return found.filter(under_any(F.col("path"), prefixes)) if prefixes else found


def promote(entries: DataFrame, digests: DataFrame, prefixes: Iterable[str] = ()) -> DataFrame:
    """entries with candidates promoted to content mode where digests (source_uri, digest, n_bytes) has their bytes.
    Footers stay."""
    wanted = F.col("blob_hash").isNull() & (under_any(F.col("path"), prefixes) if list(prefixes) else F.lit(True))
    known = digests.dropDuplicates(["source_uri"]).select("source_uri", "digest", "n_bytes")
    joined = entries.join(known, "source_uri", "left").withColumn("_ok", wanted & F.col("digest").isNotNull())
    pick = lambda new, old: F.when(F.col("_ok"), new).otherwise(F.col(old)).alias(old)
    return joined.select(
        "path", pick(F.col("digest"), "hash"), pick(F.col("n_bytes"), "size"), "mtime_ns", pick(F.lit(CONTENT), "identity_mode"), pick(F.col("digest"), "blob_hash"), "source_uri", "footer"
    )


def verify_counts(entries: DataFrame, digests: DataFrame, prefixes: Iterable[str] = ()) -> DataFrame:
    """One row: verified, candidates, total."""
    wanted = F.col("blob_hash").isNull() & (under_any(F.col("path"), prefixes) if list(prefixes) else F.lit(True))
    known = digests.select("source_uri").distinct().withColumn("_known", F.lit(True))
    joined = entries.join(known, "source_uri", "left")
    return joined.agg(F.count_if(wanted & F.col("_known").isNotNull()).alias("verified"), F.count_if(wanted).alias("candidates"), F.count(F.lit(1)).alias("total"))


def full_commit(parent: DataFrame, worktree: DataFrame, additions: DataFrame, removed: Iterable[str] | DataFrame) -> DataFrame:
    """A commit of a working tree: its files override the parent, entries of the parent alone survive, staged removals
    apply to both, and staged additions win over all."""
    base = worktree.select(ENTRY_COLUMNS).unionByName(parent.join(worktree.select("path"), "path", "left_anti").select(ENTRY_COLUMNS))
    return overlay(base, additions, removed)


def reuse_unchanged(parent: DataFrame, worktree: DataFrame) -> DataFrame:
    """worktree with unchanged files replaced by their parent rows, so their times stay; a new footer fills a gap.
    Unchanged: equal size, and equal digest (for meta entries of the parent: equal path and size)."""
    old = parent.select(*(F.col(c).alias(f"_{c}") for c in ENTRY_COLUMNS))
    expected = F.when(F.col("_identity_mode") == META, meta_hash(F.col("path"), F.col("size"))).otherwise(F.col("hash"))
    joined = worktree.join(old, F.col("path") == F.col("_path"), "left")
    same = F.coalesce((F.col("size") == F.col("_size")) & (expected == F.col("_hash")), F.lit(False))
    pick = [F.when(same, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ENTRY_COLUMNS[1:-1]]
    footer = F.when(same & (F.col("_blob_hash").isNotNull() | (F.col("_identity_mode") == META)), F.coalesce("_footer", "footer")).when(same, F.col("_footer")).otherwise(F.col("footer"))
    return joined.select("path", *pick, footer.alias("footer"))


def distinct_blobs(entries: DataFrame) -> DataFrame:
    """blob_hash, size and the number of paths of each stored digest."""
    return entries.filter(F.col("blob_hash").isNotNull()).groupBy("blob_hash").agg(F.min("size").alias("size"), F.count(F.lit(1)).alias("n_paths"))
