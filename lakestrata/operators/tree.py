"""Directory digests, bottom-up, so that equal directories have equal digests.

The children of a directory are dealt to SHARDS shards by a digest of their names, files and subdirectories apart. A
shard's digest is that of its sorted lines, and a directory's that of its shards' digests: no row ever gathers more than
a shard of a directory, however flat the tree is. Shards of files are made in one pass over the entries; what is then
folded level by level has a row for each directory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import basename, directory
from ..shared import materialize

#: Hexadecimal digits of a name's digest that choose its shard.
SHARD_DIGITS = 2
#: Levels that are folded in one job. Within it each level's plan holds those below, whose exchanges are reused.
LEVELS = 4
#: Shards that the driver may fold; a row is some 150 bytes.
FEW = 1 << 18


def _shard(kind: str) -> Column:
    return F.concat(F.lit(kind), F.left(F.sha2(F.col("name").cast("binary"), 256), F.lit(SHARD_DIGITS)))


def _joined(c: str | Column) -> Column:
    return F.sha2(F.array_join(F.sort_array(F.collect_list(c)), "\n"), 256)


def _whole(shards: DataFrame) -> DataFrame:
    """dir, digest from dir, shard, digest."""
    return shards.groupBy("dir").agg(_joined(F.concat_ws(" ", "shard", "digest")).alias("digest"))


def depth(directory_: Column) -> Column:
    """How many directories a directory lies below the root, whose depth is 0."""
    return F.when(directory_ == "", 0).otherwise(F.size(F.split(directory_, "/")))


def file_lines(entries: DataFrame) -> DataFrame:
    """dir, name, line of each file: its line holds all that its identity depends on."""
    fields = ["identity_mode", "hash", F.col("size").cast("string"), F.coalesce("blob_hash", F.lit("-")), F.coalesce("source_uri", F.lit("-")), F.coalesce("footer", F.lit("-"))]
    return entries.select(directory(F.col("path")).alias("dir"), basename(F.col("path")).alias("name"), F.concat_ws("\t", basename(F.col("path")), *fields).alias("line"))


def file_shards(entries: DataFrame) -> DataFrame:
    """dir, shard, digest of the files that lie directly in each directory, and how many of them repeat a path."""
    repeats = F.count(F.lit(1)) - F.size(F.collect_set("name"))
    return file_lines(entries).groupBy("dir", _shard("f").alias("shard")).agg(_joined("line").alias("digest"), repeats.alias("repeats"))


def _child_shards(below: DataFrame) -> DataFrame:
    """dir, shard, digest of the directories whose parent is dir, from dir, digest."""
    lines = below.filter("dir <> ''").select(directory(F.col("dir")).alias("dir"), basename(F.col("dir")).alias("name"), F.concat_ws("\t", basename(F.col("dir")), "digest").alias("line"))
    return lines.groupBy("dir", _shard("d").alias("shard")).agg(_joined("line").alias("digest"))


def directory_digests(entries: DataFrame) -> DataFrame:
    """dir, digest of the files that lie directly in each directory."""
    return _whole(file_shards(entries).select("dir", "shard", "digest"))


def _folded_rows(rows: Iterable[tuple[str, str, str]]) -> dict[str, str]:
    """folded() of few rows (dir, shard, digest)."""
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    shards: dict[str, list[str]] = {"": []}
    for dir_, shard, digest in rows:
        shards.setdefault(dir_, []).append(f"{shard} {digest}")
    for dir_ in [d for d in shards if d]:
        while dir_ := dir_.rpartition("/")[0]:
            shards.setdefault(dir_, [])
    found: dict[str, str] = {}
    children: dict[str, dict[str, list[str]]] = {}
    for dir_ in sorted(shards, key=lambda d: -d.count("/") - bool(d)):
        own = [f"d{k} {sha(chr(10).join(sorted(lines)))}" for k, lines in children.pop(dir_, {}).items()]
        found[dir_] = sha("\n".join(sorted(shards[dir_] + own)))
        if dir_:
            parent, _, name = dir_.rpartition("/")
            children.setdefault(parent, {}).setdefault(sha(name)[:SHARD_DIGITS], []).append(f"{name}\t{found[dir_]}")
    return found


def folded(shards: DataFrame, max_depth: int, few: int | None = None) -> DataFrame:
    """dir, digest of each directory with all below it, from its files' shards. Up to FEW shards are folded by the driver,
    which spares a job for each level. More are folded level by level: shards is read once for each, and levels are
    written out LEVELS at a time, so the plan grows with neither the depth nor the number of directories."""
    few = FEW if few is None else few
    table = shards.select("dir", "shard", "digest").limit(few + 1).toArrow()
    if table.num_rows <= few:
        rows = _folded_rows(zip(*(c.to_pylist() for c in table.columns))) if table.num_rows else {}
        return shards.sparkSession.createDataFrame(list(rows.items()), "dir string, digest string")
    found, below = [], None
    for top in range(max_depth, -1, -LEVELS):
        levels = []
        for level in range(top, max(-1, top - LEVELS), -1):
            own = shards.filter(depth(F.col("dir")) == level).select("dir", "shard", "digest")
            below = _whole(own if below is None else own.unionByName(_child_shards(below)))
            levels.append(below.withColumn("depth", F.lit(level)))
        part = materialize(reduce(DataFrame.unionByName, levels), "directories")
        found.append(part.select("dir", "digest"))
        below = part.filter(F.col("depth") == level).select("dir", "digest")
    return reduce(DataFrame.unionByName, found)


def merkle(entries: DataFrame, max_depth: int) -> DataFrame:
    """dir, digest of each directory with all below it; '' is the root. max_depth: of directories, the root's being 0."""
    return folded(materialize(file_shards(entries).drop("repeats"), "shards"), max_depth)


def nodes(entries: DataFrame, max_depth: int) -> DataFrame:
    """TREE_NODE rows: the children of each distinct directory, by its digest. Kinds are t (a directory), b and m (files
    by identity mode), and bp and mp (those with statistics)."""
    digests = materialize(merkle(entries, max_depth), "merkle")
    kind = F.concat(F.when(F.col("identity_mode") == "meta", "m").otherwise("b"), F.when(F.col("footer").isNotNull(), "p").otherwise(""))
    files = entries.select(directory(F.col("path")).alias("dir"), basename(F.col("path")).alias("name"), kind.alias("kind"), "hash", "size", "mtime_ns", "source_uri", "footer")
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    below = digests.filter("dir <> ''").select(
        directory(F.col("dir")).alias("dir"), basename(F.col("dir")).alias("name"), F.lit("t").alias("kind"), F.col("digest").alias("hash"), none("size", "long"), none("mtime_ns", "long"), none("source_uri", "string"), none("footer", "string")
    )
    return files.unionByName(below).join(digests, "dir").withColumnRenamed("digest", "tree_hash").drop("dir").dropDuplicates(["tree_hash", "name"])


def reachable_trees(tree_nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """tree_hash of every directory at or below roots (column tree_hash)."""
    down = tree_nodes.filter("kind = 't'").select("tree_hash", F.col("hash").alias("child"))
    found = frontier = materialize(roots.select("tree_hash").distinct(), "trees")
    while True:
        frontier = materialize(frontier.join(down, "tree_hash").select(F.col("child").alias("tree_hash")).distinct().join(found, "tree_hash", "left_anti"), "trees")
        if frontier.isEmpty():
            return found
        found = found.unionByName(frontier)


def depth_of(entries: DataFrame) -> int:
    """The number of directories above the deepest file."""
    return entries.agg(F.max(depth(directory(F.col("path"))))).first()[0] or 0


#: The root's digest where there are no entries: that of no lines.
NOTHING = hashlib.sha256(b"").hexdigest()


def root_of(digests: DataFrame) -> str:
    """The root's digest among digests. For the driver, which names snapshots."""
    row = digests.filter("dir = ''").first()
    return row["digest"] if row else NOTHING


def root_digest(entries: DataFrame) -> str:
    return root_of(merkle(entries, depth_of(entries)))
