"""Queries on the commit graph, and reachability of stored objects.

Commits are rows (id, parents, generation, ...). First-parent chains are followed by pointer doubling: the number of
joins is the logarithm of the chain's length. Full ancestry walks frontiers; each round joins only the new commits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import materialize


def _first_parent(commits: DataFrame) -> DataFrame:
    return commits.select("id", F.try_element_at("parents", F.lit(1)).alias("up"))


def first_parent_log(commits: DataFrame, heads: DataFrame) -> DataFrame:
    """head, id, distance for each commit on the first-parent chain of each head (column id), itself at distance 0.

    After k rounds chains are known up to 2^k steps, and `up` leaps 2^k parents. Each round is written out, since the
    next one uses it more than once.
    """
    up = _first_parent(commits).filter("up is not null")
    found = heads.join(commits, "id", "left_semi").select(F.col("id").alias("head"), "id", F.lit(0).cast("long").alias("distance"))
    step = 1
    while True:
        more = found.join(up, "id").select("head", F.col("up").alias("id"), (F.col("distance") + step).alias("distance"))
        grown = materialize(found.unionByName(more), "log")
        if step > 1 and grown.count() == found.count():
            return grown
        found = grown
        leaps = up.select(F.col("id").alias("up"), F.col("up").alias("far"))
        up = materialize(up.join(leaps, "up").select("id", F.col("far").alias("up")), "leaps")
        step *= 2


def edges(commits: DataFrame) -> DataFrame:
    return commits.select("id", F.explode("parents").alias("parent"))


#: Generations that one round of ancestors() goes up before it is written out.
HOPS = 8


def ancestors(commits: DataFrame, heads: DataFrame) -> DataFrame:
    """id of each commit reachable from heads (column id) by any parents, heads included."""
    up = edges(commits).join(commits.select(F.col("id").alias("parent")), "parent", "left_semi")
    found = frontier = materialize(heads.join(commits, "id", "left_semi").select("id").distinct(), "frontier")
    while True:
        above = hop = frontier.join(up, "id").select(F.col("parent").alias("id")).distinct()
        for _ in range(HOPS - 1):
            hop = hop.join(up, "id").select(F.col("parent").alias("id")).distinct()
            above = above.unionByName(hop)
        frontier = materialize(above.distinct().join(found, "id", "left_anti"), "frontier")
        if frontier.isEmpty():
            return found
        # Only parquet scans are united here: the plan grows by a scan a round, and no round is computed again.
        found = found.unionByName(frontier)


def merge_base(commits: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """The common ancestor of the highest generation (of several, the smallest id), or no row."""
    common = ancestors(commits, a).join(ancestors(commits, b), "id", "left_semi")
    return common.join(commits.select("id", "generation"), "id").orderBy(F.desc("generation"), "id").limit(1)


def generations_ok(commits: DataFrame) -> DataFrame:
    """id of commits whose generation isn't one more than their highest parent's (0 without parents)."""
    high = edges(commits).join(commits.select(F.col("id").alias("parent"), "generation"), "parent").groupBy("id").agg(F.max("generation").alias("high"))
    return commits.join(high, "id", "left").filter(F.col("generation") != F.coalesce(F.col("high") + 1, F.lit(0))).select("id")


def leaf_objects(entries: DataFrame) -> DataFrame:
    """kind, id of the blobs and footers that entries refer to."""
    refs = F.array(F.struct(F.lit("blob").alias("kind"), F.col("blob_hash").alias("id")), F.struct(F.lit("footer").alias("kind"), F.col("footer").alias("id")))
    return entries.select(F.explode(refs).alias("r")).select("r.*").filter("id is not null").distinct()


def orphans(stored: DataFrame, reachable: DataFrame) -> DataFrame:
    """Stored objects (kind, id) that nothing reaches."""
    return stored.join(reachable.select("kind", "id").distinct(), ["kind", "id"], "left_anti")


def gc_report(stored: DataFrame, reachable: DataFrame) -> DataFrame:
    """kind, reachable, orphaned: how many stored objects of each kind are which."""
    flag = reachable.select("kind", "id").distinct().withColumn("_live", F.lit(True))
    live = F.col("_live").isNotNull()
    return stored.distinct().join(flag, ["kind", "id"], "left").groupBy("kind").agg(F.count_if(live).alias("reachable"), F.count_if(~live).alias("orphaned"))


#: Order in which a transfer copies kinds: what is referred to before what refers to it.
TRANSFER_ORDER = {"tree": 0, "blob": 1, "footer": 1, "commit": 2}


def transfer_plan(needed: DataFrame, present: DataFrame) -> DataFrame:
    """rank, kind, id of the needed objects that the destination lacks, each once; a copy goes by rank."""
    rank = F.coalesce(*(F.when(F.col("kind") == k, F.lit(r)) for k, r in TRANSFER_ORDER.items()))
    return needed.select("kind", "id").distinct().join(present.select("kind", "id"), ["kind", "id"], "left_anti").select(rank.alias("rank"), "kind", "id")


def commits_to_push(commits: DataFrame, head: DataFrame, present: DataFrame) -> DataFrame:
    """id, generation of the commits that head needs and the destination (column id) lacks; copy by generation."""
    return ancestors(commits, head).join(present.select("id"), "id", "left_anti").join(commits.select("id", "generation"), "id")
