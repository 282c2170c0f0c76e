"""Operators over the test tables as named queries, each with DuckDB SQL of the same result where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.identity import meta_hash
from ..functions.paths import basename, directory, glob_regex, relative_key
from ..operators import diff, graph, merge, prune, snapshot, tree
from ..sources import footers, manifest
from . import catalog
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


ENTRY = "path, hash, size, mtime_ns, identity_mode, blob_hash, source_uri, footer"

# Scans, lookups and predicates


@query("snapshot_scan", fx.sql("base", body=f"SELECT {ENTRY} FROM base"))
def _(spark, sf):
    return fx.base(spark, sf)


@query("prefix_scan", fx.sql("base", body=f"SELECT {ENTRY} FROM base WHERE starts_with(path, 'src1')"))
def _(spark, sf):
    return snapshot.with_prefix(fx.base(spark, sf), "src1")


@query("prefix_scan_component", fx.sql("base", body=f"SELECT {ENTRY} FROM base WHERE path = 'src1' OR starts_with(path, 'src1/')"))
def _(spark, sf):
    return snapshot.within(fx.base(spark, sf), "src1")


@query("point_lookup", fx.sql("base", body=f"SELECT {ENTRY} FROM base WHERE path = (SELECT min(path) FROM base WHERE mtime_ns = 100)"))
def _(spark, sf):
    entries = fx.base(spark, sf)
    path = entries.filter("mtime_ns = 100").agg(F.min("path")).first()[0]
    return snapshot.lookup(entries, path)


@query("direct_children", fx.sql("base", body=f"SELECT {ENTRY} FROM base WHERE regexp_replace(path, '/[^/]*$', '') = 'src3/en'"))
def _(spark, sf):
    return snapshot.children(fx.base(spark, sf), "src3/en")


@query("import_glob", fx.sql("base", body="SELECT path FROM base WHERE regexp_matches(path, '^(.*/)?(de|en)/0000[^/]*5\\.txt$')"))
def _(spark, sf):
    return snapshot.filter_globs(fx.base(spark, sf), ["de/0000*5.txt", "**/en/0000*5.txt"]).select("path")


@query("s3_key_relative", "SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '^/+|/+$', '', 'g') AS rel FROM pages WHERE regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '^/+|/+$', '', 'g') <> ''")
def _(spark, sf):
    key = F.regexp_replace("url", "^[a-z]+://", "")
    pages = fx.table(spark, sf, "pages").select("page_id", relative_key(key, F.lit(1), "").alias("rel"))
    return pages.filter("rel is not null")


@query("s3_key_below_prefix", fx.sql("base", body="SELECT path AS key, path AS rel FROM base"))
def _(spark, sf):
    key = F.concat(F.lit("bucket/prefix/"), "path")
    return fx.base(spark, sf).select(F.col("path").alias("key"), relative_key(key, F.lit(1), "/bucket/prefix/").alias("rel"))


@query("snapshot_validate", fx.sql("base", body="SELECT path, 'numbers' AS rule FROM base WHERE mtime_ns % 7 = 0 UNION ALL SELECT '/' || path, 'path' FROM base WHERE mtime_ns % 7 = 1 UNION ALL SELECT path, 'digests' FROM base WHERE mtime_ns % 7 = 2 UNION ALL SELECT path, 'blob' FROM base WHERE mtime_ns % 7 = 2 UNION ALL SELECT path, 'meta' FROM base WHERE mtime_ns % 7 = 3 UNION ALL SELECT 'same', 'unique' FROM base WHERE mtime_ns % 7 = 4 GROUP BY 1 HAVING count(*) > 1"))
def _(spark, sf):
    kind = F.col("mtime_ns") % 7
    path = F.when(kind == 1, F.concat(F.lit("/"), "path")).when(kind == 4, F.lit("same")).otherwise(F.col("path"))
    broken = fx.base(spark, sf).select(
        path.alias("path"), F.when(kind == 2, F.upper("hash")).otherwise(F.col("hash")).alias("hash"), F.when(kind == 0, -F.col("size")).otherwise(F.col("size")).alias("size"),
        "mtime_ns", F.when(kind == 3, "meta").otherwise(F.col("identity_mode")).alias("identity_mode"), "blob_hash", "source_uri", "footer",
    )
    return schema.violations(broken)


@query("meta_identity", fx.sql("base", body="SELECT path, sha256(path || chr(10) || CAST(size AS VARCHAR)) AS hash FROM base"))
def _(spark, sf):
    return fx.base(spark, sf).select("path", meta_hash(F.col("path"), F.col("size")).alias("hash"))


# Snapshot algebra

_GONE = "(path = 'src1' OR starts_with(path, 'src1/') OR path = 'src2/en' OR starts_with(path, 'src2/en/'))"
_OVERLAY = f"SELECT {ENTRY} FROM base WHERE NOT {_GONE} AND path NOT IN (SELECT path FROM additions) UNION ALL SELECT {ENTRY} FROM additions"


@query("overlay_staged", fx.sql("base", "additions", body=_OVERLAY))
def _(spark, sf):
    return snapshot.overlay(fx.base(spark, sf), fx.staged_additions(spark, sf), fx.REMOVED)


@query("overlay_staged_table", fx.sql("base", "additions", body=_OVERLAY))
def _(spark, sf):
    removed = spark.createDataFrame([(p,) for p in fx.REMOVED], "path string")
    return snapshot.overlay(fx.base(spark, sf), fx.staged_additions(spark, sf), removed)


@query("remove_prefix", fx.sql("base", body=f"SELECT {ENTRY} FROM base WHERE NOT {_GONE}"))
def _(spark, sf):
    return snapshot.remove(fx.base(spark, sf), fx.REMOVED)


_MOVED = "(path = 'src1' OR starts_with(path, 'src1/'))"


@query("move_prefix", fx.sql("half_meta", body=f"SELECT p AS path, CASE WHEN m AND identity_mode = 'meta' THEN sha256(p || chr(10) || CAST(size AS VARCHAR)) ELSE hash END AS hash, size, mtime_ns, identity_mode, blob_hash, source_uri, footer FROM (SELECT *, {_MOVED} AS m, CASE WHEN {_MOVED} THEN 'archive/one' || substr(path, 5) ELSE path END AS p FROM half_meta)"))
def _(spark, sf):
    return snapshot.move(fx.half_meta(spark, sf), "src1", "archive/one")


@query("move_collisions", fx.sql("base", "ours", body="SELECT DISTINCT b.path FROM base b WHERE starts_with(b.path, 'src3/') AND 'new/' || b.path IN (SELECT path FROM ours)"))
def _(spark, sf):
    # Entries that `ours` renamed are moved back to where a copy of the base still is.
    entries = snapshot.with_prefix(fx.ours(spark, sf), "new/src3/").unionByName(snapshot.within(fx.base(spark, sf), "src3"))
    return snapshot.move_collisions(entries, "new/src3", "src3")


@query("move_staged", fx.sql("base", body="SELECT path, 'remove' AS action, NULL AS identity_mode, NULL AS source_uri, NULL AS blob_hash, NULL AS size FROM base WHERE starts_with(path, 'src4/') UNION ALL SELECT 'moved' || substr(path, 5), 'add', identity_mode, source_uri, blob_hash, size FROM base WHERE starts_with(path, 'src4/')"))
def _(spark, sf):
    return snapshot.move_staged(fx.base(spark, sf), "src4", "moved")


@query("stage_upsert", fx.sql("base", "additions", body="SELECT path, hash FROM base WHERE path NOT IN (SELECT path FROM additions) UNION ALL SELECT path, hash FROM additions"))
def _(spark, sf):
    first = fx.base(spark, sf).select("path", "hash")
    return snapshot.upsert(first, fx.staged_additions(spark, sf).select("path", "hash"))


@query("verify_promote", fx.sql("half_meta", body="SELECT h.path, b.hash, h.size, h.mtime_ns, CASE WHEN h.identity_mode = 'meta' AND NOT starts_with(h.path, 'src2/') THEN 'meta' ELSE 'content' END AS identity_mode, CASE WHEN h.identity_mode = 'meta' AND NOT starts_with(h.path, 'src2/') THEN NULL ELSE b.hash END AS blob_hash, h.source_uri, h.footer FROM half_meta h JOIN base b ON b.path = h.path WHERE NOT (h.identity_mode = 'meta' AND NOT starts_with(h.path, 'src2/')) UNION ALL SELECT h.path, h.hash, h.size, h.mtime_ns, h.identity_mode, h.blob_hash, h.source_uri, h.footer FROM half_meta h WHERE h.identity_mode = 'meta' AND NOT starts_with(h.path, 'src2/')"))
def _(spark, sf):
    return snapshot.promote(fx.half_meta(spark, sf), fx.source_digests(spark, sf), ["src2"])


@query("verify_counts", fx.sql("half_meta", body="SELECT CAST(count(*) FILTER (WHERE blob_hash IS NULL AND mtime_ns % 3 <> 0) AS BIGINT) AS verified, CAST(count(*) FILTER (WHERE blob_hash IS NULL) AS BIGINT) AS candidates, CAST(count(*) AS BIGINT) AS total FROM half_meta"))
def _(spark, sf):
    readable = fx.base(spark, sf).filter("mtime_ns % 2 = 1 and mtime_ns % 3 <> 0").select(F.concat(F.lit("mem://"), "path").alias("source_uri"))
    return snapshot.verify_counts(fx.half_meta(spark, sf), readable)


_DIFF = "SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'modified' END AS change, a.hash AS before_hash, b.hash AS after_hash, a.size AS before_size, b.size AS after_size FROM {0} a FULL OUTER JOIN {1} b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.hash <> b.hash OR a.size <> b.size"


@query("diff_snapshots", fx.sql("base", "ours", body=_DIFF.format("base", "ours")))
def diff_snapshots(spark, sf):
    return diff.diff(fx.base(spark, sf), fx.ours(spark, sf))


@query("diff_changed_directories", fx.sql("base", "theirs", body=_DIFF.format("base", "theirs")))
def _(spark, sf):
    before, after = fx.base(spark, sf), fx.theirs(spark, sf)
    return diff.diff_by_directory(before, after, (tree.directory_digests(before), tree.directory_digests(after)))


@query("status_worktree", fx.sql("half_meta", "ours", body="SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'modified' END AS change FROM half_meta a FULL OUTER JOIN ours b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.size <> b.size OR (a.identity_mode = 'content' AND a.hash <> b.hash)"))
def _(spark, sf):
    return diff.worktree_status(fx.half_meta(spark, sf), fx.ours(spark, sf))


@query("status_stage", fx.sql("base", "additions", body="SELECT a.path, CASE WHEN b.path IS NULL THEN 'added' ELSE 'modified' END AS change FROM additions a LEFT JOIN base b ON a.path = b.path UNION ALL SELECT 'src1', 'removed' UNION ALL SELECT 'src2/en', 'removed'"))
def _(spark, sf):
    removed = spark.createDataFrame([(p, "remove") for p in fx.REMOVED], "path string, action string")
    stage = fx.staged_additions(spark, sf).select("path", F.lit("add").alias("action")).unionByName(removed)
    return diff.stage_status(stage, fx.base(spark, sf))


_SAME = "(({0}.path IS NULL AND {1}.path IS NULL) OR ({0}.path IS NOT NULL AND {1}.path IS NOT NULL AND {0}.hash = {1}.hash AND {0}.size = {1}.size))"
_OT, _BO, _BT = _SAME.format("o", "t"), _SAME.format("b", "o"), _SAME.format("b", "t")
_THREE = f"FROM (SELECT path FROM base UNION SELECT path FROM ours UNION SELECT path FROM theirs) p LEFT JOIN base b ON b.path = p.path LEFT JOIN ours o ON o.path = p.path LEFT JOIN theirs t ON t.path = p.path"


@query("merge_three_way", fx.sql("base", "ours", "theirs", body=f"SELECT p.path, CASE WHEN w = 'o' THEN oh ELSE th END AS hash, CASE WHEN w = 'o' THEN os ELSE ts END AS size, conflict FROM (SELECT p.path, o.hash AS oh, t.hash AS th, o.size AS os, t.size AS ts, CASE WHEN coalesce({_OT}, false) THEN CASE WHEN o.path IS NOT NULL THEN 'o' END WHEN coalesce({_BO}, false) THEN CASE WHEN t.path IS NOT NULL THEN 't' END WHEN coalesce({_BT}, false) THEN CASE WHEN o.path IS NOT NULL THEN 'o' END WHEN o.path IS NOT NULL THEN 'o' ELSE 't' END AS w, NOT coalesce({_OT}, false) AND NOT coalesce({_BO}, false) AND NOT coalesce({_BT}, false) AS conflict {_THREE}) p WHERE w IS NOT NULL"))
def _(spark, sf):
    return merge.three_way_merge(fx.base(spark, sf), fx.ours(spark, sf), fx.theirs(spark, sf)).select("path", "hash", "size", "conflict")


@query("merge_conflicts", fx.sql("base", "ours", "theirs", body=f"SELECT p.path {_THREE} WHERE NOT coalesce({_OT}, false) AND NOT coalesce({_BO}, false) AND NOT coalesce({_BT}, false)"))
def _(spark, sf):
    return merge.conflicts(fx.base(spark, sf), fx.ours(spark, sf), fx.theirs(spark, sf))


@query("full_commit_merge", fx.sql("base", "theirs", "additions", body=f"SELECT {ENTRY} FROM (SELECT {ENTRY} FROM theirs UNION ALL SELECT {ENTRY} FROM base WHERE path NOT IN (SELECT path FROM theirs)) WHERE NOT {_GONE} AND path NOT IN (SELECT path FROM additions) UNION ALL SELECT {ENTRY} FROM additions"))
def _(spark, sf):
    return snapshot.full_commit(fx.base(spark, sf), fx.theirs(spark, sf), fx.staged_additions(spark, sf), fx.REMOVED)


@query("reuse_unchanged", fx.sql("half_meta", "ours", body="SELECT o.path, CASE WHEN s THEN h.hash ELSE o.hash END AS hash, o.size, CASE WHEN s THEN h.mtime_ns ELSE o.mtime_ns + 1 END AS mtime_ns, CASE WHEN s THEN h.identity_mode ELSE 'content' END AS identity_mode FROM (SELECT o.path, h.path IS NOT NULL AND h.size = o.size AND (h.identity_mode = 'meta' OR h.hash = o.hash) AS s FROM ours o LEFT JOIN half_meta h ON h.path = o.path) x JOIN ours o ON o.path = x.path LEFT JOIN half_meta h ON h.path = x.path"))
def _(spark, sf):
    worktree = fx.ours(spark, sf).withColumn("mtime_ns", F.col("mtime_ns") + 1)
    return snapshot.reuse_unchanged(fx.half_meta(spark, sf), worktree).select("path", "hash", "size", "mtime_ns", "identity_mode")


@query("blob_dedup", fx.sql("base", body="SELECT blob_hash, min(size) AS size, CAST(count(*) AS BIGINT) AS n_paths FROM base GROUP BY blob_hash"))
def _(spark, sf):
    return snapshot.distinct_blobs(fx.base(spark, sf))


# Directory digests, with shards and all.


def _shards(lines: str, kind: str) -> str:
    """SQL of dir, shard, digest from dir, name, line."""
    return f"SELECT dir, '{kind}' || left(sha256(name), 2) AS shard, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest FROM ({lines}) GROUP BY ALL"


def _whole(shards: str) -> str:
    return f"SELECT dir, sha256(string_agg(shard || ' ' || digest, chr(10) ORDER BY shard)) AS digest FROM ({shards}) GROUP BY dir"


def _lines(entries: str) -> str:
    return f"SELECT {_DIRECTORY} AS dir, {_NAME} AS name, {_NAME} || chr(9) || identity_mode || chr(9) || hash || chr(9) || CAST(size AS VARCHAR) || chr(9) || coalesce(blob_hash, '-') || chr(9) || coalesce(source_uri, '-') || chr(9) || coalesce(footer, '-') AS line FROM {entries}"


def _parents(below: str) -> str:
    return f"SELECT CASE WHEN contains(dir, '/') THEN regexp_replace(dir, '/[^/]*$', '') ELSE '' END AS dir, regexp_extract(dir, '[^/]*$') AS name, regexp_extract(dir, '[^/]*$') || chr(9) || digest AS line FROM {below}"


_DIRECTORY, _NAME = "regexp_replace(path, '/[^/]*$', '')", "regexp_extract(path, '[^/]*$')"


def _merkle(entries: str) -> str:
    """SQL of a tree whose files all lie two directories below the root."""
    two, one, root = _whole(_shards(_lines(entries), "f")), _whole(_shards(_parents("two"), "d")), _whole(_shards(_parents("one"), "d"))
    return f", two AS ({two}), one AS ({one}), root AS ({root}), digests AS (SELECT * FROM two UNION ALL SELECT * FROM one UNION ALL SELECT * FROM root)"


@query("dir_digest", fx.sql("base", body=_whole(_shards(_lines("base"), "f"))))
def _(spark, sf):
    return tree.directory_digests(fx.base(spark, sf))


@query("merkle_digests", fx.sql("half_meta", body=_merkle("half_meta") + " SELECT dir, digest FROM digests"))
def _(spark, sf):
    return tree.merkle(fx.half_meta(spark, sf), 2)


@query("merkle_digests_by_level", fx.sql("base", body=_merkle("base") + " SELECT dir, digest FROM digests"))
def _(spark, sf):
    return tree.folded(tree.file_shards(fx.base(spark, sf)).drop("repeats"), 2, few=0)


@query("tree_nodes", fx.sql("half_meta", body=_merkle("half_meta") + f" SELECT DISTINCT tree_hash, name, kind, hash, size, mtime_ns, source_uri, footer FROM (SELECT d.digest AS tree_hash, {_NAME} AS name, CASE WHEN identity_mode = 'meta' THEN 'm' ELSE 'b' END AS kind, hash, size, mtime_ns, source_uri, footer FROM half_meta JOIN digests d ON d.dir = {_DIRECTORY} UNION ALL SELECT up.digest, regexp_extract(d.dir, '[^/]*$'), 't', d.digest, NULL, NULL, NULL, NULL FROM digests d JOIN digests up ON up.dir = CASE WHEN contains(d.dir, '/') THEN regexp_replace(d.dir, '/[^/]*$', '') ELSE '' END WHERE d.dir <> '')"))
def _(spark, sf):
    return tree.nodes(fx.half_meta(spark, sf), 2)


@query("tree_reachable", fx.sql("base", body="SELECT CAST(1 + count(DISTINCT regexp_replace(path, '/[^/]*$', '')) + count(DISTINCT split_part(path, '/', 1)) AS BIGINT) AS trees FROM base"))
def _(spark, sf):
    entries = fx.base(spark, sf)
    root = tree.merkle(entries, 2).filter("dir = ''").select(F.col("digest").alias("tree_hash"))
    return tree.reachable_trees(tree.nodes(entries, 2), root).agg(F.count(F.lit(1)).alias("trees"))


@query("manifest_round_trip", fx.sql("half_meta", body=f"SELECT {ENTRY} FROM half_meta"))
def _(spark, sf):
    entries = fx.half_meta(spark, sf)
    return manifest.parse(entries.select(manifest.line(entries).alias("value"))).drop("corrupt")


# Pruning

_LANES = "SELECT g, rows, 'l_orderkey' AS col, ok_min AS lo, ok_max AS hi, NULL AS slo, NULL AS shi, 0 AS nulls FROM rg UNION ALL SELECT g, rows, 'l_quantity', q_min, q_max, NULL, NULL, 0 FROM rg UNION ALL SELECT g, rows, 'l_returnflag', NULL, NULL, f_min, f_max, 0 FROM rg UNION ALL SELECT g, rows, 'line', ln_min, ln_max, NULL, NULL, ln_nulls FROM rg"


def _pruned_sql(keep: str) -> str:
    file = "'lineitem/' || lpad(CAST(g // 10 AS VARCHAR), 4, '0') || '.parquet'"
    return fx.sql("rg", body=f"SELECT path, CAST(count(*) AS INTEGER) AS total_row_groups, coalesce(string_agg(CAST(r AS VARCHAR), ',' ORDER BY r) FILTER (WHERE k), '') AS kept, coalesce(string_agg(CAST(r AS VARCHAR), ',' ORDER BY r) FILTER (WHERE NOT k), '') AS pruned FROM (SELECT {file} AS path, g % 10 AS r, {keep} AS k FROM rg) GROUP BY path")


_CASES = {
    "prune_range": ("l_orderkey >= 1200 AND l_orderkey < 4321", "ok_max >= 1200 AND ok_min < 4321"),
    "prune_eq": ("l_orderkey = 2500", "ok_min <= 2500 AND ok_max >= 2500"),
    "prune_eq_string": ("l_returnflag = 'R'", "f_min <= 'R' AND f_max >= 'R'"),
    "prune_ne": ("line <> 5", "ln_nulls > 0 OR NOT (ln_min = 5 AND ln_max = 5)"),
    "prune_null": ("line IS NULL", "ln_nulls > 0"),
    "prune_not_null": ("l_orderkey IS NOT NULL", "true"),
    "prune_and": ("l_orderkey > 999 AND l_quantity <= 1.5 AND l_returnflag >= 'A'", "ok_max > 999 AND q_min <= 1.5 AND f_max >= 'A'"),
    "prune_unknown": ("no_such_column = 1 AND l_orderkey <= 750", "ok_min <= 750"),
    "prune_type_mismatch": ("l_orderkey = 'abc' AND l_quantity = true", "true"),
}


def _prune_case(name: str, where: str, keep: str) -> None:
    @query(name, _pruned_sql(keep))
    def _(spark, sf):
        found = prune.prune(fx.row_groups(spark, sf), prune.parse_where(where))
        joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
        return found.select("path", "total_row_groups", joined("kept"), joined("pruned"))


for _name, (_where, _keep) in _CASES.items():
    _prune_case(_name, _where, _keep)


@query("prune_summary", fx.sql("rg", body="SELECT CAST(count(DISTINCT g // 10) AS BIGINT) AS files, CAST(count(*) AS BIGINT) AS row_groups, CAST(count(*) FILTER (WHERE ok_max >= 1200 AND ok_min < 4321) AS BIGINT) AS kept, CAST(count(*) FILTER (WHERE NOT (ok_max >= 1200 AND ok_min < 4321)) AS BIGINT) AS pruned FROM rg"))
def _(spark, sf):
    return prune.summary(prune.prune(fx.row_groups(spark, sf), prune.parse_where("l_orderkey >= 1200 AND l_orderkey < 4321")))


@query("prune_applicability", fx.sql("rg", body="SELECT DISTINCT 'lineitem/' || lpad(CAST(g // 10 AS VARCHAR), 4, '0') || '.parquet' AS path, c.n, c.col AS \"column\", c.ok AS applicable FROM rg, (VALUES (0, 'l_orderkey', true), (1, 'nope', false), (2, 'l_returnflag', false)) c(n, col, ok)"))
def _(spark, sf):
    return prune.applicability(fx.row_groups(spark, sf), prune.parse_where("l_orderkey > 5 AND nope = 1 AND l_returnflag < 3")).drop("footer")


@query("pruned_scan_plan", fx.sql("rg", body="SELECT path, kept FROM (SELECT 'lineitem/' || lpad(CAST(g // 10 AS VARCHAR), 4, '0') || '.parquet' AS path, string_agg(CAST(g % 10 AS VARCHAR), ',' ORDER BY g % 10) FILTER (WHERE ok_max >= 6000) AS kept FROM rg GROUP BY 1) WHERE kept IS NOT NULL UNION ALL SELECT 'lineitem/unknown.parquet', NULL"))
def _(spark, sf):
    stats = fx.row_groups(spark, sf)
    files = stats.select("path", "footer").distinct().unionByName(spark.createDataFrame([("lineitem/unknown.parquet", None)], "path string, footer string"))
    entries = files.select("path", "footer", F.lit(None).cast("string").alias("blob_hash"), F.lit(None).cast("string").alias("source_uri"))
    plan = prune.scan_plan(entries, stats, "lineitem/", prune.parse_where("l_orderkey >= 6000"))
    return plan.select("path", F.array_join(F.transform("kept", lambda x: x.cast("string")), ",").alias("kept"))


_WHERE = "l_orderkey >= 1200 AND l_orderkey < 4321 AND l_returnflag = 'R'"


@query("pruned_scan_equals_filter", f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE {_WHERE}")
def _(spark, sf):
    predicates = prune.parse_where(_WHERE)
    stats = fx.row_groups(spark, sf)
    kept = prune.decided(stats, predicates).filter("keep").select("path", "rg")
    place = F.floor(F.col("l_orderkey") / 500).cast("int")
    items = fx.table(spark, sf, "lineitem").filter(prune.where_column(predicates))
    located = items.withColumn("path", F.format_string("lineitem/%04d.parquet", F.floor(place / 10).cast("int"))).withColumn("rg", place % 10)
    return located.join(kept, ["path", "rg"], "left_semi").select("l_orderkey", "l_linenumber", "l_quantity")


# The commit graph and reachability


@query("log_first_parent", fx.sql("commits", body=", chain AS (SELECT n, p1, CAST(0 AS BIGINT) AS distance FROM commits WHERE n = (SELECT max(n) FROM commits) UNION ALL SELECT c.n, c.p1, distance + 1 FROM commits c JOIN chain ON c.n = chain.p1) SELECT CAST(n AS VARCHAR) AS id, distance FROM chain"))
def _(spark, sf):
    commits = fx.commits(spark, sf)
    head = commits.agg(F.max(F.col("id").cast("long")).cast("string").alias("id"))
    return graph.first_parent_log(commits, head).select("id", "distance")


_REACH = ", reach AS (SELECT n, p1, p2 FROM commits WHERE {0} UNION SELECT c.n, c.p1, c.p2 FROM commits c JOIN reach ON c.n = reach.p1 OR c.n = reach.p2)"


@query("ancestors", fx.sql("commits", body=_REACH.format("n IN (149, 777)") + " SELECT CAST(n AS VARCHAR) AS id FROM reach"))
def _(spark, sf):
    return graph.ancestors(fx.commits(spark, sf), spark.createDataFrame([("149",), ("777",)], "id string"))


@query("merge_base", fx.sql("commits", body=", ra AS (SELECT n, p1, p2 FROM commits WHERE n = 345 UNION SELECT c.n, c.p1, c.p2 FROM commits c JOIN ra ON c.n = ra.p1 OR c.n = ra.p2), rb AS (SELECT n, p1, p2 FROM commits WHERE n = 338 UNION SELECT c.n, c.p1, c.p2 FROM commits c JOIN rb ON c.n = rb.p1 OR c.n = rb.p2) SELECT CAST(c.n AS VARCHAR) AS id, c.generation FROM commits c JOIN ra ON ra.n = c.n JOIN rb ON rb.n = c.n ORDER BY c.generation DESC, id LIMIT 1"))
def _(spark, sf):
    one = lambda i: spark.createDataFrame([(str(i),)], "id string")
    return graph.merge_base(fx.commits(spark, sf), one(345), one(338))


@query("generation", fx.sql("commits", body="SELECT c.id FROM commits c LEFT JOIN commits p1 ON p1.n = c.p1 LEFT JOIN commits p2 ON p2.n = c.p2 WHERE c.generation + CASE WHEN c.n % 97 = 0 THEN 1 ELSE 0 END <> coalesce(greatest(p1.generation + CASE WHEN p1.n % 97 = 0 THEN 1 ELSE 0 END, p2.generation + CASE WHEN p2.n % 97 = 0 THEN 1 ELSE 0 END) + 1, 0)"))
def _(spark, sf):
    off = F.when(F.col("id").cast("long") % 97 == 0, 1).otherwise(0)
    return graph.generations_ok(fx.commits(spark, sf).withColumn("generation", F.col("generation") + off))


_BLOBS = "SELECT 'blob' AS kind, blob_hash AS id FROM {0}"


@query("gc_orphans", fx.sql("base", "ours", body=f"SELECT DISTINCT kind, id FROM ({_BLOBS.format('base')}) EXCEPT ({_BLOBS.format('ours')})"))
def _(spark, sf):
    stored = graph.leaf_objects(fx.base(spark, sf))
    return graph.orphans(stored, graph.leaf_objects(fx.ours(spark, sf)))


@query("gc_report", fx.sql("base", "ours", body="SELECT 'blob' AS kind, CAST(count(*) FILTER (WHERE id IN (SELECT blob_hash FROM ours)) AS BIGINT) AS reachable, CAST(count(*) FILTER (WHERE id NOT IN (SELECT blob_hash FROM ours)) AS BIGINT) AS orphaned FROM (SELECT DISTINCT blob_hash AS id FROM base)"))
def _(spark, sf):
    return graph.gc_report(graph.leaf_objects(fx.base(spark, sf)), graph.leaf_objects(fx.ours(spark, sf)))


@query("transfer_plan", fx.sql("base", "ours", body=f"SELECT CAST(1 AS INTEGER) AS rank, kind, id FROM (({_BLOBS.format('ours')}) EXCEPT ({_BLOBS.format('base')}))"))
def _(spark, sf):
    return graph.transfer_plan(graph.leaf_objects(fx.ours(spark, sf)), graph.leaf_objects(fx.base(spark, sf)))


@query("transfer_commands", fx.sql("base", body="SELECT DISTINCT 'cp blobs/' || left(blob_hash, 2) || '/' || substr(blob_hash, 3) || ' remote/blobs/' || left(blob_hash, 2) || '/' || substr(blob_hash, 3) AS command FROM base "))
def _(spark, sf):
    repo = fx.repository(spark, sf)
    lines = repo.transfer_commands("remote", fx.FIRST, metadata=False)
    return lines.select(F.replace(F.replace("command", F.lit(repo.store.url() + "/"), F.lit("")), F.lit("'"), F.lit("")).alias("command"))


@query("commits_to_push", fx.sql("commits", body=_REACH.format("n = 540") + " SELECT CAST(n AS VARCHAR) AS id, CAST(n % 50 AS INTEGER) AS generation FROM reach WHERE n % 50 > 30"))
def _(spark, sf):
    commits = fx.commits(spark, sf)
    return graph.commits_to_push(commits, spark.createDataFrame([("540",)], "id string"), commits.filter("generation <= 30"))


@query("branch_catalog", "SELECT * FROM (VALUES ('empty', NULL, NULL), ('main', '4', 'commit 4'), ('old', '2', 'commit 2')) t(branch, commit_id, message)")
def _(spark, sf):
    refs = spark.createDataFrame([("main", "4", "t"), ("empty", None, "t"), ("old", "2", "t")], schema.REF)
    return catalog.branches(refs, fx.commits(spark, sf))


# The SQL catalog: any SQL over `files`; one query for each kind of it.

_FILES = fx.SQL["base"]


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.files(fx.base(spark, sf), "c0ffee", "main")


def catalog_query(name: str, text: str) -> None:
    """The same text for both engines."""

    @query(name, f"WITH base AS ({_FILES}), files AS (SELECT path, hash, size, mtime_ns, footer, 'c0ffee' AS commit_id, 'main' AS branch FROM base) {text}")
    def _(spark, sf):
        catalog.register(spark, files=_files(spark, sf), labels=fx.table(spark, sf, "labels"))
        return catalog.sql(spark, text)


_DOC = "CAST(regexp_extract(path, '([0-9]+)[.]txt$', 1) AS BIGINT)"
_DIR = "regexp_replace(path, '/[^/]*$', '')"

catalog_query("catalog_files", "SELECT * FROM files")
catalog_query("catalog_like", "SELECT path, size FROM files WHERE path LIKE '%.txt' AND size > 2000 ORDER BY path")
catalog_query("catalog_scalar", f"SELECT path, regexp_extract(path, '[^/]*$', 0) AS name, {_DIR} AS dir, regexp_extract(path, '[.]([^.]*)$', 1) AS ext, CAST(length(path) - length(replace(path, '/', '')) AS BIGINT) AS depth, split_part(path, '/', 1) AS top FROM files")
catalog_query("catalog_group", "SELECT split_part(path, '/', 1) AS source, split_part(path, '/', 2) AS lang, CAST(count(*) AS BIGINT) AS n, CAST(sum(size) AS BIGINT) AS bytes, CAST(max(size) AS BIGINT) AS largest FROM files GROUP BY split_part(path, '/', 1), split_part(path, '/', 2)")
catalog_query("catalog_distinct", "SELECT CAST(count(DISTINCT hash) AS BIGINT) AS blobs, CAST(count(*) AS BIGINT) AS files, CAST(count(*) AS DOUBLE) / count(DISTINCT hash) AS ratio FROM files")
catalog_query("catalog_rollup", "SELECT split_part(path, '/', 1) AS source, split_part(path, '/', 2) AS lang, CAST(sum(size) AS BIGINT) AS bytes FROM files GROUP BY ROLLUP (split_part(path, '/', 1), split_part(path, '/', 2))")
catalog_query("catalog_cube", "SELECT split_part(path, '/', 1) AS source, split_part(path, '/', 2) AS lang, CAST(sum(size) AS BIGINT) AS bytes FROM files GROUP BY CUBE (split_part(path, '/', 1), split_part(path, '/', 2))")
catalog_query("catalog_grouping_sets", "SELECT source, lang, CAST(count(*) AS BIGINT) AS n FROM (SELECT split_part(path, '/', 1) AS source, split_part(path, '/', 2) AS lang FROM files) t GROUP BY GROUPING SETS ((source), (lang), ())")
catalog_query("catalog_window_largest", f"SELECT dir, path, size FROM (SELECT {_DIR} AS dir, path, size, row_number() OVER (PARTITION BY {_DIR} ORDER BY size DESC, path) AS rn FROM files) t WHERE rn = 1")
catalog_query("catalog_window_running", f"SELECT path, CAST(sum(size) OVER (PARTITION BY {_DIR} ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running FROM files")
catalog_query("catalog_top_k", "SELECT path, size FROM files ORDER BY size DESC, path LIMIT 10")
catalog_query("catalog_join_inner", f"SELECT path, quality, toxic FROM files JOIN labels ON {_DOC} = doc_id")
catalog_query("catalog_join_left", f"SELECT path, quality FROM files LEFT JOIN labels ON {_DOC} = doc_id")
catalog_query("catalog_join_semi", f"SELECT path FROM files WHERE {_DOC} IN (SELECT doc_id FROM labels WHERE toxic = 1)")
catalog_query("catalog_join_anti", f"SELECT path FROM files WHERE NOT EXISTS (SELECT 1 FROM labels WHERE doc_id = {_DOC})")
catalog_query("catalog_duplicates", "SELECT a.path AS path, b.path AS copy, a.hash AS hash FROM files a JOIN files b ON a.hash = b.hash AND a.path < b.path")
catalog_query("catalog_intersect", "SELECT split_part(path, '/', 2) AS lang FROM files WHERE path LIKE 'src1/%' INTERSECT SELECT split_part(path, '/', 2) FROM files WHERE path LIKE 'src2/%'")
catalog_query("catalog_except", "SELECT path FROM files EXCEPT SELECT path FROM files WHERE size > 1000")
catalog_query("catalog_union", "SELECT path, 'large' AS kind FROM files WHERE size > 9000 UNION SELECT path, 'first' FROM files WHERE path LIKE 'src1/%'")
catalog_query("catalog_subquery", f"SELECT path, size FROM (SELECT path, size, {_DIR} AS dir FROM files) f WHERE size > (SELECT avg(g.size) FROM (SELECT size, {_DIR} AS dir FROM files) g WHERE g.dir = f.dir)")


@query("catalog_dates", f"WITH base AS ({_FILES}) SELECT date_trunc('day', make_timestamp(mtime_ns * 3600000000)) AS day, CAST(count(*) AS BIGINT) AS n FROM base GROUP BY 1")
def _(spark, sf):
    day = F.date_trunc("DAY", F.timestamp_micros(F.col("mtime_ns") * 3600000000)).cast("timestamp_ntz")
    return _files(spark, sf).groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("catalog_parents", fx.sql("commits", body="SELECT id, CAST(p1 AS VARCHAR) AS parent FROM commits WHERE p1 IS NOT NULL UNION ALL SELECT id, CAST(p2 AS VARCHAR) FROM commits WHERE p2 IS NOT NULL"))
def _(spark, sf):
    return graph.edges(fx.commits(spark, sf))


@query("catalog_json", "SELECT event_id, json_extract_string(props, '$.k') AS k, event_type FROM events")
def _(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), "event_type")


@query("catalog_approximate")
def _(spark, sf):
    return _files(spark, sf).agg(F.approx_count_distinct("hash").alias("blobs"), F.approx_percentile("size", 0.5).alias("median"))


# A repository of three snapshots: what its own methods answer.


@query("reflog_latest_first", "SELECT * FROM (VALUES (3, 'merge'), (2, 'commit'), (1, 'commit'), (0, 'commit')) t(seq, operation)")
def _(spark, sf):
    return fx.repository(spark, sf).reflog("main").select("seq", "operation")


@query("repository_log", "SELECT * FROM (VALUES (0, 'more', 3), (1, 'edits', 2), (2, 'all', 1), (3, 'nothing', 0)) t(place, message, generation)")
def _(spark, sf):
    commits = fx.repository(spark, sf).log("main")
    return spark.createDataFrame([(i, c.message, c.generation) for i, c in enumerate(commits)], "place int, message string, generation int")


@query("repository_ancestry", "SELECT * FROM (VALUES ('first', 'main', true), ('main', 'first', false), ('side', 'main', true), ('main', 'side', true), ('first', 'side', true)) t(old, new, reaches)")
def _(spark, sf):
    repo = fx.repository(spark, sf)
    pairs = [("first", "main"), ("main", "first"), ("side", "main"), ("main", "side"), ("first", "side")]
    ids = {"first": fx.FIRST, "main": "main", "side": "side"}
    return spark.createDataFrame([(a, b, repo.is_ancestor(repo.resolve(ids[a]), repo.resolve(ids[b]))) for a, b in pairs], "old string, new string, reaches boolean")


@query("repository_diff", fx.sql("base", "ours", body=_DIFF.format("base", "ours")))
def _(spark, sf):
    repo = fx.repository(spark, sf)
    return repo.diff(fx.FIRST, fx.SECOND)


@query("repository_staged", fx.sql("base", "ours", body=f"SELECT {ENTRY} FROM ours WHERE NOT (path = 'src1' OR starts_with(path, 'src1/')) AND starts_with(path, 's')"))
def _(spark, sf):
    return fx.repository(spark, sf).entries(fx.STAGED, staged=True, prefix="s")


@query("repository_pushed", fx.sql("base", "ours", body=f"SELECT {ENTRY} FROM ours"))
def _(spark, sf):
    from ..repository import Repository

    remote = Repository.init(spark, fx.place(spark, "remote"))
    fx.repository(spark, sf).push(remote, "main")
    return remote.entries("main")


@query("manifest_files", fx.sql("half_meta", body=f"SELECT {ENTRY} FROM half_meta"))
def _(spark, sf):
    path = fx.place(spark, "manifest")
    manifest.write(fx.half_meta(spark, sf), path)
    return manifest.read(spark, path)


@query("versioned_source", fx.sql("base", body=f"SELECT {ENTRY} FROM base WHERE starts_with(path, 'src1')"))
def _(spark, sf):
    from ..sources.versioned import read

    repo = fx.repository(spark, sf)
    return read(spark, repo.root, repo.resolve(fx.FIRST), "src1").filter(F.col("path").startswith("src1"))


_STATS = ("lineitem", "l_orderkey", "l"), ("lineitem", "l_quantity", "d"), ("orders", "o_orderkey", "l"), ("documents", "doc_id", "l"), ("labels", "toxic", "l")


@query("footer_statistics", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", '{c}' AS col, CAST(count(*) AS BIGINT) AS rows, CAST(min({c}) AS DOUBLE) AS least, CAST(max({c}) AS DOUBLE) AS most, CAST(count(*) - count({c}) AS BIGINT) AS nulls FROM {t}" for t, c, _ in _STATS))
def _(spark, sf):
    """Statistics that the footers of the tables' own files hold, over all their row groups."""
    files = None
    for t in sorted({t for t, _, _ in _STATS}):
        here = spark.createDataFrame([(f, t) for f in fx.table(spark, sf, t).inputFiles()], "source_uri string, table string")
        files = here if files is None else files.unionByName(here)
    found = footers.capture(files).join(files, "source_uri")
    stats = footers.row_group_stats(found).join(found.select("footer", "table"), "footer")
    value = lambda m: F.coalesce(F.col(f"{m}_l").cast("double"), F.col(f"{m}_d"))
    wanted = F.array(*(F.lit(f"{t}.{c}") for t, c, _ in _STATS))
    return stats.filter(F.array_contains(wanted, F.concat_ws(".", "table", "col"))).groupBy("table", "col").agg(
        F.sum("rows").alias("rows"), F.min(value("min")).alias("least"), F.max(value("max")).alias("most"), F.sum("nulls").alias("nulls")
    )


@query("schema_fingerprint", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", {n} AS columns, true AS same FROM range(1)" for t, n in (("lineitem", "(SELECT count(*) FROM pragma_table_info('lineitem'))"), ("orders", "(SELECT count(*) FROM pragma_table_info('orders'))"))))
def _(spark, sf):
    """Files of one schema have one fingerprint, which the captured names and types give again."""
    files = spark.createDataFrame([(f, t) for t in ("lineitem", "orders") for f in fx.table(spark, sf, t).inputFiles()], "source_uri string, table string")
    found = footers.capture(files).join(files, "source_uri")
    # The fingerprint is that of the names and types as compact JSON.
    again = F.sha2(F.to_json("schema"), 256)
    return found.groupBy("table").agg(F.max(F.size("schema")).cast("long").alias("columns"), ((F.count_distinct("schema_hash") == 1) & F.bool_and(F.col("schema_hash") == again)).alias("same"))
