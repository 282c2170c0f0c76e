"""A repository: the driver's control flow over stores, snapshots and commits.

Bulk work (listing, hashing, joins, copies) runs as Spark jobs; the driver itself holds a stage, a chain of commits, or
a handful of names. An object store needs no working tree: files are then added by URI.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import os
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .config import Config
from .errors import MergeConflict, NonFastForward, NotARepository, ObjectMissing, OptimisticLock, RefConflict, StrataError
from .functions.identity import meta_hash
from .functions.paths import matches_glob, normalize_path, normalize_paths, normalize_patterns, relative_key, under
from .operators import diff, graph, merge, prune, snapshot
from .plans import catalog
from .shared import importable, materialize
from .sources import files as sources
from .sources.files import META_DIR
from .sources.store import Commit, Store, meta_uri

#: Attempts of a staged commit whose branch others move.
ATTEMPTS = 3
#: Seconds for which collection leaves new objects alone.
GRACE = 24 * 3600.0
#: Commits that the driver walks one by one; longer histories are read as a table, by the graph operators.
WALKED = 200

#: Told of a kind of object and how many of it were sent.
Progress = Callable[[str, int], None]


@dataclass(frozen=True)
class MergeResult:
    commit_id: str | None
    kind: str  # up-to-date, fast-forward or merge


@dataclass(frozen=True)
class VerifyResult:
    commit_id: str | None
    verified: int
    candidates: int
    total: int


@dataclass(frozen=True)
class SyncResult:
    branch: str
    commit_id: str | None
    commits: int
    blobs: int
    moved: bool


@dataclass(frozen=True)
class Status:
    branch: str
    added: list[str]
    removed: list[str]
    modified: list[str]
    staged_changes: list[tuple[str, str]]
    worktree: list[tuple[str, str]] | None = None


def _now() -> str:
    return datetime.datetime.now(datetime.timezone.utc).isoformat()


def _uri(root: str, path: str) -> str:
    return f"{root.rstrip('/')}/{path}"


class Repository:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/") or "/"
        importable(spark)
        self.store = Store(spark, meta_uri(self.root))
        text = self.store.read("config.json")
        if text is None:
            raise NotARepository(f"not a repository: {root}")
        self.config = Config.loads(text.decode())

    # Opening

    @staticmethod
    def init(spark: SparkSession, root: str, config: Config | None = None) -> Repository:
        """Creates a repository at root, or opens the one there. Existing settings stay unless config is given."""
        root = root if "://" in root else os.path.abspath(root)
        store = Store(spark, meta_uri(root))
        if config is not None or store.read("config.json") is None:
            store.write((config or Config()).dumps().encode(), "config.json")
        repo = Repository(spark, root)
        if store.head() is None:
            store.set_head(repo.config.default_branch)
        if not store.branches():
            store.set_ref(repo.config.default_branch, None, 0)
        return repo

    @staticmethod
    def open(spark: SparkSession, start: str = ".") -> Repository:
        """The repository at start, or locally at the nearest folder above it."""
        if "://" in start:
            return Repository(spark, start)
        here = os.path.abspath(start)
        while not os.path.isfile(os.path.join(here, META_DIR, "config.json")):
            if os.path.dirname(here) == here:
                raise NotARepository(f"not a repository (or any folder above it): {start}")
            here = os.path.dirname(here)
        return Repository(spark, here)

    def set_config(self, key: str, value: str) -> None:
        self.config = self.config.with_value(key, value)
        self.store.write(self.config.dumps().encode(), "config.json")

    # Refs and commits

    @property
    def branch_name(self) -> str:
        return self.store.head() or self.config.default_branch

    def _ref(self, branch: str) -> tuple[str | None, int]:
        found = self.store.ref(branch)
        if found is None:
            raise StrataError(f"no branch '{branch}'")
        return found

    def resolve(self, ref: str | None = None) -> str:
        """The commit of a branch, or of an id; an error for an empty branch and for what is neither."""
        name = ref or self.branch_name
        found = self.store.ref(name) if "/" not in name else None
        if found:
            if found[0] is None:
                raise StrataError(f"branch '{name}' has no commits")
            return found[0]
        if "/" not in name and self.store.has_commit(name):
            return name
        raise StrataError(f"no branch or commit '{name}'")

    def _long(self) -> bool:
        return len(self.store.names("commits")) > WALKED

    def _ids(self, *ids: str) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], "id string")

    def _ancestors(self, *heads: str | None) -> set[str]:
        """Every commit that heads reach, by any parents."""
        if self._long():
            return {r["id"] for r in graph.ancestors(self.store.commits(), self._ids(*filter(None, heads))).toLocalIterator()}
        found: set[str] = set()
        work = [h for h in heads if h]
        while work:
            one = work.pop()
            if one not in found:
                found.add(one)
                work += self.store.commit(one).parents
        return found

    def is_ancestor(self, old: str | None, new: str | None) -> bool:
        """Whether new reaches old. Commits of a lower generation than old's are not walked."""
        if old is None or old == new:
            return True
        if new is None:
            return False
        floor, seen, work = self.store.commit(old).generation, set(), [new]
        if self._long():
            recent = self.store.commits().filter(F.col("generation") >= floor)
            return not graph.ancestors(recent, self._ids(new)).filter(F.col("id") == old).isEmpty()
        while work:
            one = work.pop()
            if one == old:
                return True
            if one not in seen and self.store.commit(one).generation > floor:
                seen.add(one)
                work += self.store.commit(one).parents
        return False

    def merge_base(self, a: str, b: str) -> str | None:
        if self._long():
            found = graph.merge_base(self.store.commits(), self._ids(a), self._ids(b)).first()
            return found["id"] if found else None
        common = self._ancestors(a) & self._ancestors(b)
        return min(common, key=lambda c: (-self.store.commit(c).generation, c), default=None)

    def log(self, ref: str | None = None) -> list[Commit]:
        """The first-parent chain, newest first; nothing for an empty branch."""
        name = ref or self.branch_name
        found = self.store.ref(name)
        at = found[0] if found else self.resolve(name)
        if at and self._long():
            commits = self.store.commits()
            rows = graph.first_parent_log(commits, self._ids(at)).select("id", "distance").join(commits, "id").orderBy("distance").drop("distance")
            return [Commit(**{**r.asDict(), "parents": tuple(r["parents"])}) for r in rows.toLocalIterator()]
        out = []
        while at:
            out.append(self.store.commit(at))
            at = out[-1].parents[0] if out[-1].parents else None
        return out

    def _write_commit(self, entries: DataFrame, message: str, parents: Iterable[str | None], branch: str) -> str:
        return self._commit_tree(self.store.put_tree(entries), message, parents, branch)

    def _commit_tree(self, tree: str, message: str, parents: Iterable[str | None], branch: str) -> str:
        kept = tuple(p for p in parents if p)
        fields = {
            "message": message, "tree": tree, "parents": list(kept), "created_at": _now(), "branch": branch,
            "generation": max((self.store.commit(p).generation + 1 for p in kept), default=0),
        }
        commit_id = hashlib.sha256(json.dumps(fields, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        self.store.put_commit(Commit(id=commit_id, **{**fields, "parents": kept}))
        return commit_id

    def _move_ref(self, branch: str, old: str | None, version: int, new: str, operation: str) -> None:
        try:
            self.store.set_ref(branch, new, version)
        except OptimisticLock as e:
            raise RefConflict(branch, operation, old, (self.store.ref(branch) or (None, 0))[0]) from e
        self.store.log_ref(branch, old, new, operation, _now())

    def _message(self, message: str) -> str:
        if not message.strip():
            raise StrataError("a commit message cannot be blank")
        return message

    # Branches

    def branch(self, name: str) -> str | None:
        """Creates a branch at the current one's commit, which may be none."""
        if not name or "/" in name or name.startswith(".") or any(ord(c) < 33 for c in name):
            raise StrataError(f"invalid branch name '{name}'")
        if self.store.ref(name) is not None:
            raise StrataError(f"branch '{name}' already exists")
        at = self._ref(self.branch_name)[0]
        try:
            self.store.set_ref(name, at, 0)
        except OptimisticLock as e:
            raise RefConflict(name, "branch", None, (self.store.ref(name) or (None, 0))[0]) from e
        self.store.log_ref(name, None, at, "branch", _now())
        return at

    def checkout(self, name: str) -> None:
        """Makes a branch the current one. Files are left as they are."""
        self._ref(name)
        self.store.set_head(name)

    def catalog(self) -> DataFrame:
        """branch, commit_id, message, sorted by branch."""
        return catalog.branches(self.store.refs(), self.store.commits())

    def reflog(self, branch: str | None = None) -> DataFrame:
        return self.store.reflog(branch or self.branch_name)

    # Reading

    def _committed(self, ref: str | None) -> DataFrame:
        return self.store.entries(self._tree(ref))

    def entries(self, ref: str | None = None, staged: bool = False, prefix: str = "") -> DataFrame:
        """The entries of a ref, with the branch's staged changes on top if asked; prefix is a textual one."""
        rows = self._committed(ref)
        if staged:
            branch = ref or self.branch_name
            additions, removed = self._staged(branch, store=False)
            rows = snapshot.overlay(rows, additions, removed)
        return snapshot.with_prefix(rows, prefix)

    def lookup(self, path: str, ref: str | None = None, staged: bool = False) -> dict | None:
        row = snapshot.lookup(self.entries(ref, staged), normalize_path(path)).first()
        return row.asDict() if row else None

    def open_entry(self, path: str, ref: str | None = None, staged: bool = False):
        """The bytes of one entry as a file: its blob, or else its source."""
        entry = self.lookup(path, ref, staged)
        if entry is None:
            raise ObjectMissing(f"no entry {path}")
        if entry["blob_hash"]:
            try:
                return self.store.open_blob(entry["blob_hash"])
            except ObjectMissing:
                if not entry["source_uri"]:
                    raise
        if not entry["source_uri"]:
            raise ObjectMissing(f"no stored bytes of {path}")
        return sources.open_stream(entry["source_uri"])

    def cat(self, path: str, ref: str | None = None) -> bytes:
        with self.open_entry(path, ref) as f:
            return f.read()

    def _tree(self, ref: str | None) -> str | None:
        """The snapshot of a ref; None for a branch without commits."""
        name = ref or self.branch_name
        found = self.store.ref(name) if "/" not in name else None
        return None if found and found[0] is None else self.store.commit(self.resolve(name)).tree

    def diff(self, before: str, after: str) -> DataFrame:
        """DIFF rows by path. Where both snapshots have their directories' digests, only directories that differ are
        read."""
        trees = self._tree(before), self._tree(after)
        rows = [self.store.entries(t) for t in trees]
        digests = [self.store.directories(t) if t else None for t in trees]
        if None in digests:
            return diff.diff(*rows).orderBy("path")
        return diff.diff_by_directory(*rows, tuple(digests)).orderBy("path")

    # Staging

    def _put_stage(self, branch: str, changes: list[dict]) -> None:
        """Adds changes to the stage; the last one of a path wins."""
        known = {c["path"]: c for c in self.store.stage(branch)}
        known.update((c["path"], c) for c in changes)
        self.store.set_stage(branch, list(known.values()))

    def expand(self, raw: str, target: str | None = None) -> list[dict]:
        """path, source_uri, size, mtime_ns of the files that a source names: a file, a folder, or a URI of either."""
        external = "://" in raw
        if external:
            uri, name = raw.rstrip("/"), raw.rstrip("/").rpartition("/")[2]
        else:
            path = os.path.relpath(os.path.join(self.root, raw), self.root) if os.path.isabs(raw) else raw
            name = normalize_path(path)
            uri = f"file://{os.path.join(self.root, name)}"
        base = normalize_path(target) if target else name
        try:
            size, mtime = sources.describe(uri)
            return [{"path": base, "source_uri": uri if external else None, "file": uri, "size": size, "mtime_ns": mtime}]
        except ValueError:
            pass
        except FileNotFoundError as e:
            raise StrataError(f"no such file: {raw}") from e
        found = [
            {"path": f"{base}/{path}" if not external or target else path, "source_uri": full if external else None, "file": full, "size": size, "mtime_ns": mtime}
            for path, full, size, mtime in sources.walk(uri if external else uri.removeprefix("file://"))
        ]
        if not found:
            raise StrataError(f"no files below {raw}")
        return found

    def add(self, paths: Iterable[str], identity: str | None = None, target: str | None = None) -> list[str]:
        """Stages files, folders and URIs; with target (one source only) under another path."""
        paths = list(paths)
        if target and len(paths) != 1:
            raise StrataError("a target path needs exactly one source")
        mode = identity or self.config.identity
        if mode not in (schema.CONTENT, schema.META):
            raise StrataError(f"identity must be content or meta, not '{mode}'")
        found = [f for p in paths for f in self.expand(p, target)]
        self._put_stage(self.branch_name, [{"action": "add", "identity_mode": mode, **f} for f in found])
        return sorted({f["path"] for f in found})

    def rm(self, paths: Iterable[str]) -> list[str]:
        """Stages the removal of paths and all below them. Whether they exist isn't checked."""
        names = normalize_paths(paths)
        kept = [c for c in self.store.stage(self.branch_name) if not any(c["path"] == n or c["path"].startswith(n + "/") for n in names)]
        self.store.set_stage(self.branch_name, kept + [{"path": n, "action": "remove"} for n in names])
        return names

    def mv(self, source: str, target: str) -> int:
        """Stages a rename: a removal and an addition for each entry. Digests, sources and footers go along."""
        source, target = normalize_path(source), normalize_path(target)
        self._check_move(source, target)
        hit = self.entries(staged=True).filter(under(F.col("path"), source)).collect()
        if not hit:
            raise StrataError(f"no entries at {source}")
        changes = [{"path": e["path"], "action": "remove"} for e in hit]
        changes += [{"action": "add", **e.asDict(), "path": target + e["path"][len(source) :], "moved": True} for e in hit]
        self._put_stage(self.branch_name, changes)
        return len(hit)

    def _staged(self, branch: str, store: bool = True) -> tuple[DataFrame, list[str]]:
        """Staged additions as entries, and removed prefixes. With store the bytes of content entries are copied."""
        changes = self.store.stage(branch)
        removed = [c["path"] for c in changes if c["action"] == "remove"]
        added = [c for c in changes if c["action"] == "add"]
        moved = [c for c in added if c.get("moved")]
        out = self.spark.createDataFrame([{k: c.get(k) for k in schema.ENTRY_COLUMNS} for c in moved], schema.ENTRY) if moved else self.store.empty()
        if moved:
            renamed = F.when(F.col("identity_mode") == schema.META, meta_hash(F.col("path"), F.col("size"))).otherwise(F.col("hash"))
            out = out.withColumn("hash", renamed)
        fresh = [(c["path"], c["identity_mode"], c.get("source_uri"), c["file"], c["size"], c["mtime_ns"]) for c in added if not c.get("moved")]
        if fresh:
            rows = self.spark.createDataFrame(fresh, "path string, identity_mode string, source_uri string, file string, size long, mtime_ns long")
            out = out.unionByName(self._identified(rows, store))
        return out, removed

    def _identified(self, rows: DataFrame, store: bool) -> DataFrame:
        """Entries of files: path, identity_mode, source_uri (null for working files), file, size, mtime_ns."""
        content = rows.filter(F.col("identity_mode") == schema.CONTENT)
        known = sources.digests(content.select(F.col("file").alias("source_uri"))).withColumnRenamed("source_uri", "file")
        if store:
            known = materialize(known, "digests")
        read = content.drop("size").join(known, "file").select("path", F.col("digest").alias("hash"), F.col("n_bytes").alias("size"), "mtime_ns", "identity_mode", F.col("digest").alias("blob_hash"), "source_uri", "file")
        meta = rows.filter(F.col("identity_mode") == schema.META).select(
            "path", meta_hash(F.col("path"), F.col("size")).alias("hash"), "size", "mtime_ns", "identity_mode",
            F.lit(None).cast("string").alias("blob_hash"), F.coalesce("source_uri", "file").alias("source_uri"), "file",
        )
        both = read.unionByName(meta)
        if store:
            sources.store_blobs(read.select("hash", F.col("file").alias("source_uri")), self.store.url("blobs")).foreachPartition(_exhaust)
        if store and self.config.parquet_footer:
            footers = self.store.capture_footers(both.select(F.col("file").alias("source_uri"))).withColumnRenamed("source_uri", "file")
            return both.join(footers, "file", "left").select(schema.ENTRY_COLUMNS)
        return both.withColumn("footer", F.lit(None).cast("string")).select(schema.ENTRY_COLUMNS)

    def _working_files(self) -> DataFrame:
        return sources.list_files(self.spark, self.root)

    # Writing

    def commit(self, message: str, staged_only: bool = False) -> str:
        """Commits the working tree and the stage, or the stage alone. A staged commit is tried again on the new head
        when another writer moves the branch meanwhile; a full one raises RefConflict."""
        self._message(message)
        branch = self.branch_name
        if staged_only and not self.store.stage(branch):
            raise StrataError("nothing is staged")
        additions, removed = self._staged(branch)
        additions = materialize(additions, "additions")
        for attempt in range(ATTEMPTS):
            head, version = self._ref(branch)
            parent = self.store.entries(self.store.commit(head).tree) if head else self.store.empty()
            if staged_only:
                rows = snapshot.overlay(parent, additions, removed)
            else:
                found = self._working_files().withColumn("identity_mode", F.lit(self.config.identity)).withColumnRenamed("source_uri", "file").withColumn("source_uri", F.lit(None).cast("string"))
                rows = snapshot.full_commit(parent, snapshot.reuse_unchanged(parent, self._identified(found, True)), additions, removed)
            commit_id = self._write_commit(rows, message, [head], branch)
            try:
                self._move_ref(branch, head, version, commit_id, "commit")
                break
            except RefConflict:
                if not staged_only or attempt == ATTEMPTS - 1:
                    raise
        self.store.set_stage(branch, [])
        return commit_id

    def _commit_entries(self, rows: DataFrame, message: str, operation: str, branch: str | None = None) -> str:
        branch = branch or self.branch_name
        head, version = self._ref(branch)
        commit_id = self._write_commit(rows, self._message(message), [head], branch)
        self._move_ref(branch, head, version, commit_id, operation)
        return commit_id

    def remove_paths(self, paths: Iterable[str], message: str) -> str:
        """Commits the removal of paths and all below them; at least one entry must match."""
        names = normalize_paths(paths)
        rows = self._committed(None)
        if snapshot.select_under(rows, names).isEmpty():
            raise StrataError(f"no entries at {', '.join(names)}")
        return self._commit_entries(snapshot.remove(rows, names), message, "rm")

    def _check_move(self, source: str, target: str) -> None:
        if source == target:
            raise StrataError("source and target of a move are the same path")
        if target.startswith(source + "/"):
            raise StrataError("a path can't be moved into itself")

    def move(self, source: str, target: str, message: str) -> str:
        """Commits a rename of a path or folder. Nothing is overwritten."""
        source, target = normalize_path(source), normalize_path(target)
        self._check_move(source, target)
        rows = self._committed(None)
        if snapshot.within(rows, source).isEmpty():
            raise StrataError(f"no entries at {source}")
        taken = [r["path"] for r in snapshot.move_collisions(rows, source, target).orderBy("path").limit(5).collect()]
        if taken:
            raise StrataError(f"already there: {', '.join(taken)}")
        return self._commit_entries(snapshot.move(rows, source, target), message, "mv")

    def import_source(self, uri: str, message: str, identity: str | None = None, patterns: Iterable[str] | None = None, ref: str | None = None) -> str:
        """Commits the files below a URI, those that match any of the patterns, by their paths relative to it."""
        globs = normalize_patterns(patterns)
        listing = sources.list_files(self.spark, uri.removeprefix("file://"))
        path = relative_key(F.col("path"), F.col("size"), "")
        rows = listing.withColumn("path", path).filter("path is not null").filter(matches_glob(F.col("path"), globs))
        rows = rows.withColumn("identity_mode", F.lit(identity or self.config.identity)).withColumn("file", F.col("source_uri"))
        additions = materialize(self._identified(rows, True), "import")
        if additions.isEmpty():
            raise StrataError(f"no files to import below {uri}")
        return self._commit_entries(snapshot.overlay(self._committed(ref), additions, []), message, "import", ref)

    def verify(self, ref: str | None = None, prefixes: Iterable[str] = (), dry_run: bool = False, message: str = "Verify entries") -> VerifyResult:
        """Reads the sources of entries without stored bytes and promotes them to content mode."""
        branch = ref or self.branch_name
        names = normalize_paths(prefixes)
        rows = self._committed(branch)
        wanted = snapshot.verify_candidates(rows, names)
        if dry_run:
            n, total = wanted.count(), rows.count()
            return VerifyResult(None, 0, n, total)
        digests = materialize(sources.digests(wanted), "verified")
        counts = snapshot.verify_counts(rows, digests, names).first()
        commit_id = None
        if counts["verified"]:
            sources.store_blobs(digests.select(F.col("digest").alias("hash"), "source_uri"), self.store.url("blobs")).foreachPartition(_exhaust)
            commit_id = self._commit_entries(snapshot.promote(rows, digests, names), message, "verify", branch)
        return VerifyResult(commit_id, counts["verified"], counts["candidates"], counts["total"])

    def merge(self, source: str, target: str | None = None, message: str | None = None) -> MergeResult:
        """Merges a ref into a branch: nothing to do, a fast-forward, or a three-way merge with two parents."""
        branch = target or self.branch_name
        theirs, (ours, version) = self.resolve(source), self._ref(branch)
        if self.is_ancestor(theirs, ours):
            return MergeResult(ours, "up-to-date")
        if self.is_ancestor(ours, theirs):
            self._move_ref(branch, ours, version, theirs, "merge")
            return MergeResult(theirs, "fast-forward")
        base = self.merge_base(ours, theirs)
        tree = lambda c: self.store.entries(self.store.commit(c).tree) if c else self.store.empty()
        merged = materialize(merge.three_way_merge(tree(base), tree(ours), tree(theirs)), "merge")
        bad = [r["path"] for r in merged.filter("conflict").select("path").orderBy("path").collect()]
        if bad:
            raise MergeConflict(bad)
        commit_id = self._write_commit(merged.drop("conflict"), message or f"Merge {source} into {branch}", [ours, theirs], branch)
        self._move_ref(branch, ours, version, commit_id, "merge")
        return MergeResult(commit_id, "merge")

    def fast_forward(self, branch: str, target: str, operation: str = "fast-forward") -> bool:
        """Moves a branch to a descendant of its commit; whether it moved."""
        at, version = self._ref(branch)
        if at == target:
            return False
        if not self.is_ancestor(at, target):
            raise NonFastForward(branch, at, target)
        self._move_ref(branch, at, version, target, operation)
        return True

    # Status

    def worktree_changes(self, ref: str | None = None) -> DataFrame:
        """path, change of the working files against a ref."""
        rows = self._working_files()
        return diff.worktree_status(self._committed(ref), sources.build_entries(rows))

    def status(self, working_tree: bool = False) -> Status:
        branch = self.branch_name
        changes = self.store.stage(branch)
        added = [c["path"] for c in changes if c["action"] == "add"]
        removed = [c["path"] for c in changes if c["action"] == "remove"]
        staged: list[tuple[str, str]] = []
        if changes:
            stage = self.spark.createDataFrame([(c["path"], c["action"]) for c in changes], "path string, action string")
            staged = [tuple(r) for r in diff.stage_status(stage, self._committed(None)).orderBy("path").collect()]
        files = [tuple(r) for r in self.worktree_changes().orderBy("path").collect()] if working_tree else None
        return Status(branch, added, removed, [], staged, files)

    def restore(self, ref: str | None = None, paths: Iterable[str] | None = None, force: bool = False) -> int:
        """Writes files of a ref below the root; existing ones only with force. Unknown paths are ignored."""
        rows = self._committed(ref)
        if paths is not None:
            rows = snapshot.select_under(rows, normalize_paths(paths))
        blob = F.concat(F.lit(self.store.url("blobs") + "/"), F.left("blob_hash", F.lit(2)), F.lit("/"), F.substring("blob_hash", 3, 64))
        target = self.root if "://" in self.root else f"file://{self.root}"
        wanted = rows.select(F.coalesce(blob, F.col("source_uri")).alias("source"), F.concat(F.lit(target + "/"), "path").alias("target")).filter("source is not null")
        return sources.copy_objects(wanted, replace=force).filter("copied").count()

    # Reachability and transfer

    def _trees(self, commit_ids: Iterable[str]) -> DataFrame:
        """All entries of these commits' snapshots, read as one table."""
        trees = sorted({self.store.commit(c).tree for c in commit_ids})
        if not trees:
            return self.store.empty()
        return self.spark.read.schema(schema.ENTRY).parquet(*(self.store.url("snapshots", t) for t in trees))

    def _objects(self, commit_ids: Iterable[str]) -> DataFrame:
        """kind, id of all that commits need."""
        ids = sorted(commit_ids)
        own = [("commit", c) for c in ids] + [("tree", t) for t in sorted({self.store.commit(c).tree for c in ids})]
        return graph.leaf_objects(self._trees(ids)).unionByName(self.spark.createDataFrame(own, "kind string, id string"))

    def gc(self, dry_run: bool = True, grace: float = GRACE) -> dict[str, tuple[int, int]]:
        """Reachable and orphaned objects of each kind; without dry_run orphans are deleted. Then what was written in the last
        `grace` seconds is neither counted nor touched, as a writer may be about to refer to it."""
        before = time.time_ns() - int(grace * 1e9) if grace and not dry_run else None
        # Objects are listed before the refs are read: what a writer links meanwhile is among the live ones.
        stored = materialize(self.store.objects(before), "stored")
        heads = [r[0] for b in self.store.branches() if (r := self.store.ref(b)) and r[0]]
        live = materialize(self._objects(self._ancestors(*heads)), "live")
        counts = {r["kind"]: (r["reachable"], r["orphaned"]) for r in graph.gc_report(stored, live).collect()}
        if not dry_run:
            dead = materialize(graph.orphans(stored, live), "orphans")
            root = self.store.url("blobs")

            def delete(rows):
                for r in rows:
                    fs, path = sources.open_fs(sources.blob_path(root, r["id"]))
                    fs.delete_file(path)

            dead.filter("kind = 'blob'").foreachPartition(delete)
            for r in dead.filter("kind in ('commit', 'tree')").toLocalIterator():
                for path in [("commits", f"{r['id']}.json")] if r["kind"] == "commit" else [(k, r["id"]) for k in ("snapshots", "directories", "manifests")]:
                    self.store.delete(*path)
            gone = dead.filter("kind = 'footer'").select(F.col("id").alias("footer"))
            if not gone.isEmpty():
                self.store.forget_footers(gone)
        return counts

    def _send(self, target: Repository, commit_ids: list[str], progress: Progress) -> int:
        """Copies what target lacks of commits: blobs, footers and snapshots first, then commits, oldest first. progress is
        told of each kind of object and how many were sent."""
        needed = materialize(graph.transfer_plan(self._objects(commit_ids), target.store.objects()), "plan")
        blobs = needed.filter("kind = 'blob'")
        at = lambda store: F.concat(F.lit(store.url("blobs") + "/"), F.left("id", F.lit(2)), F.lit("/"), F.substring("id", 3, 64))
        stored = self.store.objects().filter("kind = 'blob'")
        # Entries verified elsewhere may name blobs that this store never held; they stay missing on both sides.
        copies = blobs.join(stored, ["kind", "id"], "left_semi").select(at(self.store).alias("source"), at(target.store).alias("target"))
        n = sources.copy_objects(copies).count()
        missing = needed.filter("kind = 'footer'").select(F.col("id").alias("footer"))
        if not missing.isEmpty():
            self.store.footers().join(missing, "footer", "left_semi").write.mode("append").parquet(target.store.url("footers"))
        progress("blob", n)
        trees = [(kind, r["id"]) for r in needed.filter("kind = 'tree'").toLocalIterator() for kind in ("directories", "snapshots")]
        files = [(*t, x) for t in trees for x in self.store.names(*t) if x != "_SUCCESS"]
        if files:
            pairs = [(self.store.url(*f), target.store.url(*f)) for f in files]
            sources.copy_objects(self.spark.createDataFrame(pairs, "source string, target string")).foreachPartition(_exhaust)
        for t in trees:
            if "_SUCCESS" in self.store.names(*t):
                target.store.write(b"", *t, "_SUCCESS")
        progress("tree", len(trees) // 2)
        for c in sorted((self.store.commit(c) for c in commit_ids), key=lambda c: c.generation):
            target.store.put_commit(c)
        progress("commit", len(commit_ids))
        return n

    def _missing_commits(self, target: Repository, head: str) -> list[str]:
        """Commits that head needs and target lacks. A commit that is there has all its ancestors there."""
        if self._long():
            rows = graph.commits_to_push(self.store.commits(), self._ids(head), target.store.commits())
            return [r["id"] for r in rows.orderBy("generation", "id").toLocalIterator()]
        found, work = set(), [head]
        while work:
            one = work.pop()
            if one not in found and not target.store.has_commit(one):
                found.add(one)
                work += self.store.commit(one).parents
        return sorted(found, key=lambda c: self.store.commit(c).generation)

    def push(self, remote: Repository, branch: str | None = None, progress: Progress = lambda kind, n: None) -> SyncResult:
        """Sends a branch to another repository; its branch must be behind ours, which is checked before copying."""
        name = branch or self.branch_name
        head = self.resolve(name)
        there = remote.store.ref(name)
        at, version = there or (None, 0)
        if at == head:
            return SyncResult(name, head, 0, 0, False)
        if at and not (self.store.has_commit(at) and self.is_ancestor(at, head)):
            raise NonFastForward(name, at, head)
        wanted = self._missing_commits(remote, head)
        blobs = self._send(remote, wanted, progress)
        remote._move_ref(name, at, version, head, "push")
        return SyncResult(name, head, len(wanted), blobs, True)

    def fetch(self, remote: Repository, branch: str | None = None, progress: Progress = lambda kind, n: None) -> SyncResult:
        """Copies a remote branch's commits and what they need here. No branch moves."""
        name = branch or self.branch_name
        head = remote.resolve(name)
        wanted = remote._missing_commits(self, head)
        blobs = remote._send(self, wanted, progress) if wanted else 0
        return SyncResult(name, head, len(wanted), blobs, False)

    def pull(self, remote: Repository, branch: str | None = None, progress: Progress = lambda kind, n: None) -> SyncResult:
        """Fetches, and moves our branch forward to the remote's commit."""
        name = branch or self.branch_name
        head = remote.resolve(name)
        if self.store.ref(name) is None:
            self.store.set_ref(name, None, 0)
        at = self._ref(name)[0]
        if at and not (remote.store.has_commit(at) and remote.is_ancestor(at, head)):
            if self.store.has_commit(head) and self.is_ancestor(head, at):
                return SyncResult(name, at, 0, 0, False)
            raise NonFastForward(name, at, head)
        got = self.fetch(remote, name, progress)
        return SyncResult(name, head, got.commits, got.blobs, self.fast_forward(name, head, "pull"))

    def transfer_commands(self, target: str, ref: str | None = None, download: bool = False, metadata: bool = True) -> DataFrame:
        """command: lines that copy the blobs of a ref, and with metadata its snapshot, statistics and commit, to another
        store, or from there. They are for people; none is run here."""
        commit_id = self.resolve(ref)
        tree = self.store.commit(commit_id).tree
        objects = graph.leaf_objects(self._committed(ref)).filter("kind = 'blob'")
        path = F.concat(F.lit("blobs/"), F.left("id", F.lit(2)), F.lit("/"), F.substring("id", 3, 64))
        names = [f"snapshots/{tree}/{n}" for n in self.store.names("snapshots", tree)] + [f"footers/{n}" for n in self.store.names("footers")] + [f"commits/{commit_id}.json"]
        names += [f"directories/{tree}/{n}" for n in self.store.names("directories", tree)]
        every = objects.select(path.alias("p"))
        if metadata:
            every = every.unionByName(self.spark.createDataFrame([(n,) for n in names], "p string"))
        sides = [self.store.url().rstrip("/") + "/", target.rstrip("/") + "/"]
        source, sink = reversed(sides) if download else sides
        return every.select(F.concat(F.lit(f"cp '{source}"), "p", F.lit(f"' '{sink}"), "p", F.lit("'")).alias("command")).orderBy("command")

    def export_manifest(self, ref: str | None = None) -> str:
        """The URI of a ref's manifest as text; written once for each snapshot."""
        return self.store.manifest(self.store.commit(self.resolve(ref)).tree)

    # Queries

    def statistics(self) -> DataFrame:
        """RG_STATS of all captured footers, without paths."""
        from .sources.footers import row_group_stats

        return row_group_stats(self.store.footers())

    def prune(self, ref: str | None, prefix: str, where: str) -> DataFrame:
        """PRUNE rows of the entries below a path prefix that have statistics, with the columns that could be used and those
        that couldn't."""
        return prune.report(self._committed(ref), self.statistics(), prefix, prune.parse_where(where))

    def scan(self, ref: str | None, prefix: str, where: str) -> DataFrame:
        """The matching rows of the parquet files below a prefix; files that can't match aren't opened."""
        predicates = prune.parse_where(where)
        plan = prune.scan_plan(self._committed(ref), self.statistics(), prefix, predicates).collect()
        paths = [self.store.blob_url(r["blob_hash"]) if r["blob_hash"] else r["source_uri"] for r in plan]
        if not paths:
            raise StrataError("no file can hold a matching row")
        return self.spark.read.parquet(*paths).filter(prune.where_column(predicates))

    def build_catalog(self, ref: str | None = None, export: str | None = None) -> str:
        """Registers the views files, entries, commits, refs, reflog and rg_stats for Spark SQL; with export `files` is
        written there as parquet, too. The commit's id."""
        commit = self.store.commit(self.resolve(ref))
        rows = self.store.entries(commit.tree)
        table = catalog.files(rows, commit.id, commit.branch)
        catalog.register(self.spark, files=table, entries=rows, commits=self.store.commits(), refs=self.store.refs(), reflog=self.reflog(commit.branch), rg_stats=self.statistics())
        if export:
            table.write.mode("overwrite").parquet(f"{export.rstrip('/')}/{commit.id}.parquet")
        return commit.id

    def sql(self, text: str) -> DataFrame:
        return catalog.sql(self.spark, text)

    def drop_catalog(self) -> None:
        catalog.drop(self.spark, "files", "entries", "commits", "refs", "reflog", "rg_stats")


def _exhaust(rows) -> None:
    for _ in rows:
        pass
